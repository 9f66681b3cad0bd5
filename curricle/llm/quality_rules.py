"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document.  The ledger keeps the measurements and one
bit per failed rule, so a policy (a versioned mask) is applied later without touching
the text, and an ablation is an aggregate over the few distinct bit patterns.

All of it is row local: no shuffle, no Python.  Null, empty and blank texts have no words
and fail `few_words`; a null id stays null; repeated rows are judged alike; other columns
of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curricle.llm.frames import BLANKS, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
@dataclass(frozen=True)
class Rule:
    """A document fails where the SQL condition over the measurements holds."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "5 * n_symbols > n_words"),
    Rule("upper_words", 3, "10 * n_upper_words > 4 * n_words"),
    Rule("stutters", 4, "5 * n_stutters > n_words"),
    Rule("duplicate_lines", 5, "2 * n_dup_lines > n_lines"),
    Rule("word_length", 6, "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)


def mask_of(*names: str) -> int:
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in names)


BASE = mask_of("few_words", "repeated_windows")
#: Versions of the policy: a document is kept where none of these bits is set.
POLICIES: Mapping[str, int] = {
    "base": BASE,
    "v1": BASE | mask_of("symbols", "upper_words", "stutters"),
    "v2": sum(1 << rule.bit for rule in RULES),
}
CURRENT = "v2"

# Words, lines and hashes are bound once per document by transform(array(x), x -> ...)[0];
# naming them as columns would let the optimizer evaluate them again for every element.
_REPEATED = f"""
    transform(array(transform(w, x -> xxhash64(x))), g ->
      transform(array(transform(sequence(0, size(g) - {WINDOW}),
                i -> xxhash64({", ".join(f"g[i + {k}]" if k else "g[i]" for k in range(WINDOW))}))), h ->
        if(size(array_distinct(h)) = size(h), 0L,
          transform(array(array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))), s ->
            transform(array(array_sort(transform(filter(s, (x, k) ->
                (k > 0 AND s[greatest(k - 1, 0)].h = x.h
                   AND slice(w, s[greatest(k - 1, 0)].i + 1, {WINDOW}) = slice(w, x.i + 1, {WINDOW}))
                OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h
                   AND slice(w, s[least(k + 1, size(s) - 1)].i + 1, {WINDOW}) = slice(w, x.i + 1, {WINDOW}))),
                x -> x.i))), p ->
              aggregate(transform(p, (x, k) ->
                  if(k = size(p) - 1, {WINDOW}, least({WINDOW}, p[least(k + 1, size(p) - 1)] - x))),
                0L, (a, b) -> a + b))[0])[0]))[0])[0]
"""

_OF_WORDS = f"""
transform(array(words), w -> named_struct(
  'n_words', cast(size(w) AS bigint),
  'n_upper_words', cast(size(filter(w, x -> x = upper(x) AND x != lower(x))) AS bigint),
  'n_stutters', cast(size(filter(w, (x, i) -> i > 0 AND x = w[greatest(i - 1, 0)])) AS bigint),
  'n_repeat_words', if(size(w) <= {WINDOW}, 0L, {_REPEATED})))[0]
"""

_OF_LINES = """
transform(array(filter(split(text, '\\n'), x -> trim(BOTH '\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D' FROM x) != '')), l -> named_struct(
  'n_lines', cast(size(l) AS bigint),
  'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint)))[0]
"""


def _without(text: Column, characters: str) -> Column:
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


def quality_ledger(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False
) -> DataFrame:
    """One row per document: id, measurements, `failures` (bit set).

    With whole_rows the input row comes along as the struct `document`.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = [F.struct("*").alias("document")] if whole_rows else []
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *row)
    measured = (
        base.withColumn("words", words_of(F.col("text")))
        .withColumn("of_words", F.expr(_OF_WORDS))
        .withColumn("of_lines", F.expr(_OF_LINES))
    )
    removed = {"n_symbols": SYMBOLS, "n_blanks": BLANKS}
    single = {
        name: F.length("text") - F.length(_without(F.col("text"), characters))
        for name, characters in removed.items()
    }
    flat = measured.select(
        *(["document"] if whole_rows else []),
        "doc_id",
        "of_words.*",
        "of_lines.*",
        single["n_symbols"].cast("long").alias("n_symbols"),
        (F.length("text") - single["n_blanks"]).cast("long").alias("word_chars"),
    )
    bits = " | ".join(f"if({rule.fails}, {1 << rule.bit}L, 0L)" for rule in RULES)
    return flat.withColumn("failures", F.expr(bits))


def judge(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds `base_failed` and `kept` under the given version of the policy."""
    failed = F.col("failures").bitwiseAND(F.lit(POLICIES[version])) != 0
    base_failed = F.col("failures").bitwiseAND(F.lit(BASE)) != 0
    return ledger.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~failed)


def ablation(ledger: DataFrame, policies: Mapping[str, int] = POLICIES) -> DataFrame:
    """For each policy and rule: documents failing the rule, and those only it rejects.

    The ledger is first reduced to its distinct bit patterns (at most 2 ** rules rows).
    """
    patterns = ledger.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(
        *[
            F.struct(
                F.lit(version).alias("policy"),
                F.lit(rule.name).alias("rule"),
                F.lit(mask).cast("long").alias("mask"),
                F.lit(1 << rule.bit).cast("long").alias("bit"),
            )
            for version, mask in policies.items()
            for rule in RULES
            if mask >> rule.bit & 1
        ]
    )
    failed = F.col("failures").bitwiseAND(F.col("mask"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return (
        patterns.select("failures", "n", F.inline(rules))
        .groupBy("policy", "rule")
        .agg(
            total(F.col("failures").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total(failed == F.col("bit")).alias("n_only"),
            total(failed != 0).alias("n_rejected"),
        )
    )
