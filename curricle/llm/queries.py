"""Queries of the operators over the given tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curricle.llm import (
    bloom_lm,
    fm_index,
    html_layout,
    line_chunks,
    multi_index,
    periodic_runs,
    quality_rules,
    random_indexing,
    role_repair,
    sharding,
    simhash,
    super_kmers,
    trie_bpe,
)
from curricle.llm.frames import table, words_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return keep


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
win AS (
  SELECT doc_id, i,
    concat_ws(' ', word, {", ".join(f"lead(word, {k}) OVER p" for k in range(1, 8))}) AS window_text,
    lead(word, 7) OVER p AS last_word
  FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
again AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, window_text) AS n
    FROM win WHERE last_word IS NOT NULL) WHERE n > 1),
gaps AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS gap FROM again),
rep AS (SELECT doc_id, sum(gap) AS n FROM gaps GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l,
    len(list_filter(w, lambda y: y = upper(y) AND y <> lower(y)))::BIGINT AS n_upper_words,
    len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1]))::BIGINT AS n_stutters,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
n AS (SELECT *, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM m),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality_rules.RULES)})::BIGINT AS failures FROM n)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper_words, n_stutters,
  failures, failures & {quality_rules.BASE} <> 0 AS base_failed,
  failures & {quality_rules.POLICIES[quality_rules.CURRENT]} = 0 AS kept
FROM f
"""


@query("op5_quality_rules", QUALITY_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(quality_rules.quality_ledger(table(spark, sf_dir, "documents")))


CHUNK_SQL = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text <> ''),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS g FROM x),
b AS (
  SELECT *, CASE WHEN i = 0 OR (lag(g, 1) OVER p + {line_chunks.BASE} * coalesce(lag(g, 2) OVER p, 0))
      % {line_chunks.MODULUS} % {line_chunks.DIVISOR} = 0 THEN 1 ELSE 0 END AS cut
  FROM h WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM b),
p AS (SELECT doc_id, chunk, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk_text FROM c GROUP BY 1, 2),
r AS (
  SELECT *, n_lines >= {line_chunks.MIN_LINES}
      AND row_number() OVER (PARTITION BY chunk_text, n_lines >= {line_chunks.MIN_LINES} ORDER BY doc_id, chunk) > 1 AS gone
  FROM p),
o AS (
  SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_removed_chunks,
    coalesce(sum(n_lines) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines,
    coalesce(string_agg(chunk_text, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') AS clean_text
  FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(o.n_lines, 0) AS n_lines, coalesce(n_removed_chunks, 0) AS n_removed_chunks,
  coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(clean_text, d.text) AS clean_text
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id
"""


@query("op4_line_chunks", CHUNK_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents"))


@query("op7_hash_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), sharding.even_tree(40))


_ITEM_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

CONTAMINATION_SQL = rf"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_ITEM_WORDS} AS w FROM benchmark),
p AS (
  SELECT item, least(len(w), {fm_index.SIZE}) AS size, unnest(range(greatest(1, len(w) - {fm_index.SIZE - 1}))) AS i, w FROM b WHERE len(w) > 0),
phrase AS (SELECT DISTINCT item, size, array_to_string(w[i + 1:i + size], ' ') AS words FROM p),
sizes AS (SELECT DISTINCT size FROM phrase),
win AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS words
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d JOIN sizes ON len(w) >= size)),
hit AS (SELECT win.doc_id, win.i, win.size, phrase.item FROM win JOIN phrase ON phrase.size = win.size AND phrase.words = win.words),
word AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS j FROM hit),
cover AS (
  SELECT doc_id, count(*) AS n_hit, count(*) FILTER (before IS DISTINCT FROM j - 1) AS n_spans
  FROM (SELECT *, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS before FROM word) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated,
  coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


@query("op3_fm_index", CONTAMINATION_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm_index.find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
        F.size("spans").cast("long").alias("n_spans"),
    )


@query("op6_simhash_pivots")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_trie_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True
    )


SUBSTRING_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i + 1:i + {super_kmers.WINDOW}], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(len(w) - {super_kmers.WINDOW - 1})) AS i FROM d WHERE len(w) >= {super_kmers.WINDOW})),
again AS (SELECT doc_id, i, 1 AS mark FROM win QUALIFY count(*) OVER (PARTITION BY words) > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
c AS (
  SELECT x.doc_id, x.i, word, max(mark) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS {super_kmers.WINDOW - 1} PRECEDING) AS gone
  FROM x LEFT JOIN again ON again.doc_id = x.doc_id AND again.i = x.i),
k AS (SELECT doc_id, count(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone IS NULL) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


@query("op9_super_kmers", SUBSTRING_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = super_kmers.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


@query("op10_bloom_lm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"))


@query("op1_html_layout")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract_text(table(spark, sf_dir, "pages"))


@query("op2_role_repair")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair_conversations(table(spark, sf_dir, "conversations"))


@query("op13_sync_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", words_of(F.col("text")).alias("words"))
    words = periodic_runs.repeat_tails(F.col("words"), F.col("doc_id"))
    return periodic_runs.run_digests(periodic_runs.find_runs(docs, words))


NEGATIVE_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, v) = 1),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM usable a JOIN usable r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INTEGER AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80 * p.score <= 100 * n.score AND n.score <= p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""


@query("op12_multi_index", NEGATIVE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = multi_index.integer_vectors(table(spark, sf_dir, "embeddings"), 256, label)
    return multi_index.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op11_random_indexing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    scored = random_indexing.score_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 0
    )
    return scored.select(
        "doc_id",
        (fold == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
