import math
import random

import pytest
from pyspark.sql import functions as F

from curricle.functions.needles import needle_groups
from curricle.operators import feedback as fb
from curricle.operators import keywords as kw
from curricle.operators import ranking as rk


def texts(rng, n=300):
    return ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 80))) for _ in range(n)] + [None, "", "한국어 abc"]


@pytest.mark.parametrize("block", [1 << 20, 40_000])
def test_ten_thousand_needles_against_contains(spark, block):
    rng = random.Random(1)
    needles = {"".join(rng.choice("abcde ") for _ in range(rng.randrange(2, 9))) for _ in range(12_000)}
    rows = [(i % 5000, w) for i, w in enumerate(sorted(needles))][:10_000] + [(9001, ""), (9002, "국어"), (9003, None), (None, "a"), (9004, "ab"), (9005, "ab")]
    table = spark.createDataFrame(rows, "grp long, needle string")
    lines = spark.createDataFrame(list(enumerate(texts(rng))), "i long, text string").repartition(3)
    found = lines.select("i", "text", needle_groups(table, block)("text").alias("g"))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and len(plan) < 60_000
    usable = [(g, w) for g, w in rows if g is not None and w is not None]
    for r in found.collect():
        want = [] if r.text is None else sorted({g for g, w in usable if w in r.text})
        assert sorted(r.g) == want


def test_no_needles(spark):
    table = spark.createDataFrame([], "grp long, needle string")
    lines = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.g for r in lines.select(needle_groups(table)("text").alias("g")).collect()] == [[], []]


def test_labels_from_a_long_table(spark):
    rng = random.Random(3)
    hints = [("negative" if i % 3 else "positive", i, "".join(rng.choice("abcd") for _ in range(3)), f"L{i % 40}") for i in range(3000)]
    lines = [(f"i{k % 4}", k, s, "".join(rng.choice("abcd ") for _ in range(30))) for k in range(40) for s in range(2)]
    got = fb.sentiment_labels(
        spark.createDataFrame(lines, "instructor string, source_id long, seq long, text string"),
        spark.createDataFrame(hints, "polarity string, ord long, needle string, label string"),
    ).collect()
    want = []
    for who in sorted({x[0] for x in lines}):
        for polarity in ("positive", "negative"):
            count, seen = {}, {}
            for _, source, seq, text in sorted(x for x in lines if x[0] == who):
                for p, o, needle, label in hints:
                    if p == polarity and needle in text:
                        count[label] = count.get(label, 0) + 1
                        seen[label] = min(seen.get(label, (source, seq, o)), (source, seq, o))
            best = sorted(count, key=lambda x: (-count[x], seen[x]))[:4]
            want += [(who, x, r, polarity) for r, x in enumerate(best, 1)]
    assert sorted((r["instructor"], r["label"], r["rank"], r["polarity"]) for r in got) == sorted(want)


def test_random_and_string_ids_have_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.getrandbits(63) - (1 << 62), f"é{rng.random()}", i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, o long, s string, n int").repartition(5)
    for order in ("o", "s", ["n", "o"]):
        got = {(r.k, r.n): r.pos for r in rk.dense_positions(frame, ["k"], order, width=250).collect()}
        want = {}
        for k in ("a", "b", None):
            own = [r for r in rows if r[0] == k]
            own.sort(key=(lambda r: r[1]) if order == "o" else (lambda r: r[2].encode()) if order == "s" else (lambda r: r[3]))
            want |= {(k, r[3]): i for i, r in enumerate(own)}
        assert got == want


def test_five_million_rows_of_one_key(spark):
    frame = spark.range(5_000_000).select(F.lit("k").alias("k"), F.xxhash64("id").alias("o"))
    placed = rk.dense_positions(frame, ["k"], "o", width=500_000)
    n, low, high, positions = placed.agg(F.count("*"), F.min("pos"), F.max("pos"), F.count_distinct("pos")).first()
    assert (n, low, high, positions) == (5_000_000, 0, 4_999_999, 5_000_000)
    ends = {r.pos: r.o for r in placed.filter("pos IN (0, 4999999)").collect()}
    assert (ends[0], ends[4_999_999]) == tuple(frame.agg(F.min("o"), F.max("o")).first())


def test_ranks_of_nothing(spark):
    assert rk.dense_positions(spark.createDataFrame([], "k string, o long"), ["k"], "o").count() == 0


def test_terms_are_counted_and_dealt_once_for_all_scores(spark):
    texts = ["alpha beta beta beta", "alpha gamma", "delta alpha", "beta gamma", "gamma"]
    chunks = spark.createDataFrame([("c", f"i{n % 2}", "pdf", t) for n, t in enumerate(texts)], "course_id string, instructor string, source_type string, text string")
    vocab = spark.createDataFrame([("c", "gamma")], "course_id string, term string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    table = kw.keyword_table(kw.chunk_keywords(chunks), vocab)
    off = kw.tfidf(kw.off_curriculum_weights(kw.dealt_weights(table), vocab), kw.document_totals(table), "n_off_docs")
    plain = kw.tfidf(kw.off_curriculum_weights(kw.keyword_weights(table), vocab), kw.document_totals(table), "n_off_docs")
    want = {("i0", "alpha"): 2 * math.log(5 / 4) + 2, ("i1", "beta"): math.log(5 / 3) + 1, ("i0", "beta"): 6 * (math.log(5 / 3) + 1), ("i0", "delta"): math.log(5 / 2) + 1, ("i1", "alpha"): math.log(5 / 4) + 1}
    for scored in (off, plain):
        got = {(r["instructor"], r["term"]): r["score"] for r in scored.filter("mode = 'combined'").collect()}
        assert got == pytest.approx(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scored = kw.tfidf(kw.dealt_weights(table), kw.document_totals(table)).filter("mode = 'combined'")
        steps = scored._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # weights are dealt once, by part, and totals meet them there; no join or window by term or by the few courses and modes
    moved = [s for s in steps if "Exchange hashpartitioning" in s]
    assert sum("part#" in s for s in moved) == 2 and not any("term#" in s or "mode#" in s for s in moved)
    assert any("ReusedExchange" in s for s in steps)
