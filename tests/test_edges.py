"""Cases in which a bound or a join must not change results."""

import random

from pyspark.sql import functions as F

from curricle.functions.tokens import tokenize
from curricle.operators import curriculum as cu
from curricle.operators import matching as ma
from curricle.operators import ranking as rk
from curricle.operators import runs

SECTION_DDL = "course_id string, section_ord int, section_id string, title string, description string, target_weight double"


def test_excerpt_with_short_lines_equals_a_plain_fold(spark):
    random.seed(1)
    rows = []
    for doc in range(3):
        for page in range(1, 40):
            for _ in range(14):
                size = random.choice([1, 2, 3, 4, 5, 60])
                rows.append((doc, page, "".join(random.choice("ab") for _ in range(size)), random.randrange(4)))
    lines = spark.createDataFrame(rows, "doc_id long, page int, line string, score int")
    got = {(r.doc_id, r.page, r.line, r.used) for r in rk.budgeted_excerpt(lines, 700).collect()}
    want = set()
    for doc in range(3):
        best = {}
        for d, page, line, score in rows:
            if d == doc and score > 0 and len(line) >= 4:
                best[page, line] = max(score, best.get((page, line), 0))
        listed = []
        for page in {p for p, _ in best}:
            own = sorted(((-s, line) for (p, line), s in best.items() if p == page))[:12]
            listed += [(s, page, line) for s, line in own]
        used = 0
        for _, page, line in sorted(listed):
            used += len(f"[p.{page}] {line}\n")
            if used > 700:
                break
            want.add((doc, page, line, used))
    assert got == want and len(want) > 30


def test_budget_with_short_durations_equals_a_plain_fold(spark):
    random.seed(2)
    rows = [("m1", i, 0.5) for i in range(150)]
    rows += [("m2", i, random.choice([0.25, 0.5, 1.0, 7.0, 0.0, 61.0])) for i in range(300)]
    frame = spark.createDataFrame(rows, "month string, seq long, duration_s double")
    got = {(r.month, r.seq): r.accepted for r in runs.budget_gate(frame, 1).collect()}
    used = {"m1": 0.0, "m2": 0.0}
    for month, seq, duration in rows:
        if duration <= 0:
            assert got[month, seq]
            continue
        fits = used[month] + duration / 60 <= 1.0
        if fits:
            used[month] = round(used[month] + duration / 60, 4)
        assert got[month, seq] == fits, (month, seq)
    assert sum(got["m1", i] for i in range(150)) > 100


def chunk_rows(spark, rows):
    frame = spark.createDataFrame(
        [(course, "a", i, "csv", "label", "l", 0, 0, text) for i, (course, text) in enumerate(rows)],
        "course_id string, instructor string, source_id long, source_type string, source_label string, "
        "locator string, chunk_seq long, part_no int, text string",
    )
    return frame.withColumn("tokens", tokenize("text")).withColumn("token_count", F.greatest(F.lit(1), F.size("tokens")))


def profiles(spark):
    sections = [("c", 1, "s1", "Decision Tree", "entropy", 50.0), ("c", 2, "s2", "Neural Networks", "errors", 50.0)]
    return cu.course_profiles(cu.describe_sections(spark.createDataFrame(sections, SECTION_DDL)))


def test_a_course_without_sections_keeps_its_chunks_unmapped(spark):
    chunks = chunk_rows(spark, [("c", "decision tree entropy"), ("other", "decision tree entropy")])
    got = {r.course_id: (r.section_id, r.section_title) for r in ma.assign_chunks(chunks, profiles(spark)).collect()}
    assert got == {"c": ("s1", "Decision Tree"), "other": (None, "Other / Unmapped")}


def test_a_chunk_without_a_vector_stays_unmapped(spark):
    chunks = chunk_rows(spark, [("c", "decision tree"), ("c", "neural networks")])
    keys = ma._chunk_keys(chunks)
    scores = chunks.filter("source_id = 1").select(*keys, F.array(F.lit(0.1), F.lit(0.9)).alias("scores"))
    got = {r.source_id: r.section_id for r in ma.assign_chunks(chunks, profiles(spark), vector_scores=scores).collect()}
    assert got == {0: None, 1: "s2"}


def test_a_video_without_a_profile_is_not_lost_among_vectors(spark):
    vectors = spark.createDataFrame([("c", 1, [1.0, 0.0]), ("x", 2, [1.0, 0.0])], "course_id string, vec_id int, vector array<double>")
    sections = spark.createDataFrame([("c", 1, "s1", [1.0, 0.0])], "course_id string, section_ord int, section_id string, vector array<double>")
    got = {r.vec_id: r.score for r in ma.score_vectors(vectors, sections).collect()}
    assert got == {1: 1.0, 2: None}


def plain_budget(rows, budget):
    used, out = {}, {}
    for month, seq, duration in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if duration is None or duration <= 0:
            out[month, seq] = duration is not None
            continue
        fits = used.get(month, 0) / 10_000 + duration / 60 <= budget
        if fits:
            used[month] = used.get(month, 0) + round(duration / 60 * 10_000)
        out[month, seq] = fits
    return out


def test_budget_of_a_million_minutes_over_many_blocks(spark):
    rng = random.Random(8)
    draw = [lambda: rng.uniform(1, 100_000), lambda: rng.choice([0.001, 0.5, 60.0]), lambda: 2.0 ** rng.randrange(-8, 27)]
    rows = [("long", i, draw[0]()) for i in range(3000)]
    rows += [("mixed", i, rng.choice(draw)()) for i in range(4000)]
    rows += [("halves", i, 6e7 / 2 ** (i % 40 + 1)) for i in range(900)]
    rows += [("short", 0, 5.0), ("short", 1, 0.0), ("short", 2, None), ("short", 3, -1.0), ("none", 0, 0.0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "month string, seq long, duration_s double").repartition(3)
    got = {(r.month, r.seq): r.accepted for r in runs.budget_gate(frame, 1_000_000, block_rows=200).collect()}
    want = plain_budget(rows, 1_000_000)
    assert got == want
    assert 500 < sum(want.values()) < len(rows) - 500


def test_budget_without_requests(spark):
    frame = spark.createDataFrame([], "month string, seq long, duration_s long")
    assert runs.budget_gate(frame, 5).collect() == []
