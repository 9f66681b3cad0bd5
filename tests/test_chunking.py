import random

from pyspark.sql import functions as F

from curricle.operators import chunking as ck
from curricle.operators.packing import pack_groups

SEGMENT = "source_id long, instructor string, source_type string, seq long, locator string, text string"


def greedy(sizes, budget, overlap):
    groups, current = [], []
    for i, n in enumerate(sizes):
        if current and sum(sizes[j] for j in current) + n > budget:
            groups.append(current)
            current = current[-overlap:] if overlap else []
        current = [*current, i]
    return [*groups, current] if current else groups


def test_packing_of_long_sources_equals_a_plain_fold(spark):
    rng = random.Random(7)
    for overlap in (0, 1, 2, 3, 7):
        sources = {s: [rng.choice([1, 2, 3, 5, 9, 30]) for _ in range(rng.choice([1, 4, 37, 90]))] for s in range(12)}
        rows = [(s, i, n, 12, overlap, f"l{i}", f"t{i}") for s, ns in sources.items() for i, n in enumerate(ns)]
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "source_id long, seq long, n int, budget int, overlap int, locator string, text string")
        for sizes in ({"block_rows": 5, "fan": 2}, {}):
            got = {}
            for r in pack_groups(frame, **sizes).collect():
                got.setdefault(r["source_id"], []).append([m["seq"] for m in r["members"]])
            want = {s: greedy(ns, 12, overlap) for s, ns in sources.items()}
            assert {s: sorted(g) for s, g in got.items()} == {s: sorted(g) for s, g in want.items()}


def test_packing_with_gaps_before_the_first_piece(spark):
    rows = [(1, s, 4, 10, 1, "l", "t") for s in (12, 13, 14, 21, 33, 34, 35)]
    frame = spark.createDataFrame(rows, "source_id long, seq long, n int, budget int, overlap int, locator string, text string")
    got = sorted([m["seq"] for m in r["members"]] for r in pack_groups(frame, block_rows=5, fan=2).collect())
    assert got == [[12, 13], [13, 14], [14, 21], [21, 33], [33, 34], [34, 35]]


def test_overlaps_that_differ_between_sources_and_reach_over_blocks(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for s in range(20):
        overlap, budget = rng.choice([0, 1, 2, 5, 9, 40]), rng.choice([3, 12, 50])
        seqs = sorted(rng.sample(range(200), rng.choice([1, 6, 40, 120])))
        sizes = [rng.choice([1, 2, 3, 9, 70]) for _ in seqs]
        rows += [(s, i, n, budget, overlap, "l", "t") for i, n in zip(seqs, sizes)]
        want[s] = sorted([seqs[j] for j in g] for g in greedy(sizes, budget, overlap))
    frame = spark.createDataFrame(rows, "source_id long, seq long, n int, budget int, overlap int, locator string, text string")
    for sizes in ({"block_rows": 6, "fan": 3}, {}):
        got = {}
        for r in pack_groups(frame.repartition(3), **sizes).collect():
            got.setdefault(r["source_id"], []).append([m["seq"] for m in r["members"]])
        assert {s: sorted(g) for s, g in got.items()} == want


def test_batches_equal_a_plain_fold(spark):
    rng = random.Random(3)
    sizes = {"a": [rng.randint(1, 9) for _ in range(140)], "b": [rng.randint(1, 40) for _ in range(23)], "c": [2]}
    rows = [(k, i, " ".join(["word"] * n)) for k, ns in sizes.items() for i, n in enumerate(ns)]
    items = spark.createDataFrame(rows, "source_id string, pos long, text string")
    want = set()
    for key, ns in sizes.items():
        start, count, total = 0, 0, 0
        for i, n in enumerate(ns):
            if count and (total + n > 30 or count >= 5):
                start, count, total = i, 0, 0
            count, total = count + 1, total + n
            want.add((key, i, start))
    for block in (6, 1000):
        got = {tuple(r) for r in ck.plan_batches(items, 5, 30, block_rows=block).collect()}
        assert got == want


def test_pages_stay_apart(spark):
    rows = [(1, "a", "pdf", i, f"p.{i + 1}", t) for i, t in enumerate(["Decision tree and entropy", " ", "neural networks"])]
    chunks = ck.build_chunks(spark.createDataFrame(rows, SEGMENT)).collect()
    assert sorted(c["locator"] for c in chunks) == ["p.1", "p.3"]


def test_worksheet_blocks_are_dropped(spark):
    page = "■ 결정 트리 entropy ■ random forest 앙상블 Q1. 빈칸을 채우시오 ____ 답: 트리"
    rows = [(1, "a", "pdf", 0, "p.1", page)]
    chunks = ck.build_chunks(spark.createDataFrame(rows, SEGMENT)).collect()
    assert sorted((c["locator"], c["text"]) for c in chunks) == [
        ("p.1 (1/2)", "■ 결정 트리 entropy"), ("p.1 (2/2)", "■ random forest 앙상블"),
    ]


def test_captions_lose_sound_markers_and_are_cut(spark):
    rows = [(1, "a", "youtube", i, f"00:{i:02d}", "[음악]" if i % 9 == 0 else "entropy tree") for i in range(80)]
    chunks = ck.build_chunks(spark.createDataFrame(rows, SEGMENT)).collect()
    assert len(chunks) >= 3 and not any("음악" in c["text"] for c in chunks)


def test_row_local_chunks_equal_table_chunks(spark):
    rows = [
        (s, "a", kind, i, f"l{i}", f"alpha{i} beta. gamma {s} [music] " * (i % 5 + 1))
        for s, kind in enumerate(["pdf", "youtube", "csv", "text"])
        for i in range(40)
    ]
    segments = spark.createDataFrame(rows, SEGMENT)
    packed = segments.groupBy("source_id", "instructor", "source_type").agg(
        F.sort_array(F.collect_list(F.struct("seq", "locator", "text"))).alias("segments")
    )
    columns = ["source_id", "chunk_seq", "part_no", "locator", "text"]
    for overlap in (1, 3):
        a = ck.build_chunks(segments, 30, overlap).select(*columns)
        b = ck.chunk_source_rows(packed, 30, overlap).select(*columns)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_dedupe_keeps_the_first_copy(spark):
    rows = [("c", "a", s, 0, 0, "same") for s in (3, 1, 2)] + [("c", "b", 9, 0, 0, "same")]
    chunks = spark.createDataFrame(rows, "course_id string, instructor string, source_id long, chunk_seq long, part_no int, fingerprint string")
    kept, removed = ck.dedupe_chunks(chunks)
    assert sorted(r["source_id"] for r in kept.collect()) == [1, 9]
    assert {r["instructor"]: r["removed"] for r in removed.collect()} == {"a": 2, "b": 0}


def test_clean_texts_are_identified_alike(spark):
    rows = [
        (i, "a", kind, i, loc, t)
        for kind in ("pdf", "csv", "youtube")
        for i, (loc, t) in enumerate([(" p. 1 ", "Tree\u00a0 of [music] Life"), ("q\t", "\u00a0"), ("r", "x-1 y [ z")])
    ]
    parts = ck.build_chunks(spark.createDataFrame(rows, SEGMENT), 3, 0)
    columns = ["source_type", "text", "chunk_id", "fingerprint"]
    want = sorted(map(tuple, ck.identify_chunks(parts).select(*columns).collect()))
    assert sorted(map(tuple, ck.identify_chunks(parts, clean=True).select(*columns).collect())) == want
    assert any(t == "" for _, t, _, _ in want)


def test_long_sources_are_packed_in_batches_of_groups(spark):
    rows = [(s, "c", "i", "l", "csv", n, f"r{n}", "w " * (1 + (s + n) % 5)) for s in range(3) for n in range(90)]
    segments = spark.createDataFrame(rows, "source_id long, course_id string, instructor string, source_label string, source_type string, seq long, locator string, text string")
    blocked = ck.pack_segments(segments, 12, 2, block_rows=8, fan=2)
    plan = blocked._jdf.queryExecution().optimizedPlan().toString()
    # a pandas frame per group cost more than its fold, all in the few tasks that small tables fill
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan
    assert sorted(map(tuple, blocked.collect())) == sorted(map(tuple, ck.pack_segments(segments, 12, 2).collect()))
