import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curricle.llm import multi_index as m
from curricle.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, batch int, top string"


def vectors(n, dim, seed, spread=0.3, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    kind = rng.integers(0, groups, n)
    x = (centres[kind] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(i, x[i].tolist(), int(kind[i] % 4), 1, "t") for i in range(n)]


def plain(rows, anchor=100, k=5):
    """Every anchor against every row."""
    least = {}
    for vec_id, x, label, *_ in rows:
        if vec_id is None or label is None or x is None:
            continue
        if any(y is None or not math.isfinite(y) for y in x):
            continue
        entry = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * y) for y in x])
        least[vec_id] = min(least.get(vec_id, entry), entry)
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = []
    for a, (label, v) in least.items():
        if a % anchor:
            continue
        scored = sorted((-dot(v, w), i, other == label) for i, (other, w) in least.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2]][:k]:
            near = [(s, i) for s, i, same in scored if not same and -80 * ps <= -100 * s <= -100 * ps][:k]
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted(tuple(r) for r in queries.QUERIES["op12_multi_index"](spark, str(path)).collect())


@pytest.mark.parametrize("blocks", [None, 16])
def test_query_against_every_pair(spark, tmp_path, monkeypatch, blocks):
    if blocks:  # many blocks a cell, many batches of anchors, few scores at once
        monkeypatch.setattr(m, "BLOCK", blocks)
        monkeypatch.setattr(m, "BATCH", 3)
        monkeypatch.setattr(m, "SCORES_AT_ONCE", 40)
    rows = vectors(1500, 12, 1)
    copy = rows[100][1]
    rows += [(i, copy, i % 4, 1, "t") for i in range(1500, 1700)]  # a third of ties
    rows += [(i, [-y for y in copy], 1, 1, "t") for i in range(1700, 1710)]
    rows += [(2100, [0.0] * 12, 2, 0, ""), (2101, [0.0] * 12, 3, 0, "")]
    rows += [(None, copy, 1, 1, "t"), (3000, None, 1, 1, "t"), (3001, copy, None, 1, "t")]
    rows += [(3002, [None, *copy[1:]], 1, 1, "t"), (3003, [math.nan, *copy[1:]], 1, 1, "t")]
    rows += [(3004, [math.inf, *copy[1:]], 1, 1, "t"), (3100, copy[:5], 1, 1, "t")]
    rows += [(200, copy, 3, 1, "t"), rows[300]]  # one id twice, one row twice
    random.Random(1).shuffle(rows)
    want = plain(rows)
    assert len(want) > 200
    assert mined(spark, rows, tmp_path) == want


def test_sql_says_the_same(spark, tmp_path):
    rows = vectors(700, 8, 2) + [(3002, [None] * 8, 1, 1, ""), (100, [0.5] * 8, 1, 1, "")]
    got = mined(spark, rows, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.sql(queries.NEGATIVE_SQL).fetchall()) == got


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    v = [(i, "ab"[i % 2], [rng.randrange(-(1 << 29), 1 << 29) for _ in range(6)]) for i in range(300)]
    frame = spark.createDataFrame(v, "vec_id long, label string, v array<long>")
    got = m.hard_negatives(frame, F.col("vec_id") % 50 == 0, 3, 2, (10, 90)).collect()
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    want = []
    for a, label, x in v[::50]:
        scored = sorted((-dot(x, y), i, o == label) for i, o, y in v if i != a)
        for ps, p, _ in [s for s in scored if s[2]][:3]:
            near = [(s, i) for s, i, same in scored if not same and -10 * ps <= -100 * s <= -90 * ps][:2]
            want += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(near, 1)]
    assert want and sorted(map(tuple, got)) == sorted(want)


def test_cells_are_left_unvisited(spark):
    """In well separated groups the certificate ends the search early."""
    rows = spark.createDataFrame(vectors(3000, 16, 5, 0.02, 12), SCHEMA)
    index = m.build_index(m.stored(m.integer_vectors(rows, 256)))
    first = index.rows.filter("vec_id = 0").withColumnsRenamed({"vec_id": "anchor_id"})
    state = first.selectExpr("anchor_id", "label", "v", "0 AS batch", "array(0L) AS tops", "0D AS floor", "1e300D AS ceiling")
    probe = "cell int, block int, batch int, anchor_id long, label int, v array<long>, tops array<long>"
    everything = state.mapInArrow(m._next_cells(index, 0.0, 1.0), probe).count()
    best = state.withColumn("floor", F.lit(0.9) * F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fewer = best.mapInArrow(m._next_cells(index, 0.0, 1.0), probe).count()
    assert 0 < fewer <= everything // 2


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1, 0, "")], [(100, [1.0], 1, 0, "")], [(100, [], 1, 0, ""), (101, [], 1, 0, "")]])
def test_empty_and_tiny_tables(spark, tmp_path, rows):
    assert mined(spark, rows, tmp_path) == plain(rows)


def many_cells(spark, monkeypatch, n_anchors=600):
    """An index of many small cells, and anchors that visit them all, as one Arrow batch."""
    monkeypatch.setattr(m, "CELL_ROWS", 1)
    rows = vectors(2000, 16, 7, 2.0)
    index = m.build_index(m.stored(m.integer_vectors(spark.createDataFrame(rows, SCHEMA), 256)))
    anchors = [
        {"anchor_id": i, "label": label, "v": [math.floor(256 * y) for y in x], "batch": 0, "tops": [0],
         "leasts": [None], "floor": -math.inf, "ceiling": math.inf}
        for i, x, label, *_ in rows[:n_anchors]
    ]
    schema = pa.schema([
        ("anchor_id", pa.int64()), ("label", pa.int32()), ("v", pa.list_(pa.int64())), ("batch", pa.int32()),
        ("tops", pa.list_(pa.int64())), ("leasts", pa.list_(pa.int64())), ("floor", pa.float64()), ("ceiling", pa.float64()),
    ])
    return index, pa.RecordBatch.from_pylist(anchors, schema)


def test_visits_leave_a_task_in_small_batches(spark, monkeypatch):
    """Not all visits of an Arrow batch of anchors at once, each with its vector."""
    index, anchors = many_cells(spark, monkeypatch)
    cells = int((index.sizes > 0).sum())
    got = [len(b) for b in m._next_cells(index, 0.0, 1.0)(iter([anchors]))]
    assert sum(got) == len(anchors) * cells > 200_000
    assert max(got) <= 40_000


def test_a_probe_serves_all_cells_of_a_shard(spark, monkeypatch):
    index, anchors = many_cells(spark, monkeypatch, 50)
    shards = int(index.shards.max()) + 1
    visited = [0] * 50
    probes = [r for b in m._probes(index, 0.0, 1.0)(iter([anchors])) for r in b.to_pylist()]
    for r in probes:
        visited[r["anchor_id"]] += sum(map(int.bit_count, r["cells"]))
    assert len(probes) == 50 * shards < 50 * 20
    assert set(visited) == {int((index.sizes > 0).sum())}


@pytest.mark.parametrize("block", [8, 1000])
def test_small_shards_and_pools_against_every_pair(spark, tmp_path, monkeypatch, block):
    settings = {"BLOCK": block, "CELL_ROWS": 2, "SHARD_ROWS": (1, 30), "SHARD_CELLS": 8, "SHARDS": 50,
                "VISITS_AT_ONCE": 5, "FOUND_AT_ONCE": 3}
    for name, value in settings.items():
        monkeypatch.setattr(m, name, value)
    rows = vectors(900, 10, 8, 0.5) + [(i, [0.5] * 10, i % 3, 1, "t") for i in range(900, 960)]
    want = plain(rows)
    assert len(want) > 100
    assert mined(spark, rows, tmp_path) == want


def test_windows_of_large_scores(spark):
    """100 times a score may exceed 64 bits."""
    big = [(0, "a", [1 << 31, 0]), (1, "a", [1 << 30, 1]), (2, "b", [(1 << 30) - 7, 5]), (3, "b", [1 << 29, 0]), (4, "b", [858993460, 0]), (5, "b", [858993459, 0])]
    frame = spark.createDataFrame(big, "vec_id long, label string, v array<long>")
    got = sorted(map(tuple, m.hard_negatives(frame, F.col("vec_id") == 0).collect()))
    top = 1 << 61
    assert got == [(0, 1, 1, 2, top, (1 << 31) * ((1 << 30) - 7)), (0, 1, 2, 4, top, (1 << 31) * 858993460)]
