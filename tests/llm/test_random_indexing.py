import random
import zlib

import numpy as np
import pytest

from curricle.llm import queries
from curricle.llm import random_indexing as m

DOCS = "doc_id long, text string, key string, value double, label int"


def text(rng, good):
    syllables = ["an", "er", "on", "the", "ti", "ed", "or", "st"]
    words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 120))]
    if not good:
        kind = rng.randrange(3)
        words = [w + "#$%"[kind] * 3 for w in words] if kind else [w.upper() + "!!" for w in words]
    return " ".join(words)


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    good = [rng.random() < 0.8 for _ in range(n)]
    docs = [(i, text(rng, g), "k", 0.5, 1 - g) for i, g in enumerate(good)]
    labels = [(i, int(g), 0) for i, g in enumerate(good) if rng.random() < 0.7]
    return docs, labels, good


def scored(spark, docs, labels, path):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame.repartition(2).write.parquet(f"{path}/labels.parquet")
    return queries.QUERIES["op11_random_indexing"](spark, str(path)).collect()


def area(scores, good):
    """Chance that a good document scores above a bad one."""
    a = np.array([s for s, g in zip(scores, good, strict=True) if g])
    b = np.array([s for s, g in zip(scores, good, strict=True) if not g])
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean())


def test_held_out_documents_are_told_apart(spark, tmp_path):
    docs, labels, good = corpus()
    extra = [(5000, None, "", 0.0, 0), (5001, "", "", 0.0, 0), (None, docs[0][1], "", 0.0, 0), docs[0]]
    extra += [(5002, docs[0][1], "", 0.0, 0), (5003, "an er " * 60_000, "", 0.0, 0), (5004, "x" * 200_000, "", 0.0, 0)]
    odd = [(None, 0, 0), (3, None, 1), labels[0], (9999, 0, 0)]
    rows = scored(spark, docs + extra, labels + odd, tmp_path)
    assert len(rows) == len(docs) + len(extra)
    by_id = {r.doc_id: r for r in rows}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(key.encode()) % 5 == 0)
    assert by_id[5000].score == by_id[5001].score
    assert by_id[5002].score == by_id[None].score == by_id[0].score
    held = [i for i in range(len(docs)) if by_id[i].held_out]
    assert area([by_id[i].score for i in held], [good[i] for i in held]) > 0.97
    chances = np.array([by_id[i].score for i in held])
    truth = np.array([good[i] for i in held], float)
    assert abs(chances.mean() - truth.mean()) < 0.08
    assert np.mean((chances - truth) ** 2) < 0.06


def test_labels_of_held_out_rows_do_not_matter(spark, tmp_path):
    docs, labels, _ = corpus(200, 4)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    assert turned != labels
    first = scored(spark, docs, labels, tmp_path / "a")
    second = scored(spark, docs, turned[::-1], tmp_path / "b")
    assert sorted((r.doc_id, r.score) for r in first) == sorted((r.doc_id, r.score) for r in second)


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(1, 1, 0), (2, 1, 0)], 0.75)])
def test_few_labels(spark, tmp_path, labels, want):
    rows = scored(spark, [(1, "a b", "", 0.0, 0), (2, "c", "", 0.0, 0), (3, None, "", 0.0, 0)], labels, tmp_path)
    assert [r.score for r in rows] == [want] * 3


def test_empty_table(spark, tmp_path):
    assert scored(spark, [], [(1, 1, 0)], tmp_path) == []


def test_context_sums_against_plain_loops(spark):
    texts = ["a b c a", None, "", "d a ## b", "c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(2)
    index, want, slots = m.index_vectors().astype(int), {}, m._Slots()
    for t in texts:
        words = [s for w in (t or "").split() for s in slots[w]]
        for i, w in enumerate(words):
            n, v = want.get(w, (0, 0))
            near = [words[j] for j in range(max(0, i - 2), min(len(words), i + 3)) if j != i]
            want[w] = n + 1, v + sum((index[j] for j in near), np.zeros(m.DIM, int))
    got = {r.slot: (r.n, [r[f"v{i}"] for i in range(m.DIM)]) for r in m.context_sums(m.slot_table(frame)).collect()}
    assert got == {w: (n, v.tolist()) for w, (n, v) in want.items()}


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 10))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    model = m.fit(x, y, np.arange(4000))
    fresh = rng.normal(size=(4000, 10))
    chance = 1 / (1 + np.exp(-2 * fresh[:, 0]))
    assert np.mean(np.abs(model.scores(fresh) - chance)) < 0.08


def test_fit_does_not_depend_on_row_order():
    rng = np.random.default_rng(1)
    x, y, order = rng.normal(size=(300, 6)), rng.integers(0, 2, 300), np.arange(300)
    deal = rng.permutation(300)
    a, b = m.fit(x, y, order), m.fit(x[deal], y[deal], order[deal])
    assert np.array_equal(a.scores(x), b.scores(x))
