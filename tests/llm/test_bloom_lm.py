import bisect
import math
import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from curricle.llm import bloom_lm as m


def corpus():
    random.seed(8)
    word = lambda: "w" + str(int(random.paretovariate(0.7)) % 400)
    rows = [(i, " ".join(word() for _ in range(random.randrange(0, 60)))) for i in range(300)]
    return rows + [(400, None), (401, ""), (None, "W1 w1"), (5, rows[5][1]), (402, "w1 " * 50_000), (403, "É é")]


@pytest.mark.parametrize("head", [0, 10, 1000])
def test_base_scores_are_exact_and_model_scores_follow_the_counts(spark, head):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, rare string")
    got = m.score_documents(docs.repartition(3), head=head, bits_per_token=400, strength=50.0).collect()
    want, counts, pairs, total, tokens = plain.base_scores(rows)
    key = lambda r: (str(r[0]), r[2], r[-1])
    mine = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    level = lambda n: bisect.bisect_right(m.THRESHOLDS, n)
    low = [0, *m.THRESHOLDS]
    high = [0, *[t - 1 for t in m.THRESHOLDS[1:]]]
    scores = {}
    for doc_id, text in rows:
        w, score = tokens(text), 0.0
        for v, x in zip([b"", *w[:-1]], w, strict=True):
            alone = (low[level(counts[x])] + 0.5) / total
            score += math.log10((low[level(pairs[v, x])] + 50 * alone) / (high[level(counts[v])] + 50))
        scores[doc_id, len(w)] = score
    for r in got:
        assert math.isclose(r.score, scores[r.doc_id, r.n_tokens], rel_tol=1e-6, abs_tol=1e-6)


def test_a_full_filter_keeps_the_frequent(spark):
    keys = m.mixed(np.arange(200_000, dtype=np.uint64))
    counts = np.where(np.arange(200_000) < 1000, 50, 1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])
    (built,) = m._build_blocks(iter([batch]), 1)
    assert built.column(1)[0].as_py() > 1
    bits = np.frombuffer(built.column(2)[0].as_py(), np.uint8)
    levels = m.LogFilter(bits, 1).levels(keys)
    assert (levels[:1000] >= bisect.bisect_right(m.THRESHOLDS, 50)).all()
    assert (levels[1000:] > 0).mean() < 0.1


def test_probabilities_sum_to_one_at_most():
    random.seed(1)
    words = [random.randrange(20) for _ in range(5000)]
    from collections import Counter

    counts, pairs = Counter(words), Counter(zip(words, words[1:], strict=False))
    level = lambda n: bisect.bisect_right(m.THRESHOLDS, n)
    low, high = [0, *m.THRESHOLDS], [0, *[t - 1 for t in m.THRESHOLDS[1:]]]
    total = len(words) + 0.5 * (len(counts) + 1)
    for v in range(21):
        alone = [(low[level(counts[w])] + 0.5) / total for w in range(21)]
        after = [(low[level(pairs[v, w])] + 50 * alone[w]) / (high[level(counts[v])] + 50) for w in range(21)]
        assert sum(after) <= 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.score_documents(docs).count() == 0


def test_a_filter_that_is_not_broadcast_gives_the_same_scores(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda **k: sorted(map(str, m.score_documents(docs, bits_per_token=400, **k).collect()))
    want = found()
    monkeypatch.setattr(m, "SHELF_BLOCKS", 16)
    monkeypatch.setattr(m, "BATCH_BYTES", 2000)
    assert found(filter_bytes=1000) == want


@pytest.mark.parametrize("filter_bytes", [m.FILTER_BYTES, 1000])
def test_no_counted_n_gram_is_dropped(spark, filter_bytes):
    # no pair and few words repeat: the most that a number of tokens can put into the filter
    random.seed(5)
    rows = [(i, " ".join(f"{random.randrange(10**6):x}" for _ in range(300))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string").repartition(3)
    scores = lambda **k: {r.doc_id: (r.score, r.n_tokens) for r in m.score_documents(docs, **k).collect()}
    whole = scores(bits_per_token=400)
    got = scores(filter_bytes=filter_bytes)
    assert got.keys() == whole.keys()
    for doc_id, (score, tokens) in got.items():
        assert abs(score - whole[doc_id][0]) <= 0.1 * tokens


def test_a_shelf_that_chance_fills_is_cut_into_more_blocks_and_keeps_every_n_gram():
    keys = m.narrowed(m.mixed(np.arange(60_000, dtype=np.uint64)))
    keys = np.unique(keys[m._block_of(keys, 2) == 1])
    counts = np.where(np.arange(len(keys)) % 3, 1, 7)
    lookup = m._shelf(keys, counts, 2, 1, 1)
    assert lookup.n_blocks > 2
    least = np.searchsorted(np.array(m.THRESHOLDS), counts, side="right")
    found = lookup.levels(keys)
    assert (found >= least).all() and (found > least).mean() < 0.1


def test_keys_and_counts_travel_in_bytes_and_held_out_documents_count_nothing():
    import pyarrow as pa

    texts = [b"a b a b c", b"a b z"]
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([False, True]), pa.array(texts)], ["doc_id", "held_out", "text"])
    (sent,) = m._requests(iter([pa.RecordBatch.from_arrays([pa.array([5]), pa.array([m._packed(rows)])], ["batch", "documents"])]), 1)
    assert sent.column(0).to_pylist() == [0] and sent.column(1).to_pylist() == [5]
    keys = np.cumsum(m._unplaned(sent.column(2)[0], 6, np.uint64)) << np.uint64(16)
    counts = dict(zip(keys.tolist(), m._unplaned(sent.column(3)[0], 4, np.uint32).tolist(), strict=True))
    number = lambda *words: m.word_numbers(list(words))
    word = lambda w: counts[int(m.narrowed(m.unigram_keys(number(w)))[0])]
    pair = lambda v, w: counts[int(m.narrowed(m.bigram_keys(number(v), number(w)))[0])]
    assert [word(w) for w in (b"a", b"b", b"c", b"z", b"")] == [2, 2, 1, 0, 1]
    assert [pair(*p) for p in ((b"a", b"b"), (b"", b"a"), (b"c", b""), (b"b", b"z"))] == [2, 1, 1, 0]


def test_a_batch_that_was_answered_is_tokenised_once(monkeypatch):
    texts = [b"a b a", b"", b"B c", b"a b a c"] * 50
    rows = pa.record_batch({"doc_id": pa.array(range(len(texts))), "held_out": pa.array([False] * len(texts)), "text": pa.array(texts, pa.binary())})
    keys = m._keys_of(m._stretches(rows.column("text")))
    asked, counts = m._asked(rows.column("text"), np.zeros(len(texts), bool))
    assert keys.tolist() == asked.tolist() and counts.sum() == 2 * sum(len(m.tokens_of(text)) for text in texts)
    batches = pa.table({"batch": [0], "documents": pa.array([m._packed(rows)], pa.binary())})
    levels = (np.arange(len(keys)) % 3).astype(np.uint8).tobytes()
    replies = pa.table({"batch": [0], "shelf": [0], "levels": pa.array([levels], pa.binary())})
    seen, tokens_of = [], m.tokens_of
    monkeypatch.setattr(m, "tokens_of", lambda text: seen.append(text) or tokens_of(text))
    scored = m._score_answered(batches, replies, type("Head", (), {"value": {b"a": -1.0}}), 500.0, 1000.0)
    assert seen == texts and scored.column("n_tokens").to_pylist()[:4] == [4, 1, 3, 5]


def test_texts_reach_workers_in_small_batches_and_the_setting_is_put_back(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:") + "/rows-of-batches"
    import os

    os.makedirs(folder)
    score, batched = m._score, m._batched

    def noted(step):
        def run(batches, *more):
            def seen():
                for batch in batches:
                    open(f"{folder}/{len(batch)}", "w").close()
                    yield batch

            return step(seen(), *more)

        return run

    monkeypatch.setattr(m, "_score", noted(score))
    monkeypatch.setattr(m, "_batched", noted(batched))
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "concat('a b', id % 7) AS text")
    assert m.score_documents(docs).count() == m.score_documents(docs, filter_bytes=1000).count() == 6000
    assert 0 < max(map(int, os.listdir(folder))) <= 1000 and spark.conf.get(key) == before


def test_batches_of_documents_are_filled_over_arrow_batches(monkeypatch):
    from types import SimpleNamespace

    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(m, "BATCH_BYTES", 1000)
    rows = [(i, i % 2 == 0, b"x" * (i * 37 % 200)) for i in range(100)] + [(200, False, b"y" * 5000), *((i, True, b"") for i in range(300, 400))]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i : i + 2], strict=True)], ["doc_id", "held_out", "text"]) for i in range(0, len(rows), 2)]
    sent = list(m._batched(iter([batches[0].slice(0, 0), *batches])))
    assert [b.column(0)[0].as_py() for b in sent] == [(3 << 32) + i for i in range(len(sent))]
    documents = [m._unpacked(b.column(1)[0]) for b in sent]
    assert [tuple(r.values()) for d in documents for r in d.to_pylist()] == rows
    sizes = [sum(len(x) + 16 for x in d.column("text").to_pylist()) for d in documents]
    assert all(s >= 1000 for s in sizes[:-1]) and sorted(sizes)[-2] < 1216 and max(sizes) < 6216
