import random

import numpy as np
import plain
import pytest

from curricle.llm import fm_index as m


def corpus():
    random.seed(6)
    word = lambda: random.choice("ab Cd é1 fg 7 hi jk".split()) + random.choice(["", "x", "Y"])
    items = [(i, " ".join(word() for _ in range(random.randrange(1, 40)))) for i in range(12)]
    items += [(20, None), (21, "..."), (None, items[0][1]), (22, items[1][1]), (23, "single")]
    docs = []
    for d in range(50):
        text = [word() for _ in range(random.randrange(0, 60))]
        if d % 3 == 0:
            found = items[d % 12][1].split()
            cut = random.randrange(3)
            text[4:4] = found[cut : cut + 25]
        docs.append((d, random.choice([" ", ", ", "-"]).join(text)))
    docs += [(100, None), (101, ""), (102, "?!"), (None, docs[0][1]), (3, docs[3][1]), (103, "single " * 3)]
    docs.append((104, " ".join(f"w{i % 50}" for i in range(60_000)) + " " + items[2][1]))
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"block_bytes": 120}])
def test_matches_comparing_every_window(spark, options):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, row string, spans int")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    got = m.find_contamination(frame.repartition(3), bench, **options).collect()
    mine = sorted([(r.doc_id, r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got], key=str)
    assert mine == sorted(plain.contamination(docs, items), key=str)
    texts = {r[0]: r[1] for r in docs}
    for r in got:
        spans = [s.asDict() for s in r.spans]
        left = m.remove_spans((texts[r.doc_id] or "").encode(), spans)
        assert len(m.words_of_bytes(left)) == r.n_words - r.n_hit
        assert all(a["first_word"] + a["n_words"] < b["first_word"] for a, b in zip(spans, spans[1:], strict=False))


def test_empty_tables_and_whole_rows(spark):
    frame = spark.createDataFrame([(1, "a b c", "keep")], "doc_id long, text string, contaminated string")
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    row = m.find_contamination(frame, bench, whole_rows=True).first()
    assert (row.document.contaminated, row.contaminated, row.n_hit) == ("keep", True, 2)
    assert m.find_contamination(frame, bench.limit(0)).first().n_hit == 0
    assert m.find_contamination(frame.limit(0), bench).count() == 0


def test_index_counts_and_locates_all_occurrences():
    rng = np.random.default_rng(3)
    for _ in range(20):
        text = rng.integers(0, 4, 300)
        text[-1] = 0
        index = m.FmIndex(text)
        phrases = np.full((30, 3), -1)
        for row in range(30):
            size = rng.integers(1, 4)
            phrases[row, :size] = rng.integers(1, 5, size)
        low, high = index.search(phrases)
        for row in range(30):
            phrase = [x for x in phrases[row] if x >= 0]
            want = [i for i in range(300) if text[i : i + len(phrase)].tolist() == phrase]
            assert sorted(index.locate(np.arange(low[row], high[row])).tolist()) == want
