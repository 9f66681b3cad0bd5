import random
from collections import Counter

import pytest

from curricle.llm import super_kmers as m


def plain(rows, window):
    """Brute force: every window of every text counted by its words."""
    seen = Counter()
    for _, text in rows:
        words = (text or "").encode().split()
        seen.update(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    result = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
        result.append((doc_id, len(words), len(gone), kept))
    return sorted(result, key=str)


def corpus():
    random.seed(5)
    word = lambda: random.choice("ab cde fgh ijk lmn opq é".split()) + str(random.randrange(40))
    passage = [word() for _ in range(90)]
    rows = []
    for d in range(60):
        words = [word() for _ in range(random.randrange(0, 120))]
        if d % 2:
            cut = random.randrange(20)
            words[5:5] = passage[cut : cut + random.randrange(30, 70)]
        rows.append((d, " ".join(words)))
    rows += [(200 + k, " ".join(passage)) for k in range(25)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "a " * 400), (None, " ".join(passage)), (5, rows[5][1])]
    rows += [(304, "A\x0bB\x0cC" * 50), (305, "x" * 100_000)]
    # texts whose repeats lie inside one super-k-mer
    rows += [(306, "b " * 36), (307, "lone c d e " * 13), (308, "f g " * 18 + "end"), (309, "h " * 34 + "i")]
    return rows


@pytest.mark.parametrize(("window", "hot_from"), [(35, 5000), (35, 3), (3, 4), (8, 5000)])
def test_matches_counting_every_window(spark, window, hot_from):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, mini int, key string")
    got = m.dedup_substrings(docs.repartition(3), window=window, hot_from=hot_from)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, window)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.dedup_substrings(docs).count() == 0
