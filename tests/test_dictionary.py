import itertools
import random

import pytest

from curricle.functions import dictionary as dc


def every_cut(word, terms):
    """Least (characters outside terms, terms) over all ways to cut a word."""
    best = (len(word), 0)
    for marks in itertools.product([0, 1], repeat=max(0, len(word) - 1)):
        cuts = [0, *[i + 1 for i, m in enumerate(marks) if m], len(word)]
        parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        best = min(best, (sum(len(p) for p in parts if p not in terms), sum(p in terms for p in parts)))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_best_path_against_every_cut(seed):
    rng = random.Random(seed)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 5))) for _ in range(12)}
    trie = dc.build_trie(terms)
    for _ in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 11)))
        path = dc.best_path(word, trie)
        assert [a for a, _, _ in path] == [0, *[b for _, b, _ in path][:-1]] and path[-1][1] == len(word)
        assert all((word[a:b] in terms) == known for a, b, known in path if known)
        assert not any(not x[2] and not y[2] for x, y in zip(path, path[1:]))
        assert (sum(b - a for a, b, known in path if not known), sum(k for *_, k in path)) == every_cut(word, terms)


def test_inflected_words_are_cut_at_terms(spark):
    terms = spark.createDataFrame([("결정",), ("결정트리",), ("트리",), ("SVM",), ("가",), (None,)], "term string")
    texts = ["결정트리는 SVM을 이긴다", "결정 트리에서의 학습", "treehouse svm", None, ""]
    tokenizer = dc.dictionary_tokenizer(terms)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.t for r in frame.select("i", tokenizer("text").alias("t")).collect()}
    assert got[0] == ["결정트리", "svm", "이긴다"]
    assert got[1] == ["결정", "트리", "에서의", "학습"]
    assert got[2] == ["treehouse", "svm"]
    assert not got[3] and got[4] == []


def test_a_dictionary_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(dc, "MOST_BYTES", 3)
    with pytest.raises(ValueError):
        dc.dictionary_tokenizer(spark.createDataFrame([("tree",)], "term string"))
