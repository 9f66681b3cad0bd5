import hashlib
import random
import re
import zlib

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from curricle.llm import periodic_runs as m
from curricle.llm import queries
from curricle.llm.frames import words_of


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if w[q:] == w[:-q])


def plain_runs(w, least=6):
    """Every period, every maximal stretch, by comparing words."""
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            size = e + q - i
            if size >= max(least, 4 * q) and smallest_period(w[i : e + q]) == q:
                found.add((i, size, q))
            i = e
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def expected(doc_id, text):
    w = plain.words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, runs and 1000 * best[1] // best[2] or None,
        sha(listed), sha(collapsed(w, runs)),
    )


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return " ".join(b[:n])


def texts():
    random.seed(3)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3, "a a b " * 5]
    out += [fibonacci(300), " ".join(bin(i).count("1") % 2 and "x" or "y" for i in range(512))]
    for _ in range(250):
        w = []
        while len(w) < random.choice([20, 90, 300]):
            unit = [random.choice("abcd") for _ in range(random.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31]))]
            size = random.randrange(1, 6 * len(unit))
            w += (unit * 6)[:size]
            if random.random() < 0.3:
                w = (w * random.choice([2, 4, 5]))[:700]
        out.append(" ".join(w))
    line = " ".join(f"w{i}" for i in range(130))
    out += [f"start {line} " * 3, f"{line}\n" * 9 + "end", (f"{line}\n" * 5 + "x ") * 5]
    out += ["é ü z " * 7, "x\x1cy " * 8, "z " * 2_000]
    return out


@pytest.mark.parametrize("alphabet", [1, 2, 3])
def test_kernel_against_all_periods(alphabet):
    rng = random.Random(alphabet)
    rows = [[rng.randrange(alphabet) for _ in range(rng.randrange(90))] for _ in range(150)]
    x, lengths = [], []
    for k, row in enumerate(rows):
        x += [*row, 1000 + k]
        lengths.append(len(row) + 1)
    found = sorted(m.word_runs(np.array(x), np.array(lengths)))
    want, at = [], 0
    for row, size in zip(rows, lengths, strict=True):
        want += [(at + s, at + s + n, q) for s, n, q in plain_runs(row, 1)]
        at += size
    assert found == sorted(want)


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(None, "a b " * 9), (None, None), (3, "a " * 6), rows[20], rows[20]]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None) > 10
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, words string, n long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_sync_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)


def test_operator_returns_runs_and_text(spark):
    docs = spark.createDataFrame([("k", "a b a b a b a b c"), ("e", None)], "key string, text string")
    found = m.find_runs(docs, words_of(F.col("text")), "key").collect()
    assert [(r.key, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found] == [
        ("k", 9, [(0, 8, 2)], "a b c"), ("e", 0, [], "")]


def test_null_words_and_lists(spark):
    frame = spark.createDataFrame([(1, None), (2, ["a", None] * 4)], "doc_id long, w array<string>")
    found = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in m.find_runs(frame, F.col("w")).collect()}
    assert found == {1: (0, [], ""), 2: (8, [(0, 8, 2)], "a ")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.run_digests(m.find_runs(docs, words_of(F.col("text")))).collect() == []


def test_long_text_in_time(spark):
    rng = np.random.default_rng(1)
    w = [f"w{i}" for i in rng.integers(0, 5000, 400_000)]
    w[1000:301_000] = w[1000:31_000] * 10
    docs = spark.createDataFrame([(1, " ".join(w))], "doc_id long, text string")
    row = m.run_digests(m.find_runs(docs, words_of(F.col("text")))).first()
    assert (row.start, row.length, row.period) == (1000, 300_000, 30_000)
    assert re.fullmatch("[0-9a-f]{64}", row.collapsed_sha256)
