import hashlib

import pytest
from pyspark.sql import functions as F

from curricle.llm import line_chunks as m

SCHEMA = "doc_id long, text string, chunk string, key string"


def plain_chunks(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    chunks = []
    for i, line in enumerate(lines):
        rolled = hashes[i - 1] + (m.BASE * hashes[i - 2] if i > 1 else 0) if i else 0
        if i == 0 or rolled % m.MODULUS % m.DIVISOR == 0:
            chunks.append([])
        chunks[-1].append(line)
    return chunks


def plain_dedup(rows):
    """Brute force: texts without later copies of chunks."""
    first = {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for number, chunk in enumerate(plain_chunks(text) if text else []):
            first.setdefault(tuple(chunk), (doc_id, number))
    result = []
    for doc_id, text in rows:
        if not text:
            result.append((doc_id, text, 0))
            continue
        kept, gone = [], 0
        for number, chunk in enumerate(plain_chunks(text)):
            if len(chunk) >= m.MIN_LINES and first[tuple(chunk)] != (doc_id, number):
                gone += len(chunk)
            else:
                kept.append("\n".join(chunk))
        result.append((doc_id, "\n".join(kept), gone))
    return result


def rows_of(frame):
    return sorted(((r.doc_id, r.clean_text, r.n_removed_lines) for r in frame.collect()), key=str)


def corpus():
    shared = [f"shared line {i} of the passage" for i in range(12)]
    rows = []
    for d in range(40):
        own = [f"own {d} {i}" for i in range(d % 7)]
        cut = d % 5
        rows.append((d, "\n".join(own + shared[cut:] + own[:2])))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "one"), (7, rows[7][1])]
    rows.append((None, "\n".join(shared)))
    rows.append((104, "\n".join(shared * 30)))
    return rows


@pytest.mark.parametrize("hash_bits", [64, 2])
def test_matches_plain_dedup(spark, hash_bits):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = rows_of(m.dedup_lines(docs, hash_bits=hash_bits))
    assert got == sorted(plain_dedup(rows), key=str)
    assert any(n for _, _, n in got)


def test_whole_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a\nb", "c", "k")], SCHEMA)
    row = m.dedup_lines(docs, whole_rows=True).select("document.*", "clean_text").first()
    assert (row.chunk, row.key, row.clean_text) == ("c", "k", "a\nb")
    assert m.dedup_lines(docs.limit(0)).count() == 0


def test_boundaries_survive_an_inserted_line(spark):
    lines = [f"line number {i}" for i in range(200)]
    texts = ["\n".join(lines), "\n".join(lines[:50] + ["inserted"] + lines[50:])]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    chunks = m.line_chunks(docs, "doc_id", "text").groupBy("chunk_text").agg(F.count("*").alias("n"))
    alone = chunks.filter("n = 1").count()
    assert alone <= 6 < chunks.filter("n = 2").count()
