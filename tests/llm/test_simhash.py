import random

import plain
import pytest
from pyspark.sql import functions as F

from curricle.llm import components, simhash as m


def corpus():
    random.seed(9)
    texts = []
    for d in range(60):
        words = [random.choice("abcdefgh") + str(random.randrange(30)) for _ in range(80)]
        texts.append(" ".join(words))
        for _ in range(d % 4):
            near = list(words)
            near[random.randrange(80)] = "changed"
            texts.append(" ".join(near))
    texts += [None, "", " \n", "one", "One two", texts[0], texts[0].upper(), "x " * 30_000]
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (2, texts[2])]


@pytest.mark.parametrize("limit", [1024, 2])
def test_matches_all_pairs(spark, limit):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, root int")
    got = sorted(map(tuple, m.near_duplicates(docs.repartition(3), limit=limit).collect()), key=str)
    assert got == sorted(plain.classes([(i, plain.fingerprint(t)) for i, t in rows]), key=str)


@pytest.mark.parametrize("limit", [1024, 40])
def test_large_families_of_close_fingerprints(spark, limit):
    random.seed(1)
    prints = set()
    for _ in range(3):
        centre = random.getrandbits(64)
        for _ in range(250):
            prints.add(centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    at = random.getrandbits(64)
    for _ in range(60):
        at ^= 1 << random.randrange(64) | 1 << random.randrange(64)
        prints.add(at)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fp long").repartition(4)
    roots = components.connected_components(m.near_links(frame, limit))
    joined = frame.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    got = joined.select("fp", F.coalesce("root", "fp").alias("root")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.fp & (1 << 64) - 1)
    want = {}
    for p, _, least in plain.classes([(p, p) for p in sorted(prints)]):
        want.setdefault(least, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.near_duplicates(docs).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6)]
    roots = components.connected_components(spark.createDataFrame(links, "a long, b long"))
    got = {r.node: r.root for r in roots.collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
