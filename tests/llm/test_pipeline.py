import random

import plain

import corpus_pipeline


def test_equals_plain_stages(spark, tmp_path):
    random.seed(12)
    word = lambda: random.choice("aeiou") + random.choice("bcdfg") + str(random.randrange(60))
    line = lambda: " ".join(word() for _ in range(random.randrange(4, 12)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(4)]
    shared = [line() for _ in range(8)]
    rows = []
    for d in range(80):
        lines = [line() for _ in range(random.randrange(1, 8))]
        if d % 6 == 0:
            lines += shared[d % 3 :]
        if d % 7 == 0:
            lines.append(items[d % 4][1])
        rows.append((d, "\n".join(lines)))
    rows += [(100 + d, rows[d][1]) for d in range(5)]
    rows += [(110, rows[3][1].replace(" ", "  ")), (111, None), (112, ""), (113, "spam " * 60), (114, "## " * 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t in rows if not plain.quality(t)[1]]
    left = [(i, t) for i, t, gone in plain.dedup_lines(left) if not (gone and not t.strip(" "))]
    groups = plain.classes([(i, plain.fingerprint(t)) for i, t in left])
    kept = {i for i, _, least in groups if i == least}
    left = [(i, t) for i, t in left if i in kept]
    clean = {r[0] for r in plain.contamination(left, items) if not r[4]}
    left = [(i, t) for i, t in left if i in clean]
    want = sorted((i, len(plain.encode(t)[0]), plain.sha(",".join(map(str, plain.encode(t)[0]))), plain.sha(t)) for i, t in left)
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert got == want
    assert 20 < len(got) < len(rows) - 10


def test_stages_keep_the_columns_and_survive_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
