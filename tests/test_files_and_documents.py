import json
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from curricle.operators import feedback as fb
from curricle.operators import matching as ma
from curricle.sources import run_documents as rd
from curricle.sources import segments as sg
from curricle.streaming.runlog import Folder

SCHEMAS = {"sections": "ord: int, title: string", "shares": "who: string, share: double", "none": "x: int"}


def series(spark, runs, scale=1.0):
    return {
        "sections": spark.createDataFrame([(r, i, f'"t" {i}é') for r in runs for i in range(12)], "run_id string, ord int, title string"),
        "shares": spark.createDataFrame([(r, w, scale * i if i else None) for r in runs for i, w in enumerate("abc")], "run_id string, who string, share double"),
        "none": spark.createDataFrame([], "run_id string, x int"),
    }


def read(spark, path):
    found = rd.read_run_documents(spark, path, SCHEMAS)
    return {name: sorted(map(tuple, f.collect()), key=str) for name, f in found.items()}


def test_one_document_a_run_reads_back_as_its_series(spark, tmp_path):
    path, runs = str(tmp_path / "docs"), ["r1", "r/2 ä", "r3"]
    rd.write_run_documents(series(spark, runs), path)
    want = {name: sorted(map(tuple, f.collect()), key=str) for name, f in series(spark, runs).items()}
    assert read(spark, path) == want
    documents = spark.read.format(rd.FORMAT).option("path", path).load().collect()
    assert sorted(d.run_id for d in documents) == sorted(runs)
    whole = json.loads(next(d.document for d in documents if d.run_id == "r3"))
    assert list(whole) == ["run_id", *SCHEMAS] and [s["ord"] for s in whole["sections"]] == list(range(12))
    # later documents replace those of their runs, overwriting replaces all
    rd.write_run_documents(series(spark, ["r3", "r4"], 2.0), path)
    shares = {(r[0], r[1]): r[2] for r in read(spark, path)["shares"]}
    assert (shares["r1", "c"], shares["r3", "c"], shares["r4", "c"]) == (2.0, 4.0, 4.0)
    rd.write_run_documents(series(spark, ["r4"]), path, mode="overwrite")
    assert {r[0] for r in read(spark, path)["sections"]} == {"r4"}


def test_failed_jobs_and_repeated_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "docs")
    rd.write_run_documents(series(spark, ["r1"]), path)
    before = read(spark, path)
    broken = series(spark, ["r1", "r2"], 5.0)
    broken["shares"] = broken["shares"].withColumn("share", F.when(F.col("run_id") == "r2", F.raise_error(F.lit("lost"))).otherwise(F.col("share")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        rd.write_run_documents(broken, path)
    assert read(spark, path) == before
    # two attempts of one task write; only the one that is committed is seen
    writer = rd.RunDocumentWriter(path, ["a", "b"], False)
    rows = [Row(run_id="t", series="b", ord=i, item=json.dumps({"x": i})) for i in range(3)]
    writer.write(iter(rows[:1]))
    second = writer.write(iter(rows))
    seen = lambda: {d.run_id: d.document for d in spark.read.format(rd.FORMAT).option("path", path).load().collect()}
    assert "t" not in seen()
    writer.commit([second, None])
    assert json.loads(seen()["t"]) == {"run_id": "t", "a": [], "b": [{"x": 0}, {"x": 1}, {"x": 2}]}
    with pytest.raises(ValueError):
        rd.RunDocumentWriter(path, ["a"], False).write(iter(rows))


def test_text_files(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "files"))
    for name, content in [("a.txt", "one\n two ".encode()), ("b/c.md", b"\xff\xfeok"), ("blank.txt", b" \n"), ("empty.txt", b"")]:
        folder.write(name, content)
    names = ["a.txt", "b/c.md", "blank.txt", "empty.txt", "gone.txt"]
    expected = spark.createDataFrame([(folder.qualified(n),) for n in names], "path string")
    files = sg.read_text_files(spark, folder.path, expected)
    got = {r.path.rsplit("/files/")[-1]: (r.text, r.warning) for r in sg.segments_from_text(files).collect()}
    assert got["a.txt"] == ("one two", None)
    assert got["b/c.md"] == ("ok", "text: bytes that are no UTF-8 were left out")
    assert got["blank.txt"] == ("", "text: the file is empty")
    assert got["empty.txt"] == got["gone.txt"] == ("", "text: the file has no content or is gone")
    assert sg.read_text_files(spark, folder.path).count() in (3, 4)
    # a file that goes between planning and reading
    late = sg.read_text_files(spark, folder.path, expected)
    folder.remove("a.txt")
    assert {r.path.rsplit("/files/")[-1]: r.warning for r in late.collect()}["a.txt"] == "text: the file has no content or is gone"


def sheet(file_id, name, header, rows):
    cells = [(file_id, name, 0, c, h) for c, h in enumerate(header)]
    return cells + [(file_id, name, i + 1, c, x) for i, row in enumerate(rows) for c, x in enumerate(row)]


def test_survey_cascade(spark):
    rated = [[str(i % 5 + 1), f"the lecture number {i} was clear"] for i in range(6)]
    survey = ["BQ1-1. clear", "comment"]
    said = [[f"week {i}", f"the lecture number {i} was clear"] for i in range(6)]
    cells = (
        sheet("csv survey", "csv", survey, rated) + sheet("csv rows", "csv", ["a", "b"], said)
        + sheet("two", "s1", survey, rated) + sheet("two", "s2", ["x"], [["1"], ["2"]])
        + sheet("same", "s1", survey, rated) + sheet("same", "s2", survey, rated)
        + sheet("answers", "s1", ["week", "comment"], said) + sheet("answers", "s2", ["n"], [["1"], ["2"]])
        + sheet("numbers", "s1", ["n"], [["1"], ["2"]])
    )
    kinds = [("csv survey", "survey_csv"), ("csv rows", "survey_csv"), ("note", "text"), ("none", "survey_sheets")]
    kinds += [(x, "survey_sheets") for x in ("two", "same", "answers", "numbers")]
    table = spark.createDataFrame(cells, "file_id string, sheet string, row_no long, col_no long, value string")
    routes = fb.route_survey_files(spark.createDataFrame(kinds, "file_id string, kind string"), table)
    got = {r.file_id: (r.reading, r.sheet) for r in routes.collect()}
    assert got == {
        "csv survey": ("survey", "csv"), "csv rows": ("rows", None), "note": ("plain", None), "two": ("survey", "s1"),
        "same": (None, None), "answers": ("responses", "s1"), "numbers": (None, None), "none": (None, None),
    }
    assert {r.file_id for r in routes.collect() if r.warning} == {"same", "numbers", "none"}
    plain = spark.createDataFrame([("note", "full", "hello"), ("same", "full", "no")], "file_id string, locator string, text string")
    texts = {}
    for r in fb.routed_segments(routes, table, plain).collect():
        texts.setdefault((r.file_id, r.reading), []).append((r.locator, r.text))
    assert {k: len(x) for k, x in texts.items()} == {
        ("csv survey", "survey"): 6, ("two", "survey"): 6, ("answers", "responses"): 6, ("csv rows", "rows"): 6, ("note", "plain"): 1,
    }
    assert min(texts["two", "survey"]) == ("s1.row.1", "comment: the lecture number 0 was clear")
    assert min(texts["csv rows", "rows"]) == ("row.1", "a: week 0 | b: the lecture number 0 was clear")


def test_vector_scores_against_plain_cosines(spark, monkeypatch):
    monkeypatch.setattr(ma, "VECTOR_BLOCK", 16)
    rng = np.random.default_rng(1)
    chunks = [("c1" if i % 4 else "c2", i, rng.normal(size=24).tolist()) for i in range(150)]
    chunks += [("c1", 900, [0.0] * 24), ("c1", 901, None), ("c3", 902, [1.0] * 24), ("c1", 903, [1.0])]
    sections = [(c, j, f"s{j}", rng.normal(size=24).tolist()) for c in ("c1", "c2") for j in range(37)]
    a = spark.createDataFrame(chunks, "course_id string, source_id long, vector array<double>").repartition(3)
    b = spark.createDataFrame(sections, "course_id string, section_ord int, section_id string, vector array<double>")
    got = {(r.source_id, r.section_ord): r.score for r in ma.score_vectors(a, b).collect()}
    assert got.pop((902, None)) is None
    for (i, j), score in got.items():
        course, _, v = next(x for x in chunks if x[1] == i)
        w = np.array(next(s[3] for s in sections if s[:2] == (course, j)))
        v = np.zeros(24) if v is None else np.concatenate([v, np.zeros(24 - len(v))])
        n = np.linalg.norm(v) * np.linalg.norm(w)
        assert abs(score - (max(0.0, v @ w / n) if n else 0.0)) < 1e-12
    assert len(got) == 153 * 37


def test_long_vectors_many_sections(spark):
    rng = random.Random(2)
    chunks = spark.createDataFrame([("c", i, [rng.random() for _ in range(1536)]) for i in range(40)], "course_id string, source_id long, vector array<float>")
    sections = spark.createDataFrame([("c", j, f"s{j}", [rng.random() for _ in range(1536)]) for j in range(500)], "course_id string, section_ord int, section_id string, vector array<float>")
    rows = ma.vector_score_rows(chunks, sections).collect()
    assert len(rows) == 40 and {len(r.scores) for r in rows} == {500}


def test_counts_from_stored_facts_equal_those_from_cells(spark):
    values = [("0", "comment"), ("1", "the lecture was clear"), ("2", " \t"), ("3", ""), ("4", "3"), ("5", "x" * 9), ("6", None)]
    rows = [("s", int(r), 0, v) for r, v in values] + [("s", int(r), 1, "5") for r, _ in values[1:4]]
    cells = spark.createDataFrame(rows, "sheet string, row_no long, col_no int, value string")
    facts = fb.cell_facts(cells)
    assert {r.value for r in facts.filter("row_no > 4").collect()} == {None}
    columns = spark.createDataFrame([("s", 0, "comment", 1, 0)], "sheet string, col_no int, header string, first_row long, priority int")
    made = fb.response_segments(cells, columns)
    assert sorted(r.row_no for r in fb.response_rows(facts, columns).collect()) == sorted(r.row_no for r in made.collect()) == [1, 4, 5]
    assert fb.skipped_rows(facts, fb.response_rows(facts, columns), columns).collect() == fb.skipped_rows(cells, made, columns).collect()
