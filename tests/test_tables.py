import random

from pyspark.sql import functions as F

from curricle.operators import feedback as fb
from curricle.operators import insights as ins
from curricle.operators import ranking as rk
from curricle.operators import runs as ru
from curricle.operators import syllabus as sy
from curricle.operators.curriculum import normalize_weights


def lines(spark, texts):
    return spark.createDataFrame([("d", 1, i, t) for i, t in enumerate(texts)], "doc_id string, page long, line_no long, raw_line string")


def test_roadmap_weights(spark):
    lectures = [4, 5, 4, 8, 9, 7]
    texts = ["before", "강의 구성 로드맵", "챕터 주제 강수"]
    for i, n in enumerate(lectures, 1):
        texts += [f"Chapter {i} Topic{chr(64 + i)} 기초 {i}~{i + 1}주", f"차 총 {n}강"]
    texts += ["챕터별 강의 세부 계획", "Chapter 9 ignored 3강"]
    roadmap = sy.roadmap_sections(lines(spark, texts))
    done = sorted(sy.postprocess_sections(roadmap).collect(), key=lambda r: r["section_ord"])
    assert [r["target_weight"] for r in done] == [10.81, 13.51, 10.81, 21.62, 24.32, 18.93]
    assert done[0]["title"] == "Chapter 1: TopicA" and done[0]["confidence"] == 0.88
    assert {r["weight_status"] for r in done} == {"derivable"}


def test_no_roadmap_without_its_hint(spark):
    assert sy.roadmap_sections(lines(spark, ["Chapter 1 A 3강", "Chapter 2 B 3강"])).count() == 0


def test_timetable(spark):
    texts = ["월 화 수 목 금 토 일"] + [t for w in range(1, 5) for t in (f"{w}주 3/{w}", "오전  통계  파이썬  3/1", "오후  머신러닝  통계")]
    got = sorted(sy.schedule_sections(lines(spark, texts)).collect(), key=lambda r: r["section_ord"])
    assert [(r["title"], r["raw_weight"]) for r in got] == [("통계", 8.0), ("파이썬", 4.0), ("머신러닝", 4.0)]


def test_weights_sum_to_hundred(spark):
    rows = [("a", i, w) for i, w in enumerate([1.0, 1.0, 1.0])] + [("b", i, 0.0) for i in range(7)]
    got = normalize_weights(spark.createDataFrame(rows, "course_id string, section_ord int, target_weight double"))
    sums = {r["course_id"]: round(r["s"], 6) for r in got.groupBy("course_id").agg(F.sum("target_weight").alias("s")).collect()}
    assert sums == {"a": 100.0, "b": 100.0}


SURVEY = [
    ["", "Materials", "", "Lecture", "", "", "", ""],
    ["", "", "", "", "", "", "", "etc"],
    ["AQ1-1 age", "AQ1-2 job", "BQ1-1. clear", "BQ1-2. useful", "BQ1-3. pace", "BQ2-1. help", "BQ2-2. room", "기타 의견"],
    ["3", "4", "5", "4", "3점", "5", "4", "the examples were helpful"],
    ["2", "4", "4", "4", "4", "5", "4", ""],
    ["1", "2", "3", "5", "x", "5", "1", "more practice time please"],
]


def survey_cells(spark):
    rows = [("s", r, c, v) for r, row in enumerate(SURVEY) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "sheet string, row_no long, col_no int, value string")


def test_survey_sheet(spark):
    cells = survey_cells(spark)
    best = fb.score_survey_sheets(cells).first()
    assert (best["header_row"], best["questions"], best["free_texts"], best["response_rows"]) == (2, 5, 1, 3)
    scores = fb.question_scores(cells, fb.survey_columns(cells), fb.score_survey_sheets(cells))
    got = sorted((r["col_no"], r["question_id"], r["label"], r["average"], r["response_count"]) for r in scores.collect())
    assert [g[1] for g in got] == ["BQ1-1", "BQ1-2", "BQ1-3", "BQ2-1", "BQ2-2"]
    assert got[0][2:] == ("clear", 4.0, 3) and got[2][2:] == ("pace", 3.5, 2)


def test_feedback_rules(spark):
    rows = [("a", 1, 0, "3주차 속도가 빠르고 실습 부족"), ("a", 1, 1, "5주차 속도 조절, 친절"), ("b", 2, 0, "alpha beta alpha")]
    responses = spark.createDataFrame(rows, "instructor string, source_id long, seq long, text string")
    labels = fb.sentiment_labels(responses)
    got = {(r["instructor"], r["polarity"], r["rank"]): r["label"] for r in labels.collect()}
    assert got[("a", "negative", 1)] == "강의 속도" and got[("a", "positive", 1)] == "실습 중심"
    assert got[("b", "positive", 1)] == "alpha" and got[("b", "negative", 2)] == "자료 부족"
    complaints = fb.complaints(responses, labels)
    rows = {(r["instructor"], r["rank"]): (r["pattern"], r["n"], r["week"]) for r in complaints.collect()}
    assert rows[("a", 1)] == ("강의 속도 조절 필요", 2, "3주차")
    assert rows[("b", 1)] == ("강의 속도 관련 피드백 반복", 1, "")
    suggested = {r["instructor"]: r["label"] for r in fb.suggestions(complaints).filter("rank = 1").collect()}
    assert suggested == {"a": "강의 속도 조절", "b": "VOC 정기 점검"}


def test_gap_total_is_capped(spark):
    rows = [("c", "a", 1, "combined", f"s{i}", i, f"t{i}", w, s) for i, (w, s) in enumerate([(100.0, 0.0), (0.0, 1.0)])]
    coverage = spark.createDataFrame(rows, "course_id string, instructor string, instructor_ord int, mode string, section_id string, section_ord int, title string, target_weight double, token_share double")
    got = ins.gap_report(coverage).collect()
    assert {r["total_gap"] for r in got} == {100.0} and {r["direction"] for r in got} == {"raise", "trim"}


def test_budget_gate_equals_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(m, i, rng.choice([0, 1, 2, 30, 59, 61, 119, 240, 600])) for m in ("x", "y") for i in range(300)]
    want = {}
    for month in ("x", "y"):
        used = 0.0
        for _, i, d in [r for r in rows if r[0] == month]:
            ok = d <= 0 or used + d / 60 <= 12
            if ok and d > 0:
                used = round(used + d / 60, 4)
            want[(month, i)] = ok
    frame = spark.createDataFrame(rows, "month string, seq long, duration_s long")
    got = {(r["month"], r["seq"]): r["accepted"] for r in ru.budget_gate(frame, 12).collect()}
    assert got == want


def test_dense_positions_and_sample(spark):
    rows = [("p", i * 7) for i in range(50)] + [("q", 3)]
    placed = rk.dense_positions(spark.createDataFrame(rows, "k string, o long"), ["k"], "o", width=10)
    assert sorted((r["o"], r["pos"]) for r in placed.filter("k = 'p'").collect()) == [(i * 7, i) for i in range(50)]
    sizes = spark.createDataFrame([("p", 50), ("q", 1)], "k string, total long")
    picked = rk.even_sample(placed, ["k"], 4, sizes).collect()
    assert sorted((r["k"], r["pos"]) for r in picked) == [("p", 0), ("p", 16), ("p", 33), ("p", 49), ("q", 0)]


def test_probe_sizes_and_stalled_runs(spark):
    counts = spark.createDataFrame([(0,), (30,), (31,), (201,)], "n long")
    assert [r["p"] for r in counts.select(ru.probe_size("n").alias("p")).collect()] == [0, 20, 3, 0]
    runs = spark.sql("SELECT 1 AS run_id, 'queued' AS status, timestamp'2024-01-01 00:00:00' AS created_at, timestamp'2024-01-01 00:00:00' AS updated_at")
    got = ru.stalled_runs(runs, F.expr("timestamp'2024-01-01 00:02:00'")).first()
    assert got["is_stalled"] is True and got["queue_wait_s"] == 120


def test_newest_course_first(spark):
    a = spark.sql("SELECT 'x' AS id, 'old' AS name, timestamp'2024-01-01' AS updated_at")
    b = spark.sql("SELECT 'y' AS id, 'new' AS name, timestamp'2024-02-01' AS updated_at UNION ALL SELECT 'x', 'shadowed', timestamp'2024-03-01'")
    assert [r["name"] for r in ru.merge_courses(a, b).collect()] == ["new", "old"]
