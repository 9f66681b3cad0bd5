from pyspark.sql import functions as F

from curricle.operators import coverage as co
from curricle.operators import curriculum as cu
from curricle.operators import matching as ma
from curricle.functions.tokens import tokenize

SECTIONS = [
    ("c", 1, "s1", "Decision Tree", "entropy and information gain", 50.0),
    ("c", 2, "s2", "Support Vector Machine SVM", "kernel trick and margin", 30.0),
    ("c", 3, "s3", "Neural Networks", "backpropagation of errors", 20.0),
]
DDL = "course_id string, section_ord int, section_id string, title string, description string, target_weight double"


def profiles(spark):
    return cu.course_profiles(cu.describe_sections(spark.createDataFrame(SECTIONS, DDL)))


def chunk_rows(spark, rows):
    frame = spark.createDataFrame(
        [("c", "a", i, kind, label, "l", 0, 0, text) for i, (kind, label, text) in enumerate(rows)],
        "course_id string, instructor string, source_id long, source_type string, source_label string, locator string, chunk_seq long, part_no int, text string",
    )
    return frame.withColumn("tokens", tokenize("text")).withColumn("token_count", F.greatest(F.lit(1), F.size("tokens")))


def assigned(spark, rows, **options):
    got = ma.assign_chunks(chunk_rows(spark, rows), profiles(spark), **options)
    return {r["source_id"]: r for r in got.collect()}


def rescue(spark, scores, titles, anchors, thresholds=(0.23, 0.025)):
    frame = spark.createDataFrame(
        [(scores, titles, [(n,) for n in anchors])], "scores array<double>, title_scores array<double>, facts array<struct<anchors:int>>"
    )
    rule = ma._rescue_rule("scores", "title_scores", "facts", thresholds)
    return frame.select(F.expr(rule).alias("r")).first()["r"]


def test_material_needs_an_anchor(spark):
    got = assigned(spark, [
        ("pdf", "d", "decision tree with entropy"),
        ("pdf", "d", "of weather and football today"),
        ("csv", "d", "backpropagation errors in neural networks"),
    ])
    assert [got[i]["section_id"] for i in range(3)] == ["s1", None, "s3"]


def test_anchor_respects_token_borders(spark):
    chunks = chunk_rows(spark, [("pdf", "d", "indecision treehouse decision tree decision tree")])
    hits = {(r["section_id"], r["anchor"]): r["n"] for r in ma.anchor_counts(chunks, profiles(spark)).collect()}
    assert hits[("s1", "decision tree")] == 2


def test_speech_is_rescued_by_its_title_or_stays_unmapped(spark):
    got = assigned(spark, [
        ("youtube", "[2-1] Support Vector Machine", "the svm kernel trick margin"),
        ("youtube", "[9-1] Holidays", "we went to the beach and swam"),
    ])
    assert got[0]["section_id"] == "s2" and got[1]["section_id"] is None


def test_labels_table_and_inline_labels_agree(spark):
    rows = [("youtube", "[1-1] Decision Tree", "entropy tree gain entropy"), ("youtube", "[3-1] x", "neural errors")]
    chunks = chunk_rows(spark, rows)
    a = ma.assign_chunks(chunks, profiles(spark)).select("source_id", "section_id", "score").collect()
    b = ma.assign_chunks(chunks, profiles(spark), labels=chunks).select("source_id", "section_id", "score").collect()
    assert sorted(a) == sorted(b)


def test_near_tie_goes_to_the_title(spark):
    got = rescue(spark, [0.2597, 0.2496], [0.0, 1.1], [0, 0])
    assert got["pos"] == 1 and got["mismatch"] is False


def test_mismatch_only_warns(spark):
    got = rescue(spark, [0.2924, 0.2461], [0.0, 1.1], [0, 0])
    assert got["pos"] is None and got["mismatch"] is True


def test_anchor_evidence_rescues(spark):
    assert rescue(spark, [0.2559, 0.19], [0.0, 1.1], [0, 2])["pos"] == 1


def test_outside_verdict_settles_ambiguous_speech(spark):
    text = "entropy decision tree " * 5 + "svm support vector kernel trick " * 4
    rows = [("youtube", "talk", text)]
    verdict = spark.createDataFrame([("c", 0, 0, 0, "s2", "High")], "course_id string, source_id long, chunk_seq long, part_no int, section_id string, confidence string")
    plain = assigned(spark, rows)[0]
    judged = assigned(spark, rows, adjudications=verdict)[0]
    assert judged["section_id"] == ("s2" if plain["section_id"] is None else plain["section_id"])


def test_vector_thresholds(spark):
    chunks = chunk_rows(spark, [("csv", "d", "x")])
    scores = spark.createDataFrame([("c", 0, 0, 0, [0.30, 0.28, 0.0]), ], "course_id string, source_id long, chunk_seq long, part_no int, scores array<double>")
    assert ma.assign_chunks(chunks, profiles(spark), scores).first()["section_id"] is None


def test_shares_cover_mapped_tokens_only(spark):
    rows = spark.createDataFrame(
        [("c", "a", "pdf", "s1", 30), ("c", "a", "pdf", None, 50), ("c", "a", "youtube", "s2", 10), ("c", "b", "csv", None, 5)],
        "course_id string, instructor string, source_type string, section_id string, token_count int",
    )
    lanes = spark.createDataFrame([("c", "a", 1), ("c", "b", 2)], "course_id string, instructor string, instructor_ord int")
    grid = co.coverage_grid(lanes, spark.createDataFrame(SECTIONS, DDL), co.token_aggregates(rows))
    got = {(r["mode"], r["instructor"], r["section_id"]): r for r in co.instructor_coverage(grid).collect()}
    assert len(got) == 18
    assert got[("combined", "a", "s1")]["token_share"] == 0.75
    assert got[("combined", "a", "s1")]["deviation"] == 0.375
    assert got[("speech", "a", "s2")]["token_share"] == 1.0
    assert got[("combined", "b", "s1")]["token_share"] == 0.0
    assert got[("combined", "a", "s1")]["unmapped_share"] == 50 / 90


def test_mode_is_available_without_mapped_tokens(spark):
    stats = spark.createDataFrame([("c", "speech", 1, 9, 0), ("c", "material", 0, 9, 9)], "course_id string, mode string, asset_count long, total_tokens long, mapped_tokens long")
    assert [r["mode"] for r in co.available_modes(stats).collect()] == ["speech"]


def test_shuffled_chunks_carry_no_profile(spark):
    chunks = chunk_rows(spark, [("youtube", "[1-1] Decision Tree", "entropy tree gain entropy"), ("pdf", "d", "decision tree")])
    scores = spark.createDataFrame([("c", 0, [0.9, 0.1, 0.0])], "course_id string, source_id long, scores array<double>")
    verdicts = chunks.select("course_id", "source_id", "chunk_seq", "part_no", F.lit("s1").alias("section_id"), F.lit("high").alias("confidence"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for options in ({}, {"vector_scores": scores}, {"adjudications": verdicts}):
            plan = ma.assign_chunks(chunks, profiles(spark), labels=chunks, **options)._jdf.queryExecution().optimizedPlan()
            text = plan.toString()
            joins = [line for line in text.splitlines() if "Join LeftOuter" in line]
            # the profiles' join is the outermost one: all others lie below it, indented further
            assert "course_id" in joins[0] and " AND " not in joins[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_restriction_inside_the_row_equals_the_joined_one(spark):
    texts = ["decision tree with entropy", "weather", "svm kernel margin decision tree", "neural networks errors errors"]
    chunks = chunk_rows(spark, [("pdf", "d", t) for t in texts])
    found = ma.anchor_counts(chunks, profiles(spark))
    joined = ma.restrict(ma.score_lexical(chunks, profiles(spark)), ma.material_candidates(found))
    columns = ["source_id", "section_ord", "section_id", "score"]
    want = sorted(map(tuple, joined.select(*columns).collect()))
    got = ma.restrict_lexical(chunks, profiles(spark)).select(*columns).collect()
    assert sorted(map(tuple, got)) == want and len({r["score"] for r in got}) > 2


def test_the_best_section_is_found_in_the_row_without_a_shuffle(spark):
    chunks = chunk_rows(spark, [
        ("pdf", "d", "decision tree with entropy and information gain"),
        ("youtube", "v", "kernel trick and margin of the svm"),
        ("csv", "t", "weather and football"),
    ])
    want = ma.best_assignment(ma.score_lexical(chunks, profiles(spark)), 0.2, 0.02)
    got = ma.best_lexical(chunks, profiles(spark), (0.2, 0.02))
    key = ["course_id", "source_id", "chunk_seq", "part_no", "section_id", "score", "runner_up"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert {r["section_id"] for r in got.collect()} == {"s1", "s2", None}


def test_rescued_chunks_meet_titles_before_profiles(spark):
    chunks = chunk_rows(spark, [("youtube", "[1-1] Decision Tree", "entropy tree gain entropy")])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = ma.title_rescue(chunks, profiles(spark), labels=chunks)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    joins = [line for line in text.splitlines() if "Join LeftOuter" in line]
    # a join by label above the profiles' would gather profiles with all chunks of a label in one task
    assert " AND " not in joins[0] and any("source_label" in line for line in joins[1:])


def test_coverage_reads_its_assignments_once(spark):
    chunks = chunk_rows(spark, [("youtube", "[1-1] Decision Tree", "entropy tree gain entropy"), ("pdf", "d", "decision tree")])
    assigned = ma.assign_chunks(chunks, profiles(spark), labels=chunks).withColumn("instructor", F.lit("a"))
    lanes = spark.createDataFrame([("c", "a", 1)], "course_id string, instructor string, instructor_ord int")
    dims = spark.createDataFrame([("c", 1, "s1", "t", 100.0)], "course_id string, section_ord int, section_id string, title string, target_weight double")
    shares = co.instructor_coverage(co.coverage_grid(lanes, dims, co.token_aggregates(assigned)))
    for frame in (shares, co.mode_series(shares), co.average_series(shares)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        # chunks are exploded to their choice once: shares and means come from the same grid
        assert plan.count("explode(array(if (isnull(late") == 1, plan


def test_cards_make_their_chunks_once(spark, monkeypatch):
    from curricle.plans import all_queries, views
    from curricle.plans.registry import QUERIES

    all_queries()
    made, build = [], views.build_chunks
    monkeypatch.setattr(views, "build_chunks", lambda segments: made.append(segments) or build(segments))
    cards = QUERIES["ins_cards"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and cards.columns
