"""Survey sheets and feedback texts.

Sheets are long cell tables (``sheet, row_no, col_no, value``).  Profiles are
aggregates per column or per row, so a sheet of any size is spread.  Hints and rules
about feedback texts are tables of any length, matched in one pass over each text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import any_contained, sql_text, sql_texts
from curricle.functions.needles import needle_groups
from curricle.functions.text import (
    extract_week,
    is_free_text_header,
    normalize_text,
    question_id,
    question_parts,
    value_facts,
)
from curricle.functions.tokens import tokenize
from curricle.operators.coverage import aggregate_scores, group_scores
from curricle.operators.ranking import select_with_margin
from curricle.operators.scale import top_rows
from curricle.sources.segments import ordered_join, verbalize_rows

SHEET = ("sheet",)


def cell_facts(cells: DataFrame) -> DataFrame:
    """Cells with all that counts and scores read of a value: ``chars`` and ``fact``.

    Values themselves stay only in rows that can be headers, and empty cells only there.  A
    caller may store the result and pass it wherever cells are counted; so each value is
    looked at once, however many profiles read it, and no text is read again.
    """
    if "fact" in cells.columns:
        return cells
    value = F.coalesce("value", F.lit(""))
    early = F.col("row_no") <= fv.HEADER_ROW_LAST
    return cells.filter(early | (value != "")).select(
        *[c for c in cells.columns if c != "value"],
        F.when(early, value).alias("value"),
        F.length(value).alias("chars"),
        value_facts(value).alias("fact"),
    )


def _filled(cells: DataFrame) -> DataFrame:
    return cell_facts(cells).filter(F.col("chars") > 0)


# --- plain response sheets ----------------------------------------------------
def response_columns(cells: DataFrame, keys: tuple[str, ...] = SHEET) -> DataFrame:
    """Profile of every column below the first row: counts, hints and its role."""
    keys = list(keys)
    filled = _filled(cells)
    header = filled.filter(F.col("row_no") == 0).select(
        *keys, "col_no", F.lower(normalize_text("value")).alias("header")
    )
    rich = F.col("fact.rich")
    profile = filled.filter(F.col("row_no") > 0).groupBy(*keys, "col_no").agg(
        F.count("*").alias("non_empty"),
        F.count_if("fact.numeric_like").alias("numeric_like"),
        F.count_if(rich).alias("text_like"),
        F.sum(F.when(rich, F.col("chars"))).alias("text_chars"),
    )
    joined = profile.join(header, [*keys, "col_no"], "left").withColumn(
        "header", F.coalesce("header", F.lit(""))
    )
    is_text = F.when(
        any_contained("header", fv.SHEET_TEXT_HINTS), F.col("text_like") > 0
    ).otherwise((F.col("text_like") >= 2) & (F.col("text_chars") / F.col("text_like") >= 8))
    return (
        joined.withColumn("hinted", any_contained("header", fv.SHEET_HEADER_HINTS))
        .withColumn("is_text", F.coalesce(is_text, F.lit(False)))
        .withColumn("is_meta", ~F.col("is_text") & any_contained("header", fv.SHEET_META_HINTS))
    )


def score_response_sheets(cells: DataFrame, keys: tuple[str, ...] = SHEET) -> DataFrame:
    """Sheets that look like text responses, with their score."""
    keys = list(keys)
    filled = _filled(cells)
    columns = response_columns(cells, tuple(keys))
    per_sheet = columns.groupBy(*keys).agg(
        F.sum("non_empty").alias("non_empty"),
        F.sum("numeric_like").alias("numeric_like"),
        F.count_if("is_text").alias("text_columns"),
        F.count_if("is_meta").alias("meta_columns"),
        F.count_if("hinted").alias("header_hints"),
    )
    body = filled.filter(F.col("row_no") > 0)
    data_rows = body.select(*keys, "row_no").distinct().groupBy(*keys).agg(F.count("*").alias("data_rows"))
    text_columns = columns.filter("is_text").select(*keys, "col_no")
    responses = (
        body.filter("fact.rich")
        .join(text_columns, [*keys, "col_no"], "left_semi")
        .select(*keys, "row_no")
        .distinct()
        .groupBy(*keys)
        .agg(F.count("*").alias("response_rows"))
    )
    ratio = F.col("numeric_like") / F.col("non_empty")
    score = (
        F.least(F.col("data_rows"), F.lit(50)) * 0.08
        + F.col("text_columns") * 1.2
        + F.col("meta_columns") * 0.2
        + F.col("response_rows") * 0.15
        + F.col("header_hints") * 0.6
        - ratio * 1.5
    )
    return (
        per_sheet.join(data_rows, keys)
        .join(responses, keys)
        .withColumn("numeric_ratio", ratio)
        .filter(
            (F.col("data_rows") >= 2)
            & (F.col("text_columns") > 0)
            & (F.col("response_rows") >= 2)
            & (F.col("numeric_ratio") <= fv.NUMERIC_RATIO_MAX)
        )
        .withColumn("score", score)
    )


# --- scored surveys -------------------------------------------------------------
def collapse_headers(
    cells: DataFrame, keys: tuple[str, ...] = SHEET, last_row: int = fv.HEADER_ROW_LAST
) -> DataFrame:
    """Headers for every possible header row: ``header_row, col_no, header, leaf``.

    Only the first rows of a sheet can be headers.  Each is filled to the right,
    then levels are joined top down without immediate repeats.
    """
    keys = list(keys)
    rows = (
        cells.filter(F.col("row_no") <= last_row)
        .select(*keys, "row_no", "col_no", normalize_text(F.coalesce("value", F.lit(""))).alias("value"))
        .groupBy(*keys, "row_no")
        .agg(F.sort_array(F.collect_list(F.struct("col_no", "value"))).alias("row"))
    )
    filled = rows.select(
        *keys,
        "row_no",
        F.expr(
            "aggregate(row, cast(array() AS array<struct<col_no: bigint, value: string, leaf: string>>), (acc, x) -> "
            "concat(acc, array(named_struct('col_no', bigint(x.col_no), 'value', if(x.value = '' AND size(acc) > 0, "
            "element_at(acc, -1).value, x.value), 'leaf', x.value))))"
        ).alias("row"),
    ).select(*keys, "row_no", F.inline("row"))
    candidates = filled.withColumn(
        "header_row", F.explode(F.sequence(F.col("row_no"), F.lit(last_row).cast("long")))
    )
    present = rows.select(*keys, F.col("row_no").alias("header_row"))
    joined = candidates.join(present, [*keys, "header_row"]).groupBy(*keys, "header_row", "col_no").agg(
        F.sort_array(F.collect_list(F.struct("row_no", "value", "leaf"))).alias("levels")
    )
    return joined.select(
        *keys,
        "header_row",
        "col_no",
        F.expr(
            "array_join(aggregate(filter(levels, l -> l.value <> ''), cast(array() AS array<string>), (acc, l) -> "
            "if(size(acc) > 0 AND lower(element_at(acc, -1)) = lower(l.value), acc, concat(acc, array(l.value)))), ' / ')"
        ).alias("header"),
        F.expr("if(element_at(levels, -1).row_no = header_row, element_at(levels, -1).leaf, '')").alias("leaf"),
    )


def survey_columns(cells: DataFrame, keys: tuple[str, ...] = SHEET) -> DataFrame:
    """Question and free-text columns for every usable header row of a sheet."""
    keys = list(keys)
    headers = collapse_headers(cells, tuple(keys)).withColumn("qid", question_id("header"))
    usable = headers.groupBy(*keys, "header_row").agg(
        F.max(question_id("leaf").isNotNull() | is_free_text_header("leaf")).alias("usable")
    ).filter("usable")
    open_headers = headers.join(usable.select(*keys, "header_row"), [*keys, "header_row"]).filter(
        F.col("header") != ""
    )
    values = _filled(cells).filter("NOT fact.blank").select(*keys, "row_no", "col_no", "fact.score", "fact.rich")
    # all values below row 4 serve every candidate; the first rows are handled one by one
    base = values.filter(F.col("row_no") > fv.HEADER_ROW_LAST).groupBy(*keys, "col_no").agg(*_value_stats())
    early = values.filter(F.col("row_no").between(1, fv.HEADER_ROW_LAST)).withColumn(
        "header_row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_no") - 1))
    ).groupBy(*keys, "header_row", "col_no").agg(*_value_stats())
    names = ["n", "scored", "top", "rich"]
    joined = open_headers.join(base, [*keys, "col_no"], "left").join(
        early.select(*keys, "header_row", "col_no", *[F.col(c).alias(f"e_{c}") for c in names]),
        [*keys, "header_row", "col_no"],
        "left",
    )
    zero = F.lit(0)
    n = F.coalesce("n", zero) + F.coalesce("e_n", zero)
    scored = F.coalesce("scored", zero) + F.coalesce("e_scored", zero)
    rich = F.coalesce("rich", zero) + F.coalesce("e_rich", zero)
    needed = F.greatest(F.lit(2), F.ceil(n * fv.QUESTION_VALID_SHARE))
    question = F.startswith("qid", F.lit("BQ")) & (scored >= needed)
    return (
        joined.withColumn("is_question", F.coalesce(question, F.lit(False)) & (n > 0))
        .withColumn(
            "is_free_text", ~F.col("is_question") & is_free_text_header("header") & (rich > 0)
        )
        .filter("is_question OR is_free_text")
        .withColumn("parts", question_parts("header", "leaf"))
        .select(
            *keys, "header_row", "col_no", "header", "is_question", "is_free_text",
            F.col("parts.id").alias("question_id"), F.col("parts.grp").alias("grp"),
            F.col("parts.label").alias("label"),
            F.greatest(F.lit(5), F.floor(F.greatest("top", "e_top")).cast("int")).alias("scale_max"),
        )
    )


def _value_stats() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.count("score").alias("scored"),
        F.max("score").alias("top"),
        F.count_if("rich").alias("rich"),
    ]


def score_survey_sheets(cells: DataFrame, keys: tuple[str, ...] = SHEET) -> DataFrame:
    """Best header row and score of every sheet that is a scored survey."""
    keys = list(keys)
    columns = survey_columns(cells, tuple(keys))
    counts = columns.groupBy(*keys, "header_row").agg(
        F.count_if("is_question").alias("questions"), F.count_if("is_free_text").alias("free_texts")
    )
    rows = (
        _filled(cells)
        .join(columns.select(*keys, "header_row", "col_no", "is_question"), [*keys, "col_no"])
        .filter(
            (F.col("row_no") > F.col("header_row"))
            & F.when(F.col("is_question"), F.col("fact.score").isNotNull()).otherwise(~F.col("fact.blank"))
        )
        .select(*keys, "header_row", "row_no")
        .distinct()
        .groupBy(*keys, "header_row")
        .agg(F.count("*").alias("response_rows"))
    )
    scored = (
        counts.join(rows, [*keys, "header_row"])
        .filter((F.col("questions") > 0) & (F.col("response_rows") >= 2))
        .withColumn(
            "score",
            F.least(F.col("response_rows"), F.lit(120)) * 0.05
            + F.col("questions") * 1.4
            + F.col("free_texts") * 0.8
            + F.col("header_row") * 0.35,
        )
    )
    return top_rows(scored, keys, [F.col("score").desc(), "header_row"], 1).drop("rank")


def question_scores(
    cells: DataFrame, columns: DataFrame, chosen: DataFrame, keys: tuple[str, ...] = SHEET
) -> DataFrame:
    """Mean of the valid ratings per question of the chosen header row."""
    keys = list(keys)
    questions = columns.filter("is_question").join(
        chosen.select(*keys, "header_row"), [*keys, "header_row"], "left_semi"
    )
    return (
        _filled(cells)
        .join(questions, [*keys, "col_no"])
        .filter(F.col("row_no") > F.col("header_row"))
        .withColumn("score", F.col("fact.score"))
        .filter(F.col("score").isNotNull())
        .groupBy(*keys, "col_no", "question_id", "grp", "label", "scale_max")
        .agg(F.round(F.avg("score"), 2).alias("average"), F.count("*").alias("response_count"))
    )


def response_segments(
    cells: DataFrame, columns: DataFrame, keys: tuple[str, ...] = SHEET, only_rich: bool = False
) -> DataFrame:
    """Rows of the chosen columns as ``label: value`` texts.

    ``columns``: ``keys, col_no, header, first_row`` and ``priority`` (the order of
    the columns in the text).  Rows without text are left out.
    """
    keys = list(keys)
    label = F.coalesce(
        F.nullif(normalize_text(F.coalesce("header", F.lit(""))), F.lit("")),
        F.concat(F.lit("column "), (F.col("col_no") + 1).cast("string")),
    )
    values = cells.withColumn("value", normalize_text(F.coalesce("value", F.lit("")))).filter(F.col("value") != "")
    if only_rich:
        values = values.filter(value_facts("value")["rich"])
    order = F.struct("priority", "col_no")
    return (
        values.join(columns, [*keys, "col_no"])
        .filter(F.col("row_no") >= F.col("first_row"))
        .withColumn("pair", F.concat(label, F.lit(": "), "value"))
        .groupBy(*keys, "row_no")
        .agg(
            ordered_join(order, F.col("pair"), " | ").alias("text"),
            (F.col("row_no") - F.first("first_row") + 1).alias("response_no"),
        )
        .withColumn(
            "locator",
            F.concat(F.col(keys[-1]).cast("string"), F.lit(".row."), F.col("response_no").cast("string")),
        )
    )


def response_rows(cells: DataFrame, columns: DataFrame, keys: tuple[str, ...] = SHEET) -> DataFrame:
    """The rows that ``response_segments`` gives a text for, without the text."""
    keys = list(keys)
    return (
        _filled(cells)
        .filter("NOT fact.blank")
        .join(columns, [*keys, "col_no"])
        .filter(F.col("row_no") >= F.col("first_row"))
        .select(*keys, "row_no")
        .distinct()
    )


def skipped_rows(
    cells: DataFrame, segments: DataFrame, columns: DataFrame, keys: tuple[str, ...] = SHEET
) -> DataFrame:
    """Rows of each sheet that hold something but gave no text: ``keys, data_rows, skipped``.

    ``columns`` (``keys, col_no, first_row``) says from which row on a sheet holds data, and
    with ``is_question`` which columns make a row count: any filled free-text cell or valid
    rating.  Without it every row with a filled cell counts.
    """
    keys = list(keys)
    filled = _filled(cells).filter("NOT fact.blank")
    if "is_question" in columns.columns:
        counted = (
            filled.join(columns.select(*keys, "col_no", "first_row", "is_question"), [*keys, "col_no"])
            .filter(~F.col("is_question") | F.col("fact.score").isNotNull())
        )
    else:
        starts = columns.groupBy(*keys).agg(F.min("first_row").alias("first_row"))
        counted = filled.join(starts, keys)
    rows = counted.filter(F.col("row_no") >= F.col("first_row")).select(*keys, "row_no").distinct()
    totals = rows.groupBy(*keys).agg(F.count("*").alias("data_rows"))
    made = segments.groupBy(*keys).agg(F.count("*").alias("made"))
    return totals.join(made, keys, "left").select(
        *keys, "data_rows", (F.col("data_rows") - F.coalesce("made", F.lit(0))).alias("skipped")
    )


def route_survey_files(
    files: DataFrame, cells: DataFrame, margin: float = fv.SELECTION_MARGIN
) -> DataFrame:
    """How each uploaded file is read: ``file_id, reading, sheet, header_row, warning``.

    ``files``: ``file_id, kind`` (``survey_csv``, ``survey_sheets`` or anything else, as
    ``route_sources`` names it); ``cells``: ``file_id, sheet, row_no, col_no, value``.
    All readings are scored over the same cells.  A scored survey goes first; else a
    spreadsheet needs one sheet of responses, a CSV file gives its rows and any other file
    its plain segments.  Where two sheets score alike, the file is ambiguous and has no
    reading.
    """
    keys, by = ("file_id", "sheet"), ["file_id"]
    surveys = select_with_margin(score_survey_sheets(cells, keys), by, ["sheet"], margin).select(
        "file_id", F.struct("sheet", "header_row", "chosen").alias("survey")
    )
    responses = select_with_margin(score_response_sheets(cells, keys), by, ["sheet"], margin).select(
        "file_id", F.struct("sheet", "chosen").alias("responses")
    )
    tabular = F.col("kind").isin("survey_csv", "survey_sheets")
    is_survey = tabular & F.col("survey").isNotNull()
    is_sheet = (F.col("kind") == "survey_sheets") & ~is_survey
    chosen = F.when(is_survey, F.col("survey.chosen")).when(is_sheet, F.coalesce("responses.chosen", F.lit(False)))
    reading = (
        F.when(chosen == F.lit(False), None)
        .when(is_survey, "survey")
        .when(is_sheet, "responses")
        .when(F.col("kind") == "survey_csv", "rows")
        .otherwise("plain")
    )
    return (
        files.join(surveys, "file_id", "left")
        .join(responses, "file_id", "left")
        .withColumn("reading", reading)
        .select(
            "file_id",
            "reading",
            F.when(F.col("reading") == "survey", F.col("survey.sheet"))
            .when(F.col("reading") == "responses", F.col("responses.sheet"))
            .alias("sheet"),
            F.when(F.col("reading") == "survey", F.col("survey.header_row")).alias("header_row"),
            F.when(F.col("reading").isNull(), F.concat(F.col("file_id").cast("string"), F.lit(": sheet structure is ambiguous"))).alias("warning"),
        )
    )


def routed_segments(
    routes: DataFrame, cells: DataFrame, plain: DataFrame, facts: DataFrame | None = None
) -> DataFrame:
    """Texts of every file in the reading chosen for it: ``file_id, reading, locator, text``.

    ``plain``: ``file_id, locator, text`` of files that are no tables; ``facts``: what
    ``cell_facts`` found in the cells, where it is stored.
    """
    keys = ("file_id", "sheet")
    facts = cell_facts(cells) if facts is None else facts
    surveys = routes.filter("reading = 'survey'").select(*keys, "header_row")
    answers = routes.filter("reading = 'responses'").select(*keys)
    free = (
        survey_columns(facts, keys)
        .filter("is_free_text")
        .join(surveys, [*keys, "header_row"], "left_semi")
        .select(*keys, "col_no", "header", (F.col("header_row") + 1).alias("first_row"), F.lit(0).alias("priority"))
    )
    asked = (
        response_columns(facts, keys)
        .filter("is_meta OR is_text")
        .join(answers, list(keys), "left_semi")
        .select(
            *keys, "col_no", "header", F.lit(1).cast("long").alias("first_row"),
            F.when(F.col("is_meta"), 0).otherwise(1).alias("priority"),
        )
    )
    rows = verbalize_rows(cells.join(routes.filter("reading = 'rows'").select("file_id"), "file_id", "left_semi"), keys=("file_id",))
    shown = ["file_id", "reading", "locator", "text"]

    def named(frame: DataFrame, reading: str) -> DataFrame:
        return frame.withColumn("reading", F.lit(reading)).select(*shown)

    return (
        named(response_segments(cells, free, keys, only_rich=True), "survey")
        .unionByName(named(response_segments(cells, asked, keys), "responses"))
        .unionByName(named(rows, "rows"))
        .unionByName(named(plain.join(routes.filter("reading = 'plain'"), "file_id", "left_semi"), "plain"))
    )


def response_counts(files: DataFrame) -> DataFrame:
    """Responses per instructor: per file the largest of its three counts.

    ``files``: ``course_id, instructor, source_type, rows, parts, segments,
    question_responses``; plain text counts its ``|`` parts.
    """
    rows = F.when(F.col("source_type").isin(*fv.TABULAR_TYPES), F.col("rows")).when(
        F.col("source_type") == "text", F.col("parts")
    ).otherwise(F.col("segments"))
    zero = F.lit(0)
    per_file = F.greatest(
        F.coalesce(rows, zero), F.coalesce("question_responses", zero), F.coalesce("segments", zero)
    )
    return files.groupBy("course_id", "instructor").agg(F.sum(per_file).alias("response_count"))


def text_parts(c: str) -> Column:
    """``|``-separated non-blank parts of a plain text, at least one."""
    return F.expr(f"greatest(1, size(filter(split({c}, '\\\\|'), p -> trim(p) <> '')))")


# --- feedback texts ---------------------------------------------------------------
Hints = Sequence[tuple[str, str]]
Rules = Sequence[tuple[str, Sequence[str]]]


def hint_table(
    spark: SparkSession, positive: Hints = fv.POSITIVE_HINTS, negative: Hints = fv.NEGATIVE_HINTS
) -> DataFrame:
    """``polarity, ord, needle, label``; ``ord`` is unique per polarity and settles ties."""
    rows = [
        (polarity, i, needle, label)
        for polarity, hints in (("positive", positive), ("negative", negative))
        for i, (needle, label) in enumerate(hints)
    ]
    return spark.createDataFrame(rows, "polarity string, ord bigint, needle string, label string")


def rule_table(spark: SparkSession, rules: Rules = fv.COMPLAINT_RULES) -> DataFrame:
    """``ord, label, needle``: a complaint rule is one ``ord`` with one or more needles."""
    rows = [(i, label, needle) for i, (label, needles) in enumerate(rules) for needle in needles]
    return spark.createDataFrame(rows, "ord bigint, label string, needle string")


def _found(lines: DataFrame, needles: DataFrame, *columns: Column | str) -> DataFrame:
    """A row for each group of needles (``grp``) that a line contains."""
    groups = needle_groups(needles)("text")
    # the outer form keeps the optimizer from matching a second time for a filter
    return lines.select(*columns, F.explode_outer(groups).alias("grp")).filter(F.col("grp").isNotNull())


def sentiment_counts(responses: DataFrame, hints: DataFrame) -> DataFrame:
    """Label counts per instructor and polarity with the place where a label was first seen."""
    number = F.col("ord") * 2 + F.when(F.col("polarity") == "negative", 1).otherwise(0)
    numbered = hints.withColumn("grp", number)
    found = _found(responses, numbered, "instructor", "source_id", "seq")
    return (
        found.join(numbered.select("grp", "ord", "polarity", "label"), "grp")
        .groupBy("instructor", "polarity", "label")
        .agg(F.count("*").alias("n"), F.min(F.struct("source_id", "seq", "ord")).alias("seen"))
    )


def _named(label: str) -> list[Column]:
    return ["instructor", F.col(label).alias("label"), F.col("rank").cast("int").alias("rank")]


def sentiment_labels(
    responses: DataFrame,
    hints: DataFrame | None = None,
    defaults: Sequence[str] = fv.DEFAULT_NEGATIVES,
    k: int = 4,
) -> DataFrame:
    """Up to four labels per instructor and polarity, with their fall-backs.

    ``hints`` is a table as ``hint_table`` gives it, of any length.  Instructors without a positive label get their most frequent tokens; tokens
    are only counted for those instructors.
    """
    lines = responses.filter(F.col("text") != "")
    order = [F.col("n").desc(), "seen"]
    counts = sentiment_counts(lines, hint_table(responses.sparkSession) if hints is None else hints)
    ranked = top_rows(counts, ["instructor", "polarity"], order, k)
    good = ranked.filter("polarity = 'positive'").select(*_named("label"))
    bad = ranked.filter("polarity = 'negative'").select(*_named("label"))
    tokens = (
        lines.join(good.select("instructor").distinct(), "instructor", "left_anti")
        .select("instructor", "source_id", "seq", F.posexplode_outer(tokenize("text")).alias("pos", "token"))
        .filter(F.col("token").isNotNull())
        .groupBy("instructor", "token")
        .agg(F.count("*").alias("n"), F.min(F.struct("source_id", "seq", "pos")).alias("seen"))
    )
    frequent = top_rows(tokens, ["instructor"], order, k).select(*_named("token"))
    silent = lines.select("instructor").distinct().join(
        bad.select("instructor").distinct(), "instructor", "left_anti"
    )
    usual = silent.select("instructor", F.posexplode(F.expr(sql_texts(defaults))).alias("rank", "label")).select(
        "instructor", "label", (F.col("rank") + 1).alias("rank")
    )
    return (
        good.unionByName(frequent)
        .withColumn("polarity", F.lit("positive"))
        .unionByName(bad.unionByName(usual).withColumn("polarity", F.lit("negative")))
    )


def complaints(
    responses: DataFrame,
    labels: DataFrame,
    rules: DataFrame | None = None,
    k: int = 3,
) -> DataFrame:
    """Repeated complaints: responses per rule, with the week of the first one.

    ``rules`` is a table as ``rule_table`` gives it, of any length.  Without any hit, the
    first negative label stands for a third of the responses.
    """
    lines = responses.filter(F.col("text") != "")
    rules = rule_table(responses.sparkSession) if rules is None else rules
    week = extract_week("text").alias("week")
    named = rules.groupBy("ord").agg(F.min("label").alias("label"))
    counted = (
        _found(lines, rules.withColumnRenamed("ord", "grp"), "instructor", "source_id", "seq", week)
        .withColumnRenamed("grp", "ord")
        .join(named, "ord")
        .groupBy("instructor", "label")
        .agg(
            F.count("*").alias("n"),
            F.min(F.struct("source_id", "seq", "ord")).alias("seen"),
            F.min(F.struct("source_id", "seq", "week"))["week"].alias("week"),
        )
    )
    found = top_rows(counted, ["instructor"], [F.col("n").desc(), "seen"], k).select(
        "instructor", F.col("label").alias("pattern"), "n", "week", "rank"
    )
    totals = lines.groupBy("instructor").agg(F.count("*").alias("lines"))
    fallback = (
        labels.filter((F.col("polarity") == "negative") & (F.col("rank") == 1))
        .join(totals, "instructor")
        .join(found.select("instructor").distinct(), "instructor", "left_anti")
        .select(
            "instructor",
            F.concat("label", F.lit(" 관련 피드백 반복")).alias("pattern"),
            F.greatest(F.lit(1), F.floor(F.col("lines") / 3)).cast("long").alias("n"),
            F.lit("").alias("week"),
            F.lit(1).alias("rank"),
        )
    )
    return found.unionByName(fallback)


def suggestions(
    complaint_rows: DataFrame,
    catalog: Sequence[tuple[str, str, str, str]] = fv.SUGGESTION_CATALOG,
    default: tuple[str, str, str] = fv.DEFAULT_SUGGESTION,
) -> DataFrame:
    """Suggestions by complaint; one default where none of them is known."""
    cases = "CASE pattern " + " ".join(
        f"WHEN {sql_text(p)} THEN named_struct('priority', {sql_text(pr)}, 'label', {sql_text(lb)}, 'body', {sql_text(body)})"
        for p, pr, lb, body in catalog
    ) + " END"
    looked_up = complaint_rows.withColumn("s", F.expr(cases))
    known = looked_up.filter(F.col("s").isNotNull()).select("instructor", "rank", "s.priority", "s.label", "s.body")
    unknown = (
        complaint_rows.select("instructor").distinct()
        .join(known.select("instructor").distinct(), "instructor", "left_anti")
        .select("instructor", F.lit(1).alias("rank"), F.lit(default[0]).alias("priority"), F.lit(default[1]).alias("label"), F.lit(default[2]).alias("body"))
    )
    return known.unionByName(unknown)


def voc_by_instructor(
    files: DataFrame, counts: DataFrame, scores: DataFrame, labels: DataFrame, complaint_rows: DataFrame, suggested: DataFrame
) -> DataFrame:
    """One feedback record per instructor, with nested lists of bounded length."""

    def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("instructor").agg(
            F.sort_array(F.collect_list(F.struct("rank", *columns))).alias(name)
        )

    names = files.groupBy("instructor").agg(
        F.min_by("file_name", "file_ord").alias("first_file"), F.count("*").alias("files")
    ).select(
        "instructor",
        F.when(F.col("files") == 1, F.col("first_file"))
        .otherwise(F.concat("first_file", F.lit(" 외 "), (F.col("files") - 1).cast("string"), F.lit("개")))
        .alias("file_name"),
    )
    return (
        names.join(counts, "instructor", "left")
        .join(
            group_scores(scores, ("instructor",)).groupBy("instructor").agg(
                F.sort_array(F.collect_list(F.struct("seq", "grp", "entries"))).alias("score_groups")
            ),
            "instructor",
            "left",
        )
        .join(listed(labels.filter(F.col("polarity") == "positive"), "positive", "label"), "instructor", "left")
        .join(listed(labels.filter(F.col("polarity") == "negative"), "negative", "label"), "instructor", "left")
        .join(listed(complaint_rows, "complaints", "pattern", "n", "week"), "instructor", "left")
        .join(listed(suggested, "suggestions", "priority", "label", "body"), "instructor", "left")
    )


def voc_summary(labels: DataFrame, complaint_rows: DataFrame, suggested: DataFrame, ords: DataFrame) -> DataFrame:
    """Label, complaint and suggestion counts over all instructors, best first.

    ``ords`` gives the instructor order that decides ties (first seen wins).
    """
    ords = ords.select("instructor", "instructor_ord")

    def counted(rows: DataFrame, kind: Column, label: str, n: Column, extra: Column) -> DataFrame:
        return rows.join(ords, "instructor").groupBy(kind.alias("kind"), F.col(label).alias("label")).agg(
            n.alias("n"),
            F.min(F.struct("instructor_ord", "rank")).alias("seen"),
            F.min_by(extra, F.struct("instructor_ord", "rank")).alias("detail"),
        )

    one = F.count("*")
    parts = (
        counted(labels, F.col("polarity"), "label", one, F.lit(""))
        .unionByName(counted(complaint_rows, F.lit("complaint"), "pattern", F.sum("n"), F.col("week")))
        .unionByName(counted(suggested, F.lit("suggestion"), "label", one, F.col("priority")))
    )
    ranked = top_rows(parts, ["kind"], [F.col("n").desc(), "seen"], 6)
    return ranked.filter((F.col("rank") <= 4) | F.col("kind").isin("positive", "negative")).drop("seen")


def review_table(voc: DataFrame, summary: DataFrame, scores: DataFrame) -> DataFrame:
    """Instructor records plus one common row with pooled question scores."""
    pooled = group_scores(aggregate_scores(scores, ()), ()).agg(
        F.sort_array(F.collect_list(F.struct("seq", "grp", "entries"))).alias("score_groups")
    )
    lists = summary.agg(
        *[
            F.sort_array(
                F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "label")))
            ).alias(kind)
            for kind in ("positive", "negative")
        ]
    )
    common = pooled.select(F.lit("(all)").alias("name"), "score_groups", F.lit(1).alias("_k")).join(
        lists.withColumn("_k", F.lit(1)), "_k", "left"
    ).drop("_k")
    return voc.select(F.col("instructor").alias("name"), "score_groups", "positive", "negative").unionByName(common)


VOC_SCHEMA = (
    "struct<sentiment: struct<positive: array<string>, negative: array<string>>, repeated_complaints: "
    "array<struct<pattern: string, count: int, week: string>>, next_suggestions: array<struct<priority: string, "
    "label: string, body: string>>>"
)


def merge_external_voc(external: DataFrame, fallback: DataFrame) -> DataFrame:
    """Outside feedback analysis (``instructor, raw``), cleaned, over rule results.

    ``fallback``: ``instructor, positive, negative, complaints, suggestions``.
    """

    def trimmed(path: str) -> str:
        return f"slice(filter(transform(coalesce({path}, array()), x -> trim(x)), x -> x <> ''), 1, 6)"

    parsed = external.withColumn("j", F.from_json("raw", VOC_SCHEMA)).select(
        "instructor",
        F.expr(trimmed("j.sentiment.positive")).alias("x_positive"),
        F.expr(trimmed("j.sentiment.negative")).alias("x_negative"),
        F.expr(
            "slice(transform(filter(coalesce(j.repeated_complaints, array()), c -> trim(coalesce(c.pattern, '')) <> ''), "
            "c -> named_struct('pattern', trim(c.pattern), 'count', greatest(1, coalesce(c.count, 1)), "
            "'week', trim(coalesce(c.week, '')))), 1, 3)"
        ).alias("x_complaints"),
        F.expr(
            "slice(transform(filter(coalesce(j.next_suggestions, array()), s -> trim(coalesce(s.label, '')) <> '' AND "
            "trim(coalesce(s.body, '')) <> ''), s -> named_struct('priority', coalesce(nullif(lower(trim(s.priority)), ''), "
            "'low'), 'label', trim(s.label), 'body', trim(s.body))), 1, 3)"
        ).alias("x_suggestions"),
    )
    merged = [
        F.expr(f"if(coalesce(size(x_{c}), 0) > 0, x_{c}, {c})").alias(c)
        for c in ("positive", "negative", "complaints", "suggestions")
    ]
    return fallback.join(parsed, "instructor", "left").select("instructor", *merged)
