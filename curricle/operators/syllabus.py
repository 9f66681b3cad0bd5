"""Curriculum structure from document lines, for many documents at once.

``lines``: ``doc_id, page, line_no, raw_line`` with ``line_no`` unique per document.
Scores are row-local.  A document yields at most a few sections, so only the best
or first few lines per document are ever ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import any_contained, col, erase, hits, matches, sql_text
from curricle.functions.text import (
    chapter_block_text,
    lecture_metric,
    normalize_lines,
    normalize_text,
    split_heading,
    strip_list_prefix,
    strip_metrics,
    trim_title,
    week_metric,
    weight_metric,
)
from curricle.operators.scale import top_rows
from curricle.sources.segments import ordered_join


def line_score(raw: str | Column, line: str | Column) -> Column:
    """How much a line looks like a curriculum entry."""
    line = col(line)
    words = F.size(F.filter(F.split(line, " "), lambda w: w != ""))

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    score = (
        points(F.regexp_like(col(raw), F.lit(fv.LIST_PREFIX)), 4)
        + points(matches(line, fv.PERCENT), 5)
        + points(matches(line, fv.LECTURES), 4)
        + points(matches(line, fv.HOURS), 4)
        + points(matches(line, fv.WEEK_RANGE) | matches(line, fv.WEEKS) | matches(line, fv.DAYS), 3)
        + points(F.regexp_like(line, F.lit(fv.SECTION_SEPARATOR)), 2)
        + points(F.length(line) <= 80, 1)
        + points(words.between(4, 20), 1)
    )
    return (
        score
        + hits(line, fv.CURRICULUM_HINTS) * 3
        - hits(line, fv.COUNTER_HINTS) * 4
        + points(any_contained(line, fv.GOAL_WORDS), 2)
        - points(F.length(line) > 120, 1)
    )


def score_lines(lines: DataFrame) -> DataFrame:
    normal = lines.withColumn("line", normalize_text("raw_line"))
    return normal.withColumn("score", line_score("raw_line", "line"))


def heuristic_sections(lines: DataFrame, max_sections: int = fv.MAX_SECTIONS) -> DataFrame:
    """Best distinct lines of a document, shown in document order."""
    scored = score_lines(lines).filter(
        (F.length("line") >= 4) & ~any_contained("line", fv.IGNORED_LINE_WORDS) & (F.col("score") > 1)
    )
    first = scored.groupBy("doc_id", F.lower("line").alias("_key")).agg(
        F.min(F.struct("line_no", "page", "score", "line")).alias("b")
    ).select("doc_id", "b.*")
    best = top_rows(first, ["doc_id"], [F.col("score").desc(), "line_no"], max_sections).drop("rank")
    ordered = top_rows(best, ["doc_id"], ["line_no"], max_sections, "section_ord")
    cleaned = F.trim(strip_list_prefix("line"))
    rows = ordered.withColumn("cleaned", cleaned).withColumn("m", weight_metric("cleaned")).withColumn(
        "parts", F.split("cleaned", fv.SECTION_SEPARATOR, 2)
    )
    head, tail = F.trim(F.get("parts", F.lit(0))), F.trim(F.get("parts", F.lit(1)))
    has_parts = (F.size("parts") == 2) & (head != "")
    number = F.concat(F.lit("섹션 "), F.col("section_ord").cast("string"))
    title = F.when(has_parts, head).otherwise(trim_title(strip_metrics("cleaned")))
    description = F.when(has_parts, F.when(tail == "", head).otherwise(tail)).otherwise(F.col("cleaned"))
    return rows.select(
        "doc_id",
        "section_ord",
        F.coalesce(F.nullif(title, F.lit("")), number).alias("title"),
        F.coalesce(F.nullif(description, F.lit("")), F.nullif(title, F.lit("")), number).alias("description"),
        F.col("m.value").alias("raw_weight"),
        F.col("m.source").alias("weight_source"),
        F.lit(0.42).alias("confidence"),
        "page",
        F.col("cleaned").alias("snippet"),
    )


# --- timetables ---------------------------------------------------------------------
def _all_weekdays(line: Column) -> Column:
    return hits(line, fv.WEEKDAYS) == len(fv.WEEKDAYS)


def _timetable_rows(lines: DataFrame) -> DataFrame:
    """Lines with ``is_week``, ``is_session`` and the ``subjects`` of a session."""
    labels = ", ".join(sql_text(x) for x in fv.SESSION_LABELS)
    weekday = " AND ".join(f"contains(p, {sql_text(d)})" for d in fv.WEEKDAYS)
    normal = lines.withColumn("line", normalize_text("raw_line")).filter(F.col("line") != "")
    is_week = matches(F.col("line"), fv.WEEK_ROW)
    return normal.withColumn("is_week", is_week).withColumn(
        "is_session", ~is_week & matches(F.col("line"), fv.SESSION_ROW)
    ).withColumn(
        "cols",
        F.filter(
            F.transform(F.split(F.trim("raw_line"), r"\s{2,}"), normalize_text), lambda p: p != ""
        ),
    ).withColumn(
        "subjects",
        F.expr(
            f"if(is_session AND get(cols, 0) IN ({labels}), filter(slice(cols, 2, greatest(0, size(cols) - 1)), p -> "
            f"NOT (({weekday}) OR regexp_like(p, r'(?U){fv.WEEK_ROW}') OR "
            f"regexp_like(p, r'^\\d{{1,2}}/\\d{{1,2}}$') OR p IN ({labels}))), cast(array() AS array<string>))"
        ),
    )


def _slots(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "page", "line_no", "line", F.posexplode_outer("subjects").alias("pos", "subject")
    ).filter(F.col("subject").isNotNull())


def schedule_sources(
    lines: DataFrame, sections: DataFrame, most: int = fv.SCHEDULE_SNIPPETS
) -> DataFrame:
    """``pages`` (sorted) and the first ``most`` distinct ``snippets`` of each listed subject."""
    listed = sections.select("doc_id", F.col("title").alias("subject"), "section_ord")
    slots = _slots(_timetable_rows(lines)).join(listed, ["doc_id", "subject"])
    keys = ["doc_id", "section_ord"]
    pages = slots.groupBy(*keys).agg(F.sort_array(F.collect_set("page")).alias("pages"))
    distinct = slots.groupBy(*keys, "line").agg(F.min("line_no").alias("line_no"))
    snippets = top_rows(distinct, keys, ["line_no"], most).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("snippets")
    )
    return pages.join(snippets, keys)


def schedule_sections(lines: DataFrame, max_sections: int = fv.MAX_SECTIONS) -> DataFrame:
    """Subjects of a timetable with their slot counts, in first-seen order."""
    rows = _timetable_rows(lines)
    facts = rows.groupBy("doc_id").agg(
        F.max(_all_weekdays(F.col("line"))).alias("weekdays"),
        F.count_if("is_week").alias("weeks"),
        F.count_if("is_session").alias("sessions"),
        F.count_if(F.size("subjects") > 0).alias("matched"),
    )
    subjects = _slots(rows).groupBy("doc_id", "subject").agg(
        F.count("*").alias("slots"),
        F.min(F.struct("line_no", "pos", "page", "line")).alias("seen"),
    )
    totals = subjects.groupBy("doc_id").agg(
        F.count("*").alias("distinct_subjects"), F.sum("slots").alias("total_slots")
    )
    scored = facts.join(totals, "doc_id").withColumn("confidence", _schedule_confidence())
    listed = top_rows(subjects, ["doc_id"], ["seen"], max_sections, "section_ord")
    return listed.join(scored.select("doc_id", "confidence"), "doc_id").select(
        "doc_id",
        "section_ord",
        F.col("subject").alias("title"),
        F.concat(F.lit("timetable slots: "), F.col("slots").cast("string")).alias("description"),
        F.col("slots").cast("double").alias("raw_weight"),
        F.lit("schedule_slots").alias("weight_source"),
        "confidence",
        F.col("seen.page").alias("page"),
        F.col("seen.line").alias("snippet"),
    )


def _schedule_confidence() -> Column:
    weeks, sessions, matched = F.col("weeks"), F.col("sessions"), F.col("matched")
    subjects, slots = F.col("distinct_subjects"), F.col("total_slots")
    score = (
        F.when(F.col("weekdays"), 0.22).otherwise(0.0)
        + F.when(weeks >= 8, 0.24).when(weeks >= 4, 0.18).when(weeks >= 2, 0.1).otherwise(0.0)
        + F.when(sessions >= F.greatest(F.lit(4), weeks), 0.2).when(sessions >= 2, 0.12).otherwise(0.0)
        + F.when(matched >= F.greatest(F.lit(3), F.floor(weeks / 2)), 0.18).when(matched >= 2, 0.1).otherwise(0.0)
        + F.when(subjects >= 3, 0.08).when(subjects >= 2, 0.04).otherwise(0.0)
        + F.when(slots >= F.greatest(F.lit(8), subjects * 3), 0.08).otherwise(0.0)
    )
    return F.round(F.least(F.lit(0.99), score), 2)


# --- chapter roadmaps ---------------------------------------------------------------
def roadmap_sections(lines: DataFrame, max_sections: int = fv.MAX_SECTIONS) -> DataFrame:
    """Chapters between the roadmap hints, with lecture counts or weeks as weights.

    Only the first chapters are reported, so the borders of the blocks are found
    from the first ``max_sections + 1`` chapter lines; every line then knows its
    block from that short list, without a running window over the document.  One
    aggregate per document gives its borders and its end.
    """
    normal = lines.withColumn("line", normalize_text("raw_line")).filter(F.col("line") != "")
    starts = normal.filter(any_contained("line", fv.ROADMAP_START)).groupBy("doc_id").agg(
        F.min("line_no").alias("start")
    )
    inside = normal.join(starts, "doc_id").filter(F.col("line_no") > F.col("start"))
    header = F.col("line").isin(*fv.ROADMAP_HEADER_LINES) | (
        F.startswith("line", F.lit("챕터 ")) & F.contains("line", F.lit(" 강수"))
    )
    ends = any_contained("line", fv.ROADMAP_END)
    chapter = matches(F.col("line"), fv.CHAPTER_LINE) & ~header
    marks = inside.filter(ends | chapter).select(
        "doc_id", "line_no", F.explode(F.array_compact(F.array(F.when(ends, True), F.when(chapter, False)))).alias("end")
    )
    # the first chapter lines before the end are among the first of all
    few = top_rows(marks, ["doc_id", "end"], ["line_no"], max_sections + 1)
    facts = few.groupBy("doc_id").agg(
        F.min(F.when(F.col("end"), F.col("line_no"))).alias("stop"),
        F.sort_array(F.collect_list(F.when(~F.col("end"), F.col("line_no")))).alias("borders"),
    )
    body = inside.join(facts, "doc_id").filter(
        (F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))) & ~header
    )
    blocks = (
        body.withColumn("section_ord", F.expr("size(filter(borders, b -> b <= line_no))"))
        .filter(F.col("section_ord").between(1, max_sections))
        .groupBy("doc_id", "section_ord")
        .agg(
            ordered_join(F.col("line_no"), F.col("line"), " ").alias("block"),
            F.min_by("page", "line_no").alias("page"),
        )
        .withColumn("block", chapter_block_text("block"))
    )
    bare = strip_metrics(F.trim(erase(F.col("block"), fv.CHAPTER_LINE)))
    heading = normalize_text(erase(bare, r"\b차$"))
    rows = (
        blocks.withColumn("chapter", F.regexp_extract("block", "(?U)" + fv.CHAPTER_LINE, 1).cast("int"))
        .withColumn("lectures", lecture_metric("block"))
        .withColumn("weeks", week_metric("block"))
        .withColumn("heading", heading)
        .withColumn("h", split_heading("heading"))
    )
    fallback = F.concat(F.lit("섹션 "), F.col("section_ord").cast("string"))
    body_title = F.coalesce(F.nullif("h.title", F.lit("")), F.nullif("heading", F.lit("")), fallback)
    title = F.concat(F.lit("Chapter "), F.col("chapter").cast("string"), F.lit(": "), body_title)
    about = F.coalesce(F.nullif("h.description", F.lit("")), F.nullif("heading", F.lit("")), title)
    count = F.when(F.col("lectures") == F.floor("lectures"), F.floor("lectures").cast("string")).otherwise(
        F.col("lectures").cast("string")
    )
    sections = rows.select(
        "doc_id",
        "section_ord",
        title.alias("title"),
        F.when(F.col("lectures").isNotNull(), F.concat(about, F.lit(" · 총 "), count, F.lit("강")))
        .otherwise(about)
        .alias("description"),
        F.coalesce("lectures", "weeks").alias("raw_weight"),
        F.when(F.col("lectures").isNotNull(), "lecture_count")
        .when(F.col("weeks").isNotNull(), "weeks")
        .otherwise("none")
        .alias("weight_source"),
        "page",
        F.col("block").alias("snippet"),
    )
    # at most max_sections rows are left of a document
    of_doc = Window.partitionBy("doc_id")
    n = F.count("*").over(of_doc)
    by_lecture = F.count_if(F.col("weight_source") == "lecture_count").over(of_doc)
    by_week = F.count_if(F.col("weight_source") == "weeks").over(of_doc)
    titles = F.size(F.collect_set("title").over(of_doc))
    score = (
        F.when(n >= 5, 0.34).when(n >= 3, 0.24).otherwise(0.0)
        + F.least(F.lit(0.42), by_lecture / n * 0.42)
        + F.least(F.lit(0.08), by_week / n * 0.08)
        + F.when(titles == n, 0.12).otherwise(0.0)
    )
    return sections.withColumn("confidence", F.round(F.least(F.lit(0.99), score), 2))


def structured_sections(roadmap: DataFrame, schedule: DataFrame) -> DataFrame:
    """Roadmap where it is trusted, else timetable where it is trusted."""
    sure = roadmap.filter(F.col("confidence") >= fv.ROADMAP_CONFIDENCE).withColumn(
        "kind", F.lit("chapter_roadmap")
    )
    other = schedule.filter(F.col("confidence") >= fv.SCHEDULE_CONFIDENCE).join(
        sure.select("doc_id").distinct(), "doc_id", "left_anti"
    ).withColumn("kind", F.lit("schedule_slots"))
    return sure.unionByName(other)


# --- post-processing and decisions ----------------------------------------------------
def weight_status(sections: DataFrame) -> DataFrame:
    """missing / inconsistent / explicit / derivable per document."""
    none = (F.col("weight_source") == "none") | F.col("raw_weight").isNull()
    percent = F.col("weight_source") == "percent"
    derived = F.col("weight_source").isin(*fv.DERIVED_WEIGHT_SOURCES)
    facts = sections.groupBy("doc_id").agg(
        F.bool_or(none).alias("any_none"),
        F.bool_or(percent | derived).alias("any_weight"),
        F.bool_and(percent).alias("all_percent"),
    )
    return facts.select(
        "doc_id",
        F.when(F.col("any_none") & F.col("any_weight"), "inconsistent")
        .when(F.col("any_none"), "missing")
        .when(F.col("all_percent"), "explicit")
        .otherwise("derivable")
        .alias("weight_status"),
    )


def postprocess_sections(sections: DataFrame, max_sections: int = fv.MAX_SECTIONS) -> DataFrame:
    """Named, distinct sections with a snippet, and weights in percent if known."""
    usable = (
        sections.filter(F.col("section_ord") <= max_sections)
        .withColumn("title", F.coalesce("title", F.lit("")))
        .withColumn("snippet", F.coalesce(F.nullif("snippet", F.lit("")), F.nullif("description", F.lit(""))))
        .filter(
            (F.col("title") != "")
            & ~normalize_text("title").isin(*fv.GENERIC_TITLES)
            & F.col("snippet").isNotNull()
        )
    )
    named = usable.withColumn("_title", F.lower("title"))
    kept = top_rows(named, ["doc_id", "_title"], ["section_ord"], 1).drop("rank", "_title")
    doc = Window.partitionBy("doc_id")
    back = Window.partitionBy("doc_id").orderBy(F.col("section_ord").desc())
    raw = F.greatest(F.lit(0.0), F.coalesce("raw_weight", F.lit(0.0)))
    share = F.round(raw / F.nullif(F.sum(raw).over(doc), F.lit(0.0)) * 100, 2)
    weighted = (
        kept.join(weight_status(kept), "doc_id")
        .withColumn("_share", share)
        .withColumn("_sum", F.sum("_share").over(doc))
        .withColumn("_last", F.row_number().over(back) == 1)
    )
    known = F.col("weight_status").isin("explicit", "derivable") & F.col("_share").isNotNull()
    percent = F.when(F.col("_last"), F.round(F.col("_share") + (100 - F.col("_sum")), 2)).otherwise(F.col("_share"))
    return weighted.withColumn(
        "target_weight", F.when(known, percent).otherwise(F.col("raw_weight"))
    ).drop("_share", "_sum", "_last")


def curriculum_score(text: str | Column) -> Column:
    """Document score from hint words in its whole text."""
    text = col(text)
    interviews = F.size(F.regexp_extract_all(text, F.lit("면접"), F.lit(0)))

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    return (
        hits(text, fv.CURRICULUM_HINTS) * 2
        - hits(text, fv.COUNTER_HINTS) * 3
        + points(any_contained(text, ("주차", "시수")), 3)
        + points(F.contains(text, F.lit("%")), 2)
        + points(any_contained(text, ("교과목", "과정")), 1)
        - points(interviews >= 2, 4)
    )


def classify_documents(docs: DataFrame, structured: DataFrame, heuristic: DataFrame) -> DataFrame:
    """Rule-based decision per document (``doc_id, text``)."""
    sure = structured.groupBy("doc_id").agg(F.max("confidence").alias("structured"))
    guessed = heuristic.groupBy("doc_id").agg(F.count("*").alias("guessed"))
    rows = docs.withColumn("score", curriculum_score("text")).join(sure, "doc_id", "left").join(
        guessed, "doc_id", "left"
    )
    accepted = F.col("structured") >= fv.SCHEDULE_CONFIDENCE
    plausible = (F.col("score") >= 2) & (F.coalesce("guessed", F.lit(0)) > 0)
    blank = normalize_text("text") == ""
    return rows.select(
        "doc_id",
        "score",
        F.when(~blank & (accepted | plausible), "review_required").otherwise("rejected").alias("decision"),
        F.when(blank, "unreadable")
        .when(accepted | plausible, "curriculum_like")
        .otherwise("not_curriculum")
        .alias("document_kind"),
        F.when(blank, 0.0)
        .when(accepted, F.least(F.lit(0.74), 0.52 + F.col("structured") / 4))
        .when(plausible, F.least(F.lit(0.74), 0.42 + F.col("score") / 20))
        .otherwise(F.least(F.lit(0.49), F.greatest(F.lit(0.0), F.col("score") / 10)))
        .alias("confidence"),
    )


def resolve_decisions(
    classified: DataFrame, accept: float = fv.ACCEPT_CONFIDENCE, review: float = fv.REVIEW_CONFIDENCE
) -> DataFrame:
    """Decision from an outside classification plus local structure signals."""
    structure = F.col("has_structure") | F.coalesce("local_structure", F.lit(False))
    weights = F.col("has_explicit_weights") | F.col("has_derivable_weights") | F.coalesce(
        "local_weights", F.lit(False)
    )
    sure = (F.col("confidence") >= accept) & structure & weights
    return classified.withColumn(
        "decision",
        F.when(F.col("document_kind").isin("not_curriculum", "unreadable"), "rejected")
        .when(F.col("confidence") < review, "rejected")
        .when(sure, "accepted")
        .otherwise("review_required"),
    )


def structure_hint(text: str | Column) -> Column:
    """Whether a text announces a roadmap or a timetable."""
    return any_contained(normalize_text(text), (*fv.ROADMAP_START, *fv.SCHEDULE_HINTS))


def structure_evidence(sections: DataFrame, k: int = 3) -> DataFrame:
    """First sections with page, snippet and reason."""
    reason = F.when(
        F.col("kind") == "chapter_roadmap",
        F.concat("title", F.lit(": lecture counts or weeks are stated in the roadmap")),
    ).otherwise(F.concat("title", F.lit(": repeated slots in the timetable")))
    first = top_rows(sections, ["doc_id"], ["section_ord"], k)
    shown = F.coalesce(F.nullif("snippet", F.lit("")), F.when(F.col("kind") == "chapter_roadmap", F.col("description")))
    return first.select("doc_id", "rank", "page", shown.alias("snippet"), reason.alias("reason")).filter(
        F.col("snippet").isNotNull()
    )


def page_records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layout text with a flat fall-back per page, and the unreadable pages."""
    layout = F.coalesce(F.nullif("layout_text", F.lit("")), F.col("raw_text"), F.lit(""))
    flat = F.coalesce(F.nullif("raw_text", F.lit("")), F.col("layout_text"), F.lit(""))
    rows = pages.withColumn("_lines", normalize_lines(layout)).withColumn("flat_text", normalize_text(flat))
    readable = (F.col("_lines") != "") | (F.col("flat_text") != "")
    records = rows.filter(readable).select(
        "doc_id",
        "page",
        F.coalesce(F.nullif("_lines", F.lit("")), F.col("flat_text")).alias("text"),
        F.coalesce(F.nullif("flat_text", F.lit("")), normalize_text("_lines")).alias("flat_text"),
    )
    warnings = rows.filter(~readable).select(
        "doc_id", "page", F.concat(F.lit("p."), F.col("page").cast("string"), F.lit(": no text")).alias("warning")
    )
    return records, warnings
