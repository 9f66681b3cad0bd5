"""Assignments → coverage grids, series and statistics.

Assignments are first summed per (course, instructor, source type, section); all
later steps work on that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.functions.exprs import one_of
from curricle.functions.text import snippet
from curricle.operators.scale import top_rows

GRID = ("course_id", "mode", "instructor")


def with_modes(df: DataFrame) -> DataFrame:
    """Fan a row out to the result modes its source type counts in."""
    modes = (
        f"CASE WHEN {one_of('source_type', fv.MATERIAL_TYPES)} THEN array('combined', 'material') "
        f"WHEN {one_of('source_type', fv.SPEECH_TYPES)} THEN array('combined', 'speech') "
        "ELSE array('combined') END"
    )
    return df.withColumn("mode", F.explode(F.expr(modes)))


def token_aggregates(assignments: DataFrame) -> DataFrame:
    """Tokens per (course, mode, instructor, section); section null = unmapped."""
    by_type = assignments.groupBy("course_id", "instructor", "source_type", "section_id").agg(
        F.sum(F.col("token_count").cast("long")).alias("tokens")
    )
    return (
        with_modes(by_type).groupBy(*GRID, "section_id").agg(F.sum("tokens").alias("tokens"))
    )


def coverage_grid(instructors: DataFrame, sections: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Every active instructor × section × mode, with zero where nothing was found.

    ``instructors`` has ``course_id, instructor, instructor_ord``.  The grid comes
    from an equi-join on the course.
    """
    # one row per lane with its few sections as a map: the aggregates are read once
    cell = F.when(F.col("section_id").isNotNull(), F.struct("section_id", "tokens"))
    unmapped = F.when(F.col("section_id").isNull(), F.col("tokens")).otherwise(0)
    totals = aggregates.groupBy(*GRID).agg(
        F.sum("tokens").alias("total_tokens"),
        F.sum(unmapped).alias("unmapped_tokens"),
        F.map_from_entries(F.collect_list(cell)).alias("_cells"),
    )
    modes = F.array(*[F.lit(m) for m in fv.MODES])
    lanes = (
        instructors.select("course_id", "instructor", "instructor_ord")
        .withColumn("mode", F.explode(modes))
        .join(totals, list(GRID), "left")
    )
    dims = sections.select("course_id", "section_ord", "section_id", "title", "target_weight")
    zero = F.lit(0).cast("long")
    return (
        lanes.join(dims, "course_id")
        .withColumn("section_tokens", F.coalesce(F.col("_cells")[F.col("section_id")], zero))
        .withColumn("total_tokens", F.coalesce("total_tokens", zero))
        .withColumn("unmapped_tokens", F.coalesce("unmapped_tokens", zero))
        .drop("_cells")
    )


def instructor_coverage(grid: DataFrame) -> DataFrame:
    """Shares of mapped tokens and their deviation from the mean of all instructors."""
    mapped = F.greatest(F.col("total_tokens") - F.col("unmapped_tokens"), F.lit(0))
    shares = grid.withColumn("mapped_tokens", mapped).withColumn(
        "token_share",
        F.when(F.col("mapped_tokens") > 0, F.col("section_tokens") / F.col("mapped_tokens")).otherwise(
            0.0
        ),
    ).withColumn(
        "unmapped_share",
        F.when(F.col("total_tokens") > 0, F.col("unmapped_tokens") / F.col("total_tokens")).otherwise(
            0.0
        ),
    )
    # the grid holds a row per instructor and section of a course, not its chunks
    everyone = Window.partitionBy("course_id", "mode", "section_id")
    return shares.withColumn("average_share", F.avg("token_share").over(everyone)).withColumn(
        "deviation", F.col("token_share") - F.col("average_share")
    )


def instructor_summary(coverage: DataFrame) -> DataFrame:
    """One row per (course, mode, instructor) with its totals."""
    return coverage.groupBy(*GRID, "instructor_ord").agg(
        *[
            F.first(c).alias(c)
            for c in ("total_tokens", "unmapped_tokens", "mapped_tokens", "unmapped_share")
        ]
    )


def mode_series(coverage: DataFrame) -> DataFrame:
    return coverage.select(
        *GRID, "instructor_ord", "section_id", "section_ord", "title",
        F.round("token_share", 6).alias("share"),
    )


def average_series(coverage: DataFrame) -> DataFrame:
    """Mean of the unrounded shares, rounded once."""
    return coverage.groupBy("course_id", "mode", "section_id", "section_ord", "title").agg(
        F.round(F.avg("token_share"), 6).alias("share")
    )


def unmapped_series(coverage: DataFrame) -> DataFrame:
    """Unmapped share per instructor, and the mean in the row without instructor."""
    summary = instructor_summary(coverage)
    each = summary.select(*GRID, F.round("unmapped_share", 6).alias("share"))
    mean = summary.groupBy("course_id", "mode").agg(
        F.lit(None).cast("string").alias("instructor"),
        F.round(F.avg("unmapped_share"), 6).alias("share"),
    )
    return each.unionByName(mean)


def target_series(sections: DataFrame, series: DataFrame) -> DataFrame:
    """Target line (``series`` = target) next to the instructors' lines."""
    modes = F.array(*[F.lit(m) for m in fv.MODES])
    target = sections.select(
        "course_id",
        F.explode(modes).alias("mode"),
        F.lit("target").alias("series"),
        F.lit(None).cast("string").alias("instructor"),
        "section_id",
        F.round(F.col("target_weight") / 100, 6).alias("share"),
    )
    return target.unionByName(
        series.select(
            "course_id", "mode", F.lit("instructor").alias("series"), "instructor", "section_id", "share"
        )
    )


def mode_stats(assets: DataFrame, summary: DataFrame) -> DataFrame:
    """Submitted assets and token totals per course and mode.

    ``assets`` lists submitted files and videos with a ``lane`` of ``file`` or
    ``video``, whether or not text came out of them.
    """
    files, videos = F.count_if(F.col("lane") == "file"), F.count_if(F.col("lane") == "video")
    counted = assets.groupBy("course_id").agg(files.alias("files"), videos.alias("videos"))
    totals = summary.groupBy("course_id", "mode").agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("mapped_tokens").alias("mapped_tokens")
    )
    count = (
        F.when(F.col("mode") == "material", F.col("files"))
        .when(F.col("mode") == "speech", F.col("videos"))
        .otherwise(F.col("files") + F.col("videos"))
    )
    return totals.join(counted, "course_id", "left").select(
        "course_id",
        "mode",
        F.coalesce(count, F.lit(0)).cast("long").alias("asset_count"),
        "total_tokens",
        "mapped_tokens",
    )


def available_modes(stats: DataFrame) -> DataFrame:
    return stats.filter((F.col("asset_count") > 0) & (F.col("total_tokens") > 0)).select(
        "course_id", "mode"
    )


def percent_series(series: DataFrame) -> DataFrame:
    return series.select(
        *GRID, "section_id", "title", F.round(F.col("share") * 100, 2).alias("value")
    )


def asset_counts(segments: DataFrame, warnings: DataFrame) -> DataFrame:
    """Sources with text and warnings per instructor."""
    keys = ["course_id", "instructor"]
    with_text = segments.select(*keys, "source_id").distinct().groupBy(*keys).agg(
        F.count("*").alias("asset_count")
    )
    warned = warnings.groupBy(*keys).agg(F.count("*").alias("warning_count"))
    return with_text.join(warned, keys, "full").select(
        *keys,
        F.coalesce("asset_count", F.lit(0)).alias("asset_count"),
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"),
    )


def attach_voc(summaries: DataFrame, files: DataFrame, voc: DataFrame) -> DataFrame:
    """Feedback file counts and results next to the coverage summaries.

    Instructors with feedback only stay, with their zero coverage.
    """
    keys = ["course_id", "instructor"]
    counts = files.groupBy(*keys).agg(F.count("*").alias("voc_file_count"))
    return (
        summaries.join(counts, keys, "left")
        .join(voc, keys, "left")
        .withColumn("voc_file_count", F.coalesce("voc_file_count", F.lit(0)))
    )


def aggregate_scores(scores: DataFrame, by: tuple[str, ...] = ("course_id", "instructor")) -> DataFrame:
    """Weighted question means; key = group, id, label, scale; first-seen order kept.

    ``scores``: ``by`` columns, ``seq, question_id, grp, label, scale_max, average,
    response_count``.
    """
    from curricle.functions.text import normalize_text

    by = [c for c in by if c in scores.columns]
    question = F.upper(F.trim(F.coalesce("question_id", F.lit(""))))
    group = F.upper(F.trim(F.coalesce("grp", F.lit(""))))
    rows = scores.select(
        *by,
        "seq",
        question.alias("question_id"),
        F.coalesce(F.nullif(group, F.lit("")), question).alias("grp"),
        normalize_text(F.coalesce("label", F.lit(""))).alias("label"),
        F.coalesce(F.nullif(F.col("scale_max").cast("int"), F.lit(0)), F.lit(5)).alias("scale_max"),
        F.greatest(F.lit(0), F.coalesce(F.col("response_count"), F.lit(0))).cast("long").alias("n"),
        F.coalesce("average", F.lit(0.0)).alias("average"),
    ).filter((F.col("question_id") != "") & (F.col("label") != "") & (F.col("n") > 0))
    return rows.groupBy(*by, "grp", "question_id", "label", "scale_max").agg(
        F.round(F.sum(F.col("average") * F.col("n")) / F.sum("n"), 2).alias("average"),
        F.sum("n").alias("response_count"),
        F.min("seq").alias("seq"),
    )


def group_scores(scores: DataFrame, by: tuple[str, ...] = ("course_id", "instructor")) -> DataFrame:
    """Questions nested under their group in first-seen order (a bounded catalogue)."""
    by = [c for c in by if c in scores.columns]
    name = F.coalesce(F.nullif(F.trim("grp"), F.lit("")), F.lit("기타"))
    entry = F.struct("seq", "question_id", "label", "average", "response_count", "scale_max")
    return scores.withColumn("grp", name).groupBy(*by, "grp").agg(
        F.min("seq").alias("seq"), F.sort_array(F.collect_list(entry)).alias("entries")
    )


def evidence_topk(assignments: DataFrame, k: int = fv.EVIDENCE_K) -> DataFrame:
    """Best chunks per instructor and section as evidence snippets."""
    order = [
        F.col("score").desc(), F.col("token_count").desc(), "source_id", "chunk_seq", "part_no",
    ]
    best = top_rows(
        assignments.filter(F.col("section_id").isNotNull()),
        ["course_id", "instructor", "section_id"],
        order,
        k,
    )
    return best.withColumn("snippet", snippet("text"))
