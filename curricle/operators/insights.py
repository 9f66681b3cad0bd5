"""Gap metrics, deterministic cards and merged outside insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.operators.scale import top_rows


def _combined(coverage: DataFrame) -> DataFrame:
    return coverage.filter(F.col("mode") == "combined")


def _first_by(rows: DataFrame, size: Column, order: list[str], keep: list[str]) -> DataFrame:
    """Row with the largest size per course; ties by ``order``.

    A minimum over a struct combines on the map side, so a course with very many
    rows is reduced before anything is shuffled.
    """
    best = F.min(F.struct((-size).alias("_s"), *order, *[c for c in keep if c not in order]))
    return rows.groupBy("course_id").agg(best.alias("b")).select("course_id", *[f"b.{c}" for c in keep])


def strongest_target_gap(coverage: DataFrame) -> DataFrame:
    rows = _combined(coverage).withColumn("target_share", F.col("target_weight") / 100).withColumn(
        "gap", F.col("token_share") - F.col("target_share")
    )
    keep = ["instructor", "section_id", "title", "token_share", "target_share", "gap"]
    return _first_by(rows, F.abs("gap"), ["instructor_ord", "section_ord"], keep)


def _with_peer_average(coverage: DataFrame) -> DataFrame:
    return _combined(coverage).withColumn("peer_share", F.round("average_share", 6))


def strongest_peer_gap(coverage: DataFrame) -> DataFrame:
    sums = _with_peer_average(coverage).groupBy("course_id", "instructor", "instructor_ord").agg(
        F.sum(F.abs(F.col("token_share") - F.col("peer_share"))).alias("total_gap")
    )
    return _first_by(sums, F.col("total_gap"), ["instructor_ord"], ["instructor", "total_gap"])


def curriculum_drift(coverage: DataFrame) -> DataFrame:
    rows = (
        _with_peer_average(coverage)
        .groupBy("course_id", "section_ord", "section_id", "title")
        .agg(F.first("peer_share").alias("average_share"), F.first("target_weight").alias("w"))
        .withColumn("target_share", F.col("w") / 100)
        .withColumn("gap", F.col("average_share") - F.col("target_share"))
    )
    keep = ["section_id", "title", "average_share", "target_share", "gap"]
    return _first_by(rows, F.abs("gap"), ["section_ord"], keep)


def gap_rows(coverage: DataFrame) -> DataFrame:
    """Actual against target in percent per instructor and section."""
    return (
        _combined(coverage)
        .withColumn("actual", F.round(F.col("token_share") * 100, 1))
        .withColumn("benchmark", F.round("target_weight", 1))
        .withColumn("gap", F.round(F.abs(F.col("actual") - F.col("benchmark")), 1))
        .withColumn("direction", F.when(F.col("actual") < F.col("benchmark"), "raise").otherwise("trim"))
        .select(
            "course_id", "instructor", "instructor_ord", "section_id", "section_ord", "title",
            "actual", "benchmark", "gap", "direction",
        )
    )


def gap_report(coverage: DataFrame, top: int = 4) -> DataFrame:
    """Largest gaps per instructor (or the first section) and the capped total."""
    keys = ["course_id", "instructor"]
    best = top_rows(gap_rows(coverage), keys, [F.col("gap").desc(), "section_ord"], top).filter(
        (F.col("gap") > 0) | (F.col("rank") == 1)
    )
    totals = best.groupBy(*keys).agg(
        F.least(F.round(F.sum("gap"), 1), F.lit(100.0)).alias("total_gap")
    )
    return best.join(totals, keys)


def insight_cards(
    target_gap: DataFrame,
    peer_gap: DataFrame,
    drift: DataFrame,
    ranked_off: DataFrame,
    common_off: DataFrame,
    instructors: DataFrame,
) -> DataFrame:
    """Five cards per course in fixed order; absent metrics get a neutral text."""
    courses = instructors.select("course_id").distinct()

    def pct(c: str) -> Column:
        return F.round(F.col(c) * 100, 1).cast("string")

    def words(ranked: DataFrame, by: list[str]) -> DataFrame:
        return ranked.filter(F.col("rank") <= 3).groupBy(*by).agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", "
            ).alias("words")
        )

    def card(rows: DataFrame, order: int, category: str, issue: Column, evidence: Column) -> DataFrame:
        return courses.join(rows, "course_id", "left").select(
            "course_id",
            F.lit(order).alias("card_no"),
            F.lit(category).alias("category"),
            issue.alias("issue"),
            evidence.alias("evidence"),
        )

    def or_text(c: Column, text: str) -> Column:
        return F.coalesce(c, F.lit(text))

    first_off = (
        ranked_off.filter(F.col("mode") == "combined")
        .select("course_id", "instructor")
        .distinct()
        .join(instructors, ["course_id", "instructor"])
        .groupBy("course_id")
        .agg(F.min_by("instructor", "instructor_ord").alias("instructor"))
    )
    own_words = words(
        ranked_off.filter(F.col("mode") == "combined").join(first_off, ["course_id", "instructor"]),
        ["course_id", "instructor"],
    )
    nobody, nothing = "no instructor", "no section"
    return (
        card(
            target_gap, 1, "target-gap",
            F.concat(or_text(F.col("instructor"), nobody), F.lit(" is furthest from the target in "), or_text(F.col("title"), nothing)),
            F.concat(
                F.lit("actual "), or_text(pct("token_share"), "0.0"), F.lit("%, target "), or_text(pct("target_share"), "0.0"),
                F.lit("%, difference "), or_text(pct("gap"), "0.0"), F.lit(" points"),
            ),
        )
        .unionByName(
            card(
                peer_gap, 2, "avg-gap",
                F.concat(or_text(F.col("instructor"), nobody), F.lit(" deviates most from the other instructors")),
                F.concat(F.lit("sum of deviations "), or_text(pct("total_gap"), "0.0"), F.lit(" points")),
            )
        )
        .unionByName(
            card(
                own_words, 3, "off-curriculum-individual",
                F.concat(or_text(F.col("instructor"), nobody), F.lit(" stresses terms outside the curriculum")),
                or_text(F.col("words"), "no special terms"),
            )
        )
        .unionByName(
            card(
                drift, 4, "curriculum-drift",
                F.concat(or_text(F.col("title"), nothing), F.lit(" differs most between target and practice")),
                F.concat(
                    F.lit("mean "), or_text(pct("average_share"), "0.0"), F.lit("%, target "), or_text(pct("target_share"), "0.0"),
                    F.lit("%, difference "), or_text(pct("gap"), "0.0"), F.lit(" points"),
                ),
            )
        )
        .unionByName(
            card(
                words(common_off, ["course_id"]), 5, "off-curriculum-common",
                F.lit("several instructors teach the same terms outside the curriculum"),
                or_text(F.col("words"), "no shared terms"),
            )
        )
    )


def gap_insights(coverage: DataFrame, limit: int = 8, minimum: int = 5) -> DataFrame:
    """Insight sentences per course: section means, large single gaps, a filler.

    Only the first ``limit`` single gaps can ever be shown, so they are cut per
    task before they are put in order.
    """
    gaps = gap_rows(coverage)
    means = (
        gaps.groupBy("course_id", "section_id", "section_ord", "title")
        .agg(F.round(F.avg("actual"), 1).alias("value"), F.first("benchmark").alias("benchmark"))
        .withColumn("gap", F.round(F.abs(F.col("value") - F.col("benchmark")), 1))
        .filter(F.col("gap") > 0)
    )
    sections = means.select(
        "course_id", F.lit(1).alias("part"), (-F.col("gap")).alias("o1"), F.col("section_ord").cast("long").alias("o2"),
        F.col("title").alias("subject"), "value", "benchmark", "gap",
        F.when(F.col("value") < F.col("benchmark"), "below").otherwise("above").alias("side"),
    )
    report = gap_report(coverage)
    single = report.filter((F.col("rank") == 1) & (F.col("gap") >= 5)).select(
        "course_id", F.lit(2).alias("part"), F.lit(0.0).alias("o1"), F.col("instructor_ord").cast("long").alias("o2"),
        F.concat("instructor", F.lit(": "), "title").alias("subject"),
        F.col("actual").alias("value"), "benchmark", "gap",
        F.when(F.col("actual") < F.col("benchmark"), "below").otherwise("above").alias("side"),
    )
    listed = top_rows(sections, ["course_id"], ["o1", "o2"], limit, "n").drop("n").unionByName(
        top_rows(single, ["course_id"], ["o1", "o2"], limit, "n").drop("n")
    )
    totals = (
        report.groupBy("course_id", "instructor")
        .agg(F.first("total_gap").alias("total_gap"))
        .groupBy("course_id")
        .agg(F.round(F.avg("total_gap"), 1).alias("value"))
    )
    counts = listed.groupBy("course_id").agg(F.count("*").alias("listed"))
    filler = (
        totals.join(counts, "course_id", "left")
        .filter(F.coalesce("listed", F.lit(0)) < minimum)
        .select(
            "course_id", F.lit(3).alias("part"), F.lit(0.0).alias("o1"), F.lit(0).cast("long").alias("o2"),
            F.lit("mean of the summed gaps").alias("subject"), "value", F.lit(0.0).alias("benchmark"),
            F.col("value").alias("gap"), F.lit("above").alias("side"),
        )
    )
    ordered = top_rows(listed.unionByName(filler), ["course_id"], ["part", "o1", "o2"], limit, "pos")
    return ordered.select("course_id", "pos", "subject", "value", "benchmark", "gap", "side")


INSIGHT_SCHEMA = (
    "struct<insights: array<struct<text: string, numbers: array<struct<label: string, value: double, "
    "benchmark: double, topic: string>>>>, trendAnalysis: array<struct<title: string, detail: string, "
    "badge: string, comparison: string>>>"
)


def merge_external_insights(external: DataFrame, fallback: DataFrame) -> DataFrame:
    """Outside insight JSON (``course_id, raw``), cleaned, with rule results behind it.

    ``fallback`` has ``course_id, insights, trends`` arrays of the same types.
    """
    parsed = external.withColumn("j", F.from_json("raw", INSIGHT_SCHEMA)).select(
        "course_id",
        F.expr(
            "transform(filter(slice(coalesce(j.insights, array()), 1, 10), i -> coalesce(i.text, '') <> ''), "
            "i -> named_struct('text', i.text, 'numbers', transform(coalesce(i.numbers, array()), n -> named_struct("
            "'label', coalesce(n.label, ''), 'value', coalesce(n.value, 0D), 'benchmark', coalesce(n.benchmark, 0D), "
            "'topic', coalesce(n.topic, '')))))"
        ).alias("x_insights"),
        F.expr(
            "transform(filter(slice(coalesce(j.trendAnalysis, array()), 1, 6), t -> coalesce(t.title, '') <> ''), "
            "t -> named_struct('title', t.title, 'detail', coalesce(t.detail, ''), 'badge', "
            f"if(t.badge IN ('{fv.TREND_BADGES[0]}', '{fv.TREND_BADGES[1]}', '{fv.TREND_BADGES[2]}'), t.badge, "
            f"'{fv.TREND_BADGES[0]}'), 'comparison', coalesce(t.comparison, '')))"
        ).alias("x_trends"),
    )
    joined = fallback.join(parsed, "course_id", "left")
    return joined.select(
        "course_id",
        F.expr("if(coalesce(size(x_insights), 0) >= 5, x_insights, insights)").alias("insights"),
        F.expr("if(coalesce(size(x_trends), 0) >= 2, x_trends, trends)").alias("trends"),
    )
