"""Run inputs (nested JSON) and run results (one table per series)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ASSET = "array<struct<storage_key: string, original_name: string>>"
RUN_SCHEMA = (
    "job_id string, course_id string, course_name string, curriculum_text string, submitted_at string, "
    "analysis_mode string, page1_submission_version int, "
    "course_sections array<struct<id: string, title: string, description: string, target_weight: double>>, "
    f"instructors array<struct<name: string, mode: string, files: {_ASSET}, youtube_inputs: array<string>, "
    f"youtube_urls: array<string>, voc_files: {_ASSET}>>"
)


def read_run_inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sections, instructors, assets)`` of all run documents under a path.

    Missing fields of older documents get their defaults; a lane without a mode
    takes the mode of the assets it holds.
    """
    return split_run_inputs(spark.read.schema(RUN_SCHEMA).json(path))


def split_run_inputs(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    runs = documents.select(
        F.col("job_id").alias("run_id"),
        F.coalesce("course_id", F.lit("legacy-course")).alias("course_id"),
        F.coalesce("course_name", F.lit("Legacy Course")).alias("course_name"),
        F.coalesce("analysis_mode", F.lit("auto")).alias("analysis_mode"),
        F.coalesce("page1_submission_version", F.lit(1)).alias("submission_version"),
        "course_sections",
        "instructors",
    )
    sections = runs.select(
        "run_id", "course_id", F.posexplode("course_sections").alias("section_ord", "s")
    ).select(
        "run_id", "course_id", (F.col("section_ord") + 1).alias("section_ord"), F.col("s.id").alias("section_id"),
        "s.title", "s.description", F.coalesce("s.target_weight", F.lit(0.0)).alias("target_weight"),
    )
    lanes = runs.select(
        "run_id", "course_id", "course_name", "analysis_mode", "submission_version",
        F.posexplode("instructors").alias("instructor_ord", "i"),
    )

    def filled(path: str):
        return F.coalesce(F.size(path) > 0, F.lit(False))

    given = F.lower(F.trim("i.mode"))
    inferred = (
        F.when(filled("i.files"), "files")
        .when(filled("i.youtube_inputs") | filled("i.youtube_urls"), "youtube")
        .when(filled("i.voc_files"), "voc")
        .otherwise("files")
    )
    mode = F.when(given.isNull(), inferred).when(given.isin("youtube", "voc"), given).otherwise("files")
    instructors = lanes.select(
        "run_id", "course_id", "course_name", "analysis_mode", "submission_version",
        (F.col("instructor_ord") + 1).alias("instructor_ord"), F.col("i.name").alias("instructor"), mode.alias("mode"),
    )
    lane = lanes.select("run_id", "course_id", (F.col("instructor_ord") + 1).alias("instructor_ord"), "i")
    keys = ["run_id", "course_id", "instructor_ord", F.col("i.name").alias("instructor")]

    def stored(field: str, kind: str) -> DataFrame:
        return lane.select(*keys, F.posexplode(f"i.{field}").alias("asset_seq", "a")).select(
            "run_id", "course_id", "instructor_ord", "instructor", F.lit(kind).alias("kind"), "asset_seq",
            F.col("a.original_name").alias("name"), F.col("a.storage_key").alias("url"),
        )

    def linked(field: str, kind: str) -> DataFrame:
        source = f"i.{field}"
        values = F.coalesce("i.youtube_inputs", "i.youtube_urls") if field == "youtube_inputs" else F.col(source)
        return lane.select(*keys, F.posexplode(values).alias("asset_seq", "url")).select(
            "run_id", "course_id", "instructor_ord", "instructor", F.lit(kind).alias("kind"), "asset_seq",
            F.lit(None).cast("string").alias("name"), "url",
        )

    assets = (
        stored("files", "file")
        .unionByName(linked("youtube_inputs", "video_input"))
        .unionByName(linked("youtube_urls", "video"))
        .unionByName(stored("voc_files", "voc_file"))
    )
    return sections, instructors, assets


def write_run(results: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One Parquet table per series, partitioned by run.

    With dynamic overwrite only the runs that are written are replaced.
    """
    for name, frame in results.items():
        frame.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(
            f"{path}/{name}"
        )


def export_documents(frame: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Rows of one series as JSON documents per row, for consumers outside Spark."""
    body = F.struct(*[c for c in frame.columns if c not in keys])
    return frame.select(*keys, F.to_json(body).alias("document"))
