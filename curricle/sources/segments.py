"""Decoded text tables → ``segments`` (one row per piece of source text).

Every function keeps the extra columns of its input (course, run, instructor …)
and adds ``source_type, locator, text``.  Nothing here reads whole sources into
one task: pages, rows and captions stay rows, and per-source counts are ordinary
aggregates with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curricle.functions.exprs import col
from curricle.functions.text import clean_speech, format_seconds, normalize_text

SOURCE_KEYS = ("source_id",)


def ordered_join(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: join the texts of a group in the given order."""
    return F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t")))),
            lambda x: x["t"],
        ),
        separator,
    )


def _source_stats(rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
    empty = F.count_if(F.col("text") == "")
    kept = F.count_if(F.col("text") != "")
    return rows.groupBy(*keys).agg(
        empty.alias("blank_parts"),
        kept.alias("kept_parts"),
        F.when(
            kept == 0, F.concat(F.lit(kind), F.lit(": no analysable text was found"))
        ).alias("warning"),
    )


def segments_from_pages(
    pages: DataFrame, kind: str = "pdf", keys: tuple[str, ...] = SOURCE_KEYS
) -> tuple[DataFrame, DataFrame]:
    """One segment per non-blank page; the second frame counts blank pages."""
    rows = pages.withColumn("text", normalize_text(F.coalesce("text", F.lit(""))))
    segments = (
        rows.filter(F.col("text") != "")
        .withColumn("source_type", F.lit(kind))
        .withColumn("locator", F.concat(F.lit("p."), F.col("page_no").cast("string")))
        .withColumn("seq", F.col("page_no").cast("long"))
    )
    return segments, _source_stats(rows, kind, list(keys))


def segments_from_slides(
    fragments: DataFrame, keys: tuple[str, ...] = SOURCE_KEYS
) -> tuple[DataFrame, DataFrame]:
    """One segment per slide: its text fragments in order, joined by a space."""
    carried = [c for c in fragments.columns if c not in ("frag_no", "text")]
    rows = (
        fragments.withColumn("text", normalize_text(F.coalesce("text", F.lit(""))))
        .groupBy(*carried)
        .agg(ordered_join(F.col("frag_no"), F.col("text"), " ").alias("text"))
        .withColumn("text", normalize_text("text"))
    )
    segments = (
        rows.filter(F.col("text") != "")
        .withColumn("source_type", F.lit("pptx"))
        .withColumn("locator", F.concat(F.lit("s."), F.col("slide_no").cast("string")))
        .withColumn("seq", F.col("slide_no").cast("long"))
    )
    return segments, _source_stats(rows, "pptx", list(keys))


def segments_from_text(files: DataFrame) -> DataFrame:
    """One ``full`` segment per text file (``path``, ``value``); blank files warn.

    A warning that the file already has (see ``read_text_files``) is kept.
    """
    given = F.col("warning") if "warning" in files.columns else F.lit(None).cast("string")
    empty = F.when(F.col("text") == "", F.lit("text: the file is empty"))
    return files.select(
        *[c for c in files.columns if c not in ("value", "warning")],
        F.lit("text").alias("source_type"),
        F.lit("full").alias("locator"),
        F.lit(0).cast("long").alias("seq"),
        normalize_text(F.coalesce("value", F.lit(""))).alias("text"),
        given.alias("_given"),
    ).withColumn("warning", F.coalesce("_given", empty)).drop("_given")


def read_text_files(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Whole text files: ``path, value, size, modified_at, warning``.

    Bytes that are no UTF-8 are left out and the file gets a warning.  ``expected`` (``path``,
    as Spark names files) lists files that should be there: one that has vanished, even
    while the folder is read, and one without any byte come as a row without a value.
    """
    scan = (
        spark.read.option("ignoreMissingFiles", "true")
        .text(path, wholetext=True, recursiveFileLookup=True)
    )
    sound = F.is_valid_utf8("value")
    mended = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    found = scan.select(
        F.col("_metadata.file_path").alias("path"),
        F.when(sound, F.col("value")).otherwise(mended).alias("value"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.when(~sound, F.lit("text: bytes that are no UTF-8 were left out")).alias("warning"),
    )
    if expected is None:
        return found
    joined = expected.select(F.col("path").alias("_path")).distinct().join(
        found, F.col("_path") == F.col("path"), "full_outer"
    )
    lost = F.when(F.col("path").isNull(), F.lit("text: the file has no content or is gone"))
    return joined.select(
        F.coalesce("path", "_path").alias("path"), "value", "size", "modified_at",
        F.coalesce("warning", lost).alias("warning"),
    )


def segments_from_captions(captions: DataFrame, clean: bool = False) -> DataFrame:
    """Caption lines → segments; the locator is the start time."""
    text = clean_speech("text") if clean else normalize_text("text")
    return (
        captions.withColumn("text", text)
        .filter(F.col("text") != "")
        .withColumn("source_type", F.lit("youtube"))
        .withColumn("locator", format_seconds("start_s"))
    )


def csv_cells(lines: DataFrame) -> DataFrame:
    """Delimited lines (``source_id, row_no, line``) → long cells, any width."""
    fields = F.regexp_extract_all(
        F.concat("line", F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1)
    )
    keep = [c for c in lines.columns if c != "line"]
    quoted = F.startswith("value", F.lit('"'))
    inner = F.replace(
        F.expr("substring(value, 2, length(value) - 2)"), F.lit('""'), F.lit('"')
    )
    return lines.select(*keep, F.posexplode(fields).alias("col_no", "value")).withColumn(
        "value", F.when(quoted, inner).otherwise(F.col("value"))
    )


def verbalize_rows(
    cells: DataFrame, header_row: int = 0, keys: tuple[str, ...] = SOURCE_KEYS
) -> DataFrame:
    """Rows of a cell table as ``header: value | header: value`` text.

    The header join is an equi-join on (source, column).  Sources that hold a
    large share of all rows are split at run time by the skew-join rule, and the
    grouping key is the row, so no source is ever gathered in one task.
    """
    keys = list(keys)
    data = cells.withColumn("value", normalize_text(F.coalesce("value", F.lit(""))))
    header = data.filter(F.col("row_no") == header_row).select(
        *keys, "col_no", F.col("value").alias("label")
    )
    single = (
        data.groupBy(*keys)
        .agg(F.max("row_no").alias("last_row"))
        .filter(F.col("last_row") == header_row)
        .select(*keys)
    )
    pairs = (
        data.filter((F.col("row_no") > header_row) & (F.col("value") != ""))
        .join(header, [*keys, "col_no"], "left")
        .select(
            *keys,
            "row_no",
            "col_no",
            F.when(
                F.col("label").isNotNull(),
                F.concat(
                    F.coalesce(F.nullif("label", F.lit("")), F.lit("column")), F.lit(": "), "value"
                ),
            ).alias("pair"),
            "value",
        )
    )
    rows = pairs.groupBy(*keys, "row_no").agg(
        ordered_join(F.col("col_no"), F.col("pair"), " | ").alias("verbal"),
        ordered_join(F.col("col_no"), F.col("value"), " | ").alias("bare"),
    )
    body = rows.select(
        *keys,
        (F.col("row_no") - header_row).cast("long").alias("seq"),
        F.coalesce(F.nullif("verbal", F.lit("")), F.col("bare")).alias("text"),
    )
    lone = (
        data.filter((F.col("row_no") == header_row) & (F.col("value") != ""))
        .join(single, keys, "left_semi")
        .groupBy(*keys)
        .agg(ordered_join(F.col("col_no"), F.col("value"), " | ").alias("text"))
        .select(*keys, F.lit(1).cast("long").alias("seq"), "text")
    )
    return body.unionByName(lone).select(
        *keys,
        "seq",
        F.lit("csv").alias("source_type"),
        F.concat(F.lit("row."), F.col("seq").cast("string")).alias("locator"),
        "text",
    )


def route_sources(assets: DataFrame, survey: bool = False) -> DataFrame:
    """Parser and source type by file extension; unknown extensions get a warning."""
    extension = F.lower(F.regexp_extract("original_name", r"\.([^./\\]+)$", 1))
    parser = (
        F.when(F.col("extension") == "pdf", "pages")
        .when(F.col("extension") == "pptx", "slides")
        .when(F.col("extension") == "csv", "survey_csv" if survey else "rows")
        .when(F.col("extension").isin("xlsx", "xls"), "survey_sheets" if survey else "sheets")
        .when(F.col("extension").isin("txt", "md"), "text")
    )
    return (
        assets.withColumn("extension", extension)
        .withColumn("kind", parser)
        .withColumn(
            "source_type",
            F.when(F.col("kind") == "text", F.lit("text")).otherwise(
                F.coalesce(F.nullif("extension", F.lit("")), F.lit("file"))
            ),
        )
        .withColumn(
            "warning",
            F.when(
                F.col("kind").isNull(),
                F.concat(F.col("original_name"), F.lit(": unsupported file type")),
            ),
        )
    )


def normalize_cell(value: Column, dtype: Column) -> Column:
    """Text form of one spreadsheet cell, given its stored type name."""
    number = value.try_cast("double")
    trimmed = F.regexp_replace(
        F.regexp_replace(F.format_string("%.6f", number), r"(\.\d*?)0+$", "$1"), r"\.$", ""
    )
    whole = F.when(number == F.floor(number), F.format_string("%d", number.cast("long")))
    return (
        F.when(value.isNull(), F.lit(""))
        .when(dtype == "boolean", F.upper(value))
        .when(dtype == "timestamp", F.date_format(value.try_cast("timestamp"), "yyyy-MM-dd HH:mm"))
        .when(dtype == "date", F.date_format(value.try_cast("timestamp"), "yyyy-MM-dd"))
        .when(dtype == "double", F.coalesce(whole, trimmed))
        .otherwise(normalize_text(value))
    )


def normalize_cells(cells: DataFrame, keys: tuple[str, ...] = ("sheet",)) -> DataFrame:
    """Visible, normalised cells without empty rows and without trailing blanks.

    The position of the last non-empty cell is an aggregate per row (a row is a
    bounded group); rows without one disappear with the join.
    """
    keys = list(keys)
    clean = cells.filter(F.col("visible")).select(
        *keys, "row_no", "col_no", normalize_cell(col("value"), col("dtype")).alias("value")
    )
    packed = clean.groupBy(*keys, "row_no").agg(
        F.max(F.when(F.col("value") != "", F.col("col_no"))).alias("last_col"),
        F.collect_list(F.struct("col_no", "value")).alias("row"),
    )
    return (
        packed.filter(F.col("last_col").isNotNull())
        .select(*keys, "row_no", "last_col", F.inline("row"))
        .filter(F.col("col_no") <= F.col("last_col"))
        .drop("last_col")
    )


