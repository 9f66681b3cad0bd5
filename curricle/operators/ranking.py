"""Rankings that are not tied to one family: margins, samples, excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curricle import fixed_values as fv
from curricle.operators.scale import shared_folder, top_rows


def select_with_margin(
    candidates: DataFrame, keys: list[str], order: list, margin: float = fv.SELECTION_MARGIN
) -> DataFrame:
    """Best candidate per key; ``chosen`` is false when the second is too close."""
    best = top_rows(candidates, keys, [F.col("score").desc(), *order], 2)
    second = best.filter(F.col("rank") == 2).select(*keys, F.col("score").alias("second_score"))
    return (
        best.filter(F.col("rank") == 1)
        .join(second, keys, "left")
        .withColumn(
            "chosen",
            F.col("second_score").isNull() | (F.col("score") >= F.col("second_score") + margin),
        )
        .drop("rank")
    )


def dense_positions(
    df: DataFrame, keys: list[str], order: str | list[str], width: int | None = None
) -> DataFrame:
    """0-based position ``pos`` of each row of a key in the order of any sortable columns.

    Rows are dealt to ranges of (keys, order), whose borders Spark samples from the values,
    and sorted there, so neither sparse or hashed ids nor a key with very many rows fill one
    task.  A range numbers its own rows; what it holds of a key is offset by the counts of
    the ranges before.  The ranges are written once to the shared folder, as another
    evaluation might sample other borders.  There are as many ranges as shuffle partitions,
    or one per ``width`` rows.  The order is unique per key.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = [*keys, *order]
    ranged = df.repartitionByRange(-(-df.count() // width) or 1, *by) if width else df.repartitionByRange(*by)
    numbered = ranged.sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    path = shared_folder(df.sparkSession)
    numbered.withColumn("_part", F.shiftright("_at", 33).cast("int")).write.parquet(path)
    rows = df.sparkSession.read.schema(f"{_ddl(df)}_at bigint, _part int").parquet(path)
    held = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")
    offsets = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_of"), offset.alias("_shift"))
    same = F.col("_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        rows.join(offsets, same)
        .withColumn("pos", F.col("_at") + F.col("_shift"))
        .select(*df.columns, "pos")
    )


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def even_sample(positioned: DataFrame, keys: list[str], n: Column | int, sizes: DataFrame) -> DataFrame:
    """Evenly spaced rows of each list: positions round(i·(N-1)/(n-1)), half to even.

    ``positioned`` has ``pos``; ``sizes`` has ``keys, total``.  The wanted positions
    are computed per key and joined to the rows, which needs no ordering.
    """
    size = n if isinstance(n, Column) else F.lit(n)
    wanted = (
        sizes.withColumn("_k", size)
        .filter((F.col("_k") > 0) & (F.col("total") > 0))
        .withColumn(
            "pos",
            F.explode(
                F.expr(
                    "array_distinct(if(total <= _k, sequence(0L, total - 1), transform(sequence(0, int(_k) - 1), "
                    "i -> bigint(bround(i * (total - 1) / greatest(1, _k - 1))))))"
                )
            ),
        )
        .select(*keys, "pos")
    )
    return positioned.join(wanted, [*keys, "pos"])


def budgeted_excerpt(
    lines: DataFrame,
    max_chars: int = fv.EXCERPT_MAX_CHARS,
    per_page: int = fv.EXCERPT_LINES_PER_PAGE,
) -> DataFrame:
    """Best lines of a document until the first one that overruns the budget.

    ``lines``: ``doc_id, page, line, score``.  Lines under four characters are not
    listed.  So a listed line costs at least its frame of eight characters, four of
    text and the line break, which bounds how many can fit; only that many are ever
    ordered per document.
    """
    distinct = lines.filter((F.col("score") > 0) & (F.length("line") >= fv.EXCERPT_MIN_LINE)).groupBy("doc_id", "page", "line").agg(F.max("score").alias("score"))
    pages = top_rows(distinct, ["doc_id", "page"], [F.col("score").desc(), "line"], per_page).drop("rank")
    cost = F.length(F.concat(F.lit("[p."), F.col("page").cast("string"), F.lit("] "), "line", F.lit("\n")))
    order = [F.col("score").desc(), "page", "line"]
    best = top_rows(pages, ["doc_id"], order, max_chars // (fv.EXCERPT_MIN_LINE + 7) + 1).withColumn("cost", cost)
    running = Window.partitionBy("doc_id").orderBy("rank")
    return best.withColumn("used", F.sum("cost").over(running)).filter(F.col("used") <= max_chars)


def excerpt_or_first_pages(
    lines: DataFrame, pages: DataFrame, max_chars: int = fv.EXCERPT_MAX_CHARS, first: int = 4
) -> DataFrame:
    """The budgeted excerpt; documents without one give the beginnings of their first pages.

    ``pages``: ``doc_id, page, text``.  Such rows have no score.
    """
    columns = ["doc_id", "page", "line", "score", "used"]
    listed = budgeted_excerpt(lines, max_chars).select(*columns)
    rest = pages.join(listed.select("doc_id").distinct(), "doc_id", "left_anti")
    begun = top_rows(rest, ["doc_id"], ["page"], first).withColumn(
        "line", F.substring("text", 1, max_chars // 4)
    )
    none = [F.lit(None).cast(listed.schema[c].dataType).alias(c) for c in ("score", "used")]
    return listed.unionByName(begun.filter(F.col("line") != "").select("doc_id", "page", "line", *none))
