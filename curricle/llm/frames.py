"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the control characters 9 to 13.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{root}/{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: cuts lineage, survives lost executors."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextlib.contextmanager
def text_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs started inside hand whole texts to Python in Arrow batches of at most `rows` rows.

    A batch is held once by the JVM, outside its heap, and once by the worker, by each task.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    # zero or less means no bound
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def gathered(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches joined until they have `rows` rows; for small rows only."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def words_of(text: Column) -> Column:
    """Words between blanks; null and blank texts have none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, BLANK_RUN)
    )


def document_key(id_col: str, text_col: str) -> Column:
    """Joins a decision back to its document.

    Rows with equal id and equal text share a key; they always get equal decisions.
    """
    return F.struct(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("hash"),
    )


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins on `key` so that adaptive execution can split a hot one.

    Spark splits a skewed join only where both sides come straight from an exchange.  After
    a groupBy on the same key one side would keep its partitioning; a second join
    expression makes both sides be dealt anew.
    """
    right = right.withColumnRenamed(key, "__key")
    joined = left.join(
        right,
        (F.col(key) == F.col("__key")) & (F.xxhash64(F.col(key)) == F.xxhash64(F.col("__key"))),
        how,
    )
    return joined if how in ("left_semi", "left_anti") else joined.drop("__key")
