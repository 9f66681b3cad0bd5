"""Guards that keep plans sound when one key is large."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= k`` is planned with a partial group limit before the
    shuffle, so each task ships at most ``k`` rows of a key, however hot it is.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that driver and executors share.

    It is named in ``spark.checkpoint.dir`` or set on the context; there is no
    default, since a folder of one machine would lose rows on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{named}/curricle-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder; its rows are made once."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
