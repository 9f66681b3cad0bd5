"""User-defined surface: tokenizer plug-in and a table function for SQL users."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from curricle.functions.exprs import ColumnLike, col
from curricle.functions.fragments import terms_rule


def register_tokenizer(
    spark: SparkSession,
    fn: Callable[[Iterator[pd.Series]], Iterator[pd.Series]],
    name: str | None = None,
    max_chars: int = 1 << 20,
) -> Callable[[ColumnLike], Column]:
    """Turn an analyser into a tokenizer usable wherever ``tokenize`` is.

    ``fn`` is an iterator of batches, so a model is loaded once per worker.  The
    batches travel as Arrow and hold about ``max_chars`` characters, or one longer text, so
    that their tokens fit into a worker whatever the texts' lengths.  With ``name`` the
    tokenizer is a SQL function too.
    """

    def bounded(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            sizes = texts.str.len().fillna(0).astype("int64")
            full = ((sizes.cumsum() - sizes) // max_chars).to_numpy()
            starts = [0, *((full[1:] != full[:-1]).nonzero()[0] + 1).tolist(), len(texts)]
            for start, stop in zip(starts, starts[1:]):
                yield texts.iloc[start:stop].reset_index(drop=True)

    def batches(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from fn(bounded(series))

    batches.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(batches, "array<string>")
    if name:
        spark.udf.register(name, udf)
    return lambda c: udf(col(c))


def register_fragment_terms(spark: SparkSession, name: str = "fragment_terms_tvf") -> None:
    """SQL table function ``name(heading, kind)``, one row per term.

    Its body is the native expression of the library; no Python runs per row.
    """
    speech, material = terms_rule("heading", "speech"), terms_rule("heading", "material")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(heading STRING, kind STRING) "
        "RETURNS TABLE(ord INT, term STRING) RETURN "
        f"SELECT pos, col FROM posexplode(if(kind = 'speech', {speech}, {material}))"
    )
