"""Text pipeline over `documents`: each stage's result is written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from curricle.llm import stages
from curricle.llm.frames import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stages.keep_quality),
    ("line_chunks", stages.drop_repeated_lines),
    ("simhash_pivots", stages.keep_one_of_each_group),
    ("fm_index", stages.drop_contaminated),
    ("trie_bpe", stages.encode),
]

#: No SQL engine says fingerprints, index searches or merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs)
    return docs
