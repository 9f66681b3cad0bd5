"""Stages of the corpus pipeline; each takes and returns the columns of `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curricle.llm import fm_index, line_chunks, quality_rules, simhash, trie_bpe
from curricle.llm.frames import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the quality rules keeps, unchanged."""
    ledger = quality_rules.quality_ledger(docs, whole_rows=True)
    return quality_rules.judge(ledger).filter("kept").select("document.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without line chunks that occur earlier; documents left without text go."""
    cleaned = line_chunks.dedup_lines(docs, whole_rows=True)
    fields = [
        F.col("clean_text").alias("text")
        if name == "text"
        else F.length("clean_text").cast("long").alias("n_chars")
        if name == "n_chars"
        else F.col(f"document.{name}")
        for name in docs.columns
    ]
    emptied = (F.col("n_removed_lines") > 0) & (F.trim("clean_text") == "")
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).select(*fields)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates.

    Rows that share an id are one document; rows without an id cannot be told apart and stay.
    """
    groups = simhash.near_duplicates(docs)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    marked = docs.select(F.struct("*").alias("document"), F.col("doc_id").alias("id"))
    first = marked.join(kept, F.col("id") == F.col("doc_id"), "left_semi")
    return first.unionAll(marked.filter("id IS NULL")).select("document.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves alone, unchanged."""
    found = fm_index.find_contamination(docs, table(spark, sf_dir, "benchmark"), whole_rows=True)
    return found.filter("NOT contaminated").select("document.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    return trie_bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True
    )
