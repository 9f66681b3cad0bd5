"""Line dedup by content-defined chunks of lines.

Each line is hashed; a rolling hash over the last lines ends a chunk wherever it is
divisible by `divisor`.  A boundary depends on the lines just before it alone, so an
inserted line moves few of them, and passages that two documents share fall into equal
chunks.  A chunk of two lines or more that occurs earlier in the corpus is removed.

Plan: chunks are made row by row (no shuffle) and grouped by hash and text, which is the
byte comparison; copies meet in the map-side combine.  One narrow row per repeated hash
says whether all its texts are equal.  If so, occurrences join by hash alone; where one
hash stands for different texts, they are grouped and joined by text.  Removed chunks meet
their document in a left join.  Texts are shuffled twice in all: once for the comparison,
once for the removal.  No window, no Python, no gathered group; a hot chunk is a skewed
join, which adaptive execution splits.

The first copy is the one with the least (id, chunk number); nulls sort first.  Rows with
equal id and text are alike: all get the same verdict.  Null and empty texts have no
chunks and stay as they are.  Other columns are ignored, or carried along as a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curricle.llm.frames import document_key, spread_join, stored

DIVISOR = 4
#: The rolling hash of line i is (h[i] + BASE * h[i - 1]) mod MODULUS.
BASE = 31
MODULUS = 1_000_003
MIN_LINES = 2


def line_hash(line: Column) -> Column:
    """The first 32 bits of MD5, which SQL engines agree on."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column, divisor: int = DIVISOR) -> Column:
    """Array of (chunk, first_line, n_lines, chunk_text); null for a null or empty text."""
    lines = F.split(text, "\n")
    def with_lines(line_array: Column) -> Column:
        hashes = F.transform(line_array, line_hash)
        return F.struct(line_array.alias("l"), hashes.alias("g"))

    bound = F.transform(F.array(lines), with_lines)[0]

    def starts(both: Column) -> Column:
        hashes, line_array = both["g"], both["l"]
        before = lambda i, k: hashes[F.greatest(i - F.lit(k), F.lit(0))]
        rolled = lambda i: before(i, 1) + F.when(i > 1, before(i, 2) * BASE).otherwise(0)
        found = F.filter(
            F.sequence(F.lit(0), F.size(line_array) - 1),
            lambda i: (i == 0) | (rolled(i) % MODULUS % divisor == 0),
        )
        return F.struct(line_array.alias("l"), found.alias("s"))

    def pieces(both: Column) -> Column:
        line_array, begin = both["l"], both["s"]

        def piece(start: Column, k: Column) -> Column:
            last = F.size(begin) - 1
            stop = F.when(k < last, begin[F.least(k + 1, last)]).otherwise(F.size(line_array))
            return F.struct(
                k.alias("chunk"),
                start.alias("first_line"),
                (stop - start).alias("n_lines"),
                F.array_join(F.slice(line_array, start + 1, stop - start), "\n").alias("chunk_text"),
            )

        return F.transform(begin, piece)

    made = F.transform(F.transform(F.array(bound), starts), pieces)[0]
    return F.when(text != "", made)


def line_chunks(docs: DataFrame, id_col: str, text_col: str, divisor: int = DIVISOR) -> DataFrame:
    """One row per chunk of at least MIN_LINES lines: key, chunk, n_lines, chunk_text."""
    return (
        docs.select(document_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
        .select("key", F.inline(chunks_of(F.col("text"), divisor)))
        .filter(F.col("n_lines") >= MIN_LINES)
    )


def repeated_chunks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    divisor: int = DIVISOR,
    hash_bits: int = 64,
) -> DataFrame:
    """Chunks to remove: key, chunk.  hash_bits below 64 makes hashes collide, for tests."""
    hashed = F.xxhash64("chunk_text")
    if hash_bits < 64:
        hashed = F.pmod(hashed, F.lit(1 << hash_bits))
    found = line_chunks(docs, id_col, text_col, divisor).withColumn("h", hashed)
    place = F.struct(
        F.col("key.id").alias("id"), F.col("key.hash").alias("hash"), F.col("chunk").alias("chunk")
    )
    occurrences = stored(found.select("h", place.alias("place")))
    first = (
        occurrences.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
        .filter("n > 1")
    )
    texts = found.groupBy("h", "chunk_text").agg(F.count(F.lit(1)).alias("n"))
    n_texts = texts.groupBy("h").agg(F.count(F.lit(1)).alias("n_texts"))
    verdict = stored(first.join(n_texts, "h").select("h", "first", "n_texts"))
    pairs = spread_join(occurrences, verdict.filter("n_texts = 1").select("h", "first"), "h")
    later = pairs.select("place", "first")
    mixed = verdict.filter("n_texts > 1").select("h")
    if not mixed.isEmpty():
        # equal hashes of different texts: the same again, by text
        clash = spread_join(found, mixed, "h", "left_semi").select("chunk_text", place.alias("place"))
        first = clash.groupBy("chunk_text").agg(F.min("place").alias("first"))
        later = later.unionAll(spread_join(clash, first, "chunk_text").select("place", "first"))
    return later.filter(F.col("place") != F.col("first")).select(
        F.struct(F.col("place.id").alias("id"), F.col("place.hash").alias("hash")).alias("key"),
        F.col("place.chunk").alias("chunk"),
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    divisor: int = DIVISOR,
    whole_rows: bool = False,
    hash_bits: int = 64,
) -> DataFrame:
    """One row per document: id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, clean_text.

    With whole_rows the input row comes along as the struct `document`.
    """
    removed = (
        repeated_chunks(docs, id_col, text_col, divisor, hash_bits)
        .groupBy("key")
        .agg(F.collect_set("chunk").alias("removed"))
        .withColumnRenamed("key", "removed_key")
    )
    row = [F.struct("*").alias("document")] if whole_rows else []
    marked = docs.select(
        document_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"), *row
    ).join(removed, F.col("key") == F.col("removed_key"), "left")
    none = F.array().cast("array<int>")
    cleaned = marked.withColumn("gone", F.coalesce("removed", none)).withColumn(
        "chunks", F.when(F.size("gone") > 0, chunks_of(F.col("text"), divisor))
    )
    kept = F.filter("chunks", lambda c: ~F.array_contains(F.col("gone"), c["chunk"]))
    lost = F.filter("chunks", lambda c: F.array_contains(F.col("gone"), c["chunk"]))
    n_lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0).otherwise(
        F.size(F.split("text", "\n"))
    )
    return cleaned.select(
        *(["document"] if whole_rows else []),
        F.col("key.id").alias("doc_id"),
        n_lines.cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed_chunks"),
        F.coalesce(
            F.aggregate(lost, F.lit(0), lambda a, c: a + c["n_lines"]), F.lit(0)
        ).cast("long").alias("n_removed_lines"),
        F.when(F.size("gone") == 0, F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda c: c["chunk_text"]), "\n"))
        .alias("clean_text"),
    )
