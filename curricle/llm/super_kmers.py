"""Substring dedup over super-k-mers: windows of 35 words that occur elsewhere are removed.

The minimiser of a window is the least hash of its word m-grams, a function of its words
alone, so equal windows have equal minimisers.  Consecutive windows with one minimiser
(32 at most) overlap and are one string, a super-k-mer.

1. Minimisers are counted, by task first.  A window can be repeated only if its minimiser
   is, in another super-k-mer or in its own; super-k-mers with a minimiser of their own are settled without moving any text.
2. The others travel as packed strings to the bucket of their minimiser, where windows are
   sorted and counted by their words.
3. A minimiser with more than `hot_from` super-k-mers (frequent passages, large groups of
   copies) would make a bucket too large for a task.  Such super-k-mers are counted as
   128-bit hashes: equal strings collapse by task, windows are counted over the distinct
   strings.  At most MAX_HOT minimisers can be that frequent, so their list is broadcast.
4. Marks (first window, bits of repeated windows) meet their document in a left join; a
   word goes if a marked window covers it.

Documents travel compressed in the two joins that need their text.  Words are split at
blanks and kept unchanged; null and blank texts have none.  Rows with equal id and text
share a key, each of them counts as an occurrence, and all lose the same words.  Null ids
are kept.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curricle.llm.frames import document_key, spread_join, stored

WINDOW = 35
GRAM = 4
#: Windows that one super-k-mer has at most: their marks fit into a long.
MOST_WINDOWS = WINDOW - GRAM + 1
HOT_FROM = 5_000
#: There are at most this many frequent minimisers; it raises `hot_from` on huge inputs.
MAX_HOT = 1_000_000


def split_windows(words: list[bytes], window: int = WINDOW):
    """(minimiser, first window, number of windows, periodic) of each super-k-mer, as arrays.

    A super-k-mer is periodic if its minimiser occurs in it again: only then can it hold
    equal windows itself.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    gram = min(GRAM, window)
    n = len(words) - window + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(grams)]
    grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(29)
    # least of `span` neighbours, by doubling
    span, width, least = window - gram + 1, 1, grams
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n], least[span - width : span - width + n])
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.diff(np.concatenate([begins, [n]]))
    if sizes.max() > MOST_WINDOWS:
        pieces = -(-sizes // MOST_WINDOWS)
        inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begins = np.repeat(begins, pieces) + inside * MOST_WINDOWS
        sizes = np.diff(np.concatenate([begins, [n]]))
    minis = least[begins]
    values, rank = np.unique(grams, return_inverse=True)
    placed = np.sort(rank * (len(grams) + 1) + np.arange(len(grams)))
    own = np.searchsorted(values, minis) * (len(grams) + 1)
    stop = begins + sizes + span - 1
    times = np.searchsorted(placed, own + stop) - np.searchsorted(placed, own + begins)
    return minis.view(np.int64), begins, sizes, times > 1


def _count_minimisers(batches: Iterator, window: int) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def counted(parts):
        minis, periodic = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, place = np.unique(minis, return_inverse=True)
        # a periodic super-k-mer may repeat a window on its own, so it counts as two
        n = np.bincount(place, weights=1 + periodic, minlength=len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["mini", "n"])

    held, size = [], 0
    for batch in batches:
        for text in batch.column(0):
            minis, _, _, periodic = split_windows(text.as_py().split(), window)
            held.append((minis, periodic))
            size += len(minis)
            if size > 1 << 19:
                yield counted(held)
                held, size = [], 0
    if size:
        yield counted(held)


def _list_super_kmers(batches: Iterator, window: int, hot: frozenset | set) -> Iterator:
    """(key, mini, start, windows) of super-k-mers whose minimiser is not frequent."""
    import numpy as np
    import pyarrow as pa

    frequent = np.array(sorted(hot), np.int64)
    for batch in batches:
        rows, columns = [], []
        for row, text in enumerate(batch.column(1)):
            found = split_windows(text.as_py().split(), window)[:3]
            keep = ~np.isin(found[0], frequent)
            columns.append([x[keep] for x in found])
            rows.append(np.full(int(keep.sum()), row, np.int64))
        if not rows:
            continue
        mini, start, windows = (np.concatenate(x) for x in zip(*columns, strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.concatenate(rows))),
                pa.array(mini.astype(np.int64)),
                pa.array(start.astype(np.int32)),
                pa.array(windows.astype(np.int32)),
            ],
            ["key", "mini", "start", "windows"],
        )


def _hash_hot(batches: Iterator, window: int, hot: frozenset | set) -> Iterator:
    """(key, start, string, hashes) of super-k-mers with frequent minimisers.

    `string` is a 128-bit hash of the words; `hashes`, those of its windows, stand with
    the first occurrence in a batch and are null for the others.
    """
    import pyarrow as pa
    from xxhash import xxh3_128_digest

    for batch in batches:
        rows, starts, strings, hashes, seen = [], [], [], [], set()
        for row, text in enumerate(batch.column(1)):
            words = text.as_py().split()
            for mini, start, n in zip(*(x.tolist() for x in split_windows(words, window)[:3]), strict=True):
                if mini not in hot:
                    continue
                part = words[start : start + n + window - 1]
                string = xxh3_128_digest(b" ".join(part))
                rows.append(row)
                starts.append(start)
                strings.append(string)
                if string in seen:
                    hashes.append(None)
                else:
                    seen.add(string)
                    hashes.append(
                        [xxh3_128_digest(b" ".join(part[i : i + window])) for i in range(n)]
                    )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(rows, pa.int64())),
                pa.array(starts, pa.int32()),
                pa.array(strings, pa.binary()),
                pa.array(hashes, pa.list_(pa.binary())),
            ],
            ["key", "start", "string", "hashes"],
        )


def _compress(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = [text.as_py() for text in batch.column(1)]
        packed = [pa.compress(text, codec="zstd", asbytes=True) for text in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(packed, pa.binary()), pa.array(map(len, texts), pa.int64())],
            ["key", "packed", "size"],
        )


def _pack_super_kmers(batches: Iterator, window: int) -> Iterator:
    """From documents with their list of (mini, start, windows) to strings."""
    import pyarrow as pa

    names = ["mini", "key", "start", "words"]
    for batch in batches:
        keys = batch.column(0)
        rows, minis, starts, strings, held = [], [], [], [], 0

        def part():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(minis, pa.int64()),
                    keys.take(pa.array(rows, pa.int64())),  # noqa: B023
                    pa.array(starts, pa.int32()),
                    pa.array(strings, pa.binary()),
                ],
                names,
            )

        for row in range(len(batch)):
            size = batch.column(2)[row].as_py()
            text = pa.decompress(batch.column(1)[row].as_py(), size, codec="zstd", asbytes=True)
            words = text.split()
            for found in batch.column(3)[row].as_py():
                start = found["start"]
                string = b" ".join(words[start : start + found["windows"] + window - 1])
                rows.append(row)
                minis.append(found["mini"])
                starts.append(start)
                strings.append(string)
                held += len(string)
            if held > 8 << 20:
                yield part()
                rows, minis, starts, strings, held = [], [], [], [], 0
        yield part()


def _count_buckets(batches: Iterator, window: int) -> Iterator:
    """From strings sorted by minimiser to (key, start, mask) of those with repeated windows."""
    import pyarrow as pa

    def masks(strings: dict[bytes, list[int]]) -> dict[bytes, int]:
        """Bits of the repeated windows of each distinct string of a bucket."""
        listed = []
        for string in strings:
            words = string.split()
            for i in range(len(words) - window + 1):
                listed.append((b" ".join(words[i : i + window]), string, i))
        listed.sort()
        result = dict.fromkeys(strings, 0)
        begin = 0
        while begin < len(listed):
            end = begin + 1
            while end < len(listed) and listed[end][0] == listed[begin][0]:
                end += 1
            if end - begin > 1 or len(strings[listed[begin][1]]) > 1:
                for _, string, i in listed[begin:end]:
                    result[string] |= 1 << i
            begin = end
        return result

    def settle(rows: list[tuple], strings: dict[bytes, list[int]]):
        for string, mask in masks(strings).items():
            if mask:
                for place in strings[string]:
                    yield (*rows[place], mask)

    def out(found):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in found], key_type),
                pa.array([s for _, s, _ in found], pa.int32()),
                pa.array([m for _, _, m in found], pa.int64()),
            ],
            ["key", "start", "mask"],
        )

    current, rows, strings, found, key_type = None, [], {}, [], None
    for batch in batches:
        key_type = batch.schema.field("key").type
        columns = (batch.column(name).to_pylist() for name in ("mini", "key", "start", "words"))
        for mini, key, start, string in zip(*columns, strict=True):
            if mini != current:
                found += settle(rows, strings)
                current, rows, strings = mini, [], {}
            strings.setdefault(string, []).append(len(rows))
            rows.append((key, start))
        if len(found) > 50_000:
            yield out(found)
            found = []
    found += settle(rows, strings)
    if found:
        yield out(found)


def _cut(batches: Iterator, window: int) -> Iterator:
    """From documents with their marks to what is left of them."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        n_words, n_removed, kept_texts = [], [], []
        for row in range(len(batch)):
            size = batch.column(2)[row].as_py()
            text = pa.decompress(batch.column(1)[row].as_py(), size, codec="zstd", asbytes=True)
            words = text.split()
            steps = np.zeros(len(words) + 1, np.int64)
            for mark in batch.column(3)[row].as_py() or []:
                bits = mark["mask"]
                while bits:
                    low = bits & -bits
                    begin = mark["start"] + low.bit_length() - 1
                    steps[begin] += 1
                    steps[begin + window] -= 1
                    bits ^= low
            gone = np.cumsum(steps[:-1]) > 0
            kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if gone.any() else words
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            kept_texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n_words, pa.int64()),
                pa.array(n_removed, pa.int64()),
                pa.array(kept_texts, pa.string()),
            ],
            ["key", "n_words", "n_removed", "kept_text"],
        )


def _hot_marks(texts: DataFrame, key_type: T.StructType, window: int, hot) -> DataFrame:
    """Marks of super-k-mers with frequent minimisers, from hashes alone."""
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("start", T.IntegerType()),
            T.StructField("string", T.BinaryType()),
            T.StructField("hashes", T.ArrayType(T.BinaryType())),
        ]
    )
    found = stored(texts.mapInArrow(lambda batches: _hash_hot(batches, window, hot.value), schema))
    strings = found.groupBy("string").agg(F.count(F.lit(1)).alias("n"))
    # all occurrences of a string list the same windows; any one of them serves
    listed = (
        found.filter("hashes IS NOT NULL")
        .select("string", F.posexplode("hashes").alias("i", "w"))
        .groupBy("string", "i", "w")
        .agg(F.count(F.lit(1)).alias("listed"))
    )
    windows = stored(spread_join(listed.select("string", "i", "w"), strings, "string"))
    repeated = windows.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").select("w")
    masks = (
        spread_join(windows.select("string", "i", "w"), repeated, "w")
        .groupBy("string")
        .agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    )
    return spread_join(found.select("key", "start", "string"), masks, "string").select(
        "key", "start", "mask"
    )


def repeated_windows(
    docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, hot_from: int = HOT_FROM
) -> DataFrame:
    """Marks: key, start (first window of a super-k-mer), mask (bits of repeated windows)."""
    spark = docs.sparkSession
    key_type = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("hash", T.LongType())]
    )
    texts = docs.select(
        document_key(id_col, text_col).cast(key_type).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    counts = texts.select("text").mapInArrow(
        lambda batches: _count_minimisers(batches, window), "mini long, n long"
    )
    sums = counts.groupBy("mini").agg(F.sum("n").alias("n"))
    repeated = stored(sums.filter("n > 1"))
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot_from = max(hot_from, total // MAX_HOT)
    hot_list = repeated.filter(F.col("n") > hot_from).select("mini").collect()
    hot = spark.sparkContext.broadcast({row.mini for row in hot_list})

    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("mini", T.LongType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("windows", T.IntegerType()),
        ]
    )
    listed = texts.mapInArrow(lambda batches: _list_super_kmers(batches, window, hot.value), schema)
    open_ones = (
        spread_join(listed, repeated.filter(F.col("n") <= hot_from).select("mini"), "mini")
        .groupBy("key")
        .agg(F.collect_set(F.struct("mini", "start", "windows")).alias("found"))
    )
    travelling = T.StructType(
        [
            T.StructField("mini", T.LongType()),
            T.StructField("key", key_type),
            T.StructField("start", T.IntegerType()),
            T.StructField("words", T.BinaryType()),
        ]
    )
    packed = spread_join(_compressed(texts, key_type), open_ones, "key").select(
        "key", "packed", "size", "found"
    )
    marks_schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("start", T.IntegerType()),
            T.StructField("mask", T.LongType()),
        ]
    )
    marks = (
        packed.mapInArrow(lambda batches: _pack_super_kmers(batches, window), travelling)
        .repartition("mini")
        .sortWithinPartitions("mini")
        .mapInArrow(lambda batches: _count_buckets(batches, window), marks_schema)
    )
    if hot_list:
        marks = marks.unionAll(_hot_marks(texts, key_type, window, hot))
    return marks


def _compressed(texts: DataFrame, key_type: T.StructType) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("packed", T.BinaryType()),
            T.StructField("size", T.LongType()),
        ]
    )
    return texts.mapInArrow(_compress, schema)


def dedup_substrings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    hot_from: int = HOT_FROM,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words joined by a space)."""
    marks = repeated_windows(docs, id_col, text_col, window, hot_from)
    key_type = marks.schema["key"].dataType
    texts = docs.select(
        document_key(id_col, text_col).cast(key_type).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    by_document = marks.groupBy("key").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    schema = T.StructType(
        [
            T.StructField("key", key_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )
    return (
        spread_join(_compressed(texts, key_type), by_document, "key", "left")
        .select("key", "packed", "size", "marks")
        .mapInArrow(lambda batches: _cut(batches, window), schema)
        .select(F.col("key.id").alias("doc_id"), "n_words", "n_removed", "kept_text")
    )
