"""Benchmark decontamination with an FM-index per shard of documents.

A phrase is a window of `size` consecutive item words (a shorter item is one phrase).
Each task turns its documents, shard by shard, into word numbers of the benchmark
vocabulary.  Other words are separators: no phrase contains them.  Stretches between
separators that are shorter than the shortest phrase cannot hold one and are left out of
the index, which is all the index loses.  Over the rest a shard builds a suffix array, its
Burrows-Wheeler transform as a wavelet matrix, and suffix positions sampled at regular
steps.  All phrases are searched backwards at once through wavelet ranks; occurrences are
located by walking to sampled positions.  Overlapping occurrences merge to spans.

The benchmark reaches the tasks in blocks of at most `block_bytes` of text, each broadcast;
the corpus is read once per block and results of several blocks merge by document.  A
benchmark that fits into one block, as usual, needs no shuffle at all.

Words are runs of letters a-z, digits and non-ASCII characters after lower-casing A-Z.
Null, empty and wordless texts have no words and are not contaminated; null or wordless
items have no phrases; a null item id is listed as "null"; repeated documents are judged
alike, each row by itself; repeated items all count.  Other columns are ignored, or carried
along as a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 13
BLOCK_BYTES = 2 << 20
#: Words of text that one index covers, about; a longer document is an index of its own.
SHARD_WORDS = 500_000
SAMPLE_STEP = 8

#: Bytes that are no part of a word become blanks, A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

SPANS = T.ArrayType(
    T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())])
)


def words_of_bytes(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Phrases:
    """The distinct phrases of a block of items, as rows of word numbers from 1 on."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = SIZE):
        self.numbers: dict[bytes, int] = {}
        self.items_of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            found = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of_bytes(text)]
            for begin in range(max(1, len(found) - size + 1) if found else 0):
                phrase = tuple(found[begin : begin + size])
                self.items_of.setdefault(phrase, set()).add(item)
        self.shortest = min(map(len, self.items_of), default=0)

    def as_plain(self) -> tuple:
        """What a broadcast carries: built-in types, which every worker can read."""
        return self.numbers, self.items_of

    @staticmethod
    def from_plain(content: tuple) -> Phrases:
        phrases = Phrases([])
        phrases.numbers, phrases.items_of = content
        phrases.shortest = min(map(len, phrases.items_of), default=0)
        return phrases


class WaveletMatrix:
    """Rank over a sequence of numbers, for arrays of queries at a time."""

    def __init__(self, sequence, n_bits: int):
        import numpy as np

        self.n_bits = n_bits
        self.ones, self.zeros = [], []
        for level in range(n_bits - 1, -1, -1):
            bits = sequence >> level & 1
            before = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bits, out=before[1:], dtype=np.int32)
            self.ones.append(before)
            self.zeros.append(len(sequence) - int(before[-1]))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])

    def rank(self, symbols, ends):
        """How often each symbol occurs before its end."""
        import numpy as np

        begins, ends = np.zeros_like(ends), ends
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = symbols >> (self.n_bits - 1 - level) & 1
            begins = np.where(bit, zeros + ones[begins], begins - ones[begins])
            ends = np.where(bit, zeros + ones[ends], ends - ones[ends])
        return ends - begins

    def at(self, places):
        """The numbers at the places."""
        import numpy as np

        result = np.zeros_like(places)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[places + 1] - ones[places]
            result = result << 1 | bit
            places = np.where(bit, zeros + ones[places], places - ones[places])
        return result


def suffix_order(sequence):
    """Suffix array by prefix doubling; a suffix that ends is smaller."""
    import numpy as np

    n = len(sequence)
    _, rank = np.unique(sequence, return_inverse=True)
    rank = rank.astype(np.int64)
    width = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        width *= 2
        if n == 0 or steps[-1] == n - 1:
            return order
        if width >= n:
            return order


class FmIndex:
    """FM-index of a sequence of word numbers; 0 separates stretches and ends it."""

    def __init__(self, sequence, step: int = SAMPLE_STEP):
        import numpy as np

        self.n = len(sequence)
        order = suffix_order(sequence)
        top = int(sequence.max(initial=0)) + 1
        self.matrix = WaveletMatrix(sequence[order - 1], max(1, top.bit_length()))
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=top))])
        # a walk stops at the first word of a stretch, so it never has to pass a separator
        sampled = (order % step == 0) | (sequence[order - 1] == 0)
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = order[sampled]

    def search(self, phrases):
        """Suffix range (low, high) of each row of phrases; rows end with -1 as padding."""
        import numpy as np

        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            rows = np.flatnonzero((phrases[:, column] >= 0) & (low < high))
            if not len(rows):
                continue
            symbols = phrases[rows, column]
            known = symbols < len(self.starts) - 1
            high[rows[~known]] = low[rows[~known]]
            rows, symbols = rows[known], symbols[known]
            base = self.starts[symbols]
            low[rows], high[rows] = (
                base + self.matrix.rank(symbols, low[rows]),
                base + self.matrix.rank(symbols, high[rows]),
            )
        return low, high

    def locate(self, rows):
        """Positions in the sequence of the suffixes at these rows."""
        import numpy as np

        rows = rows.copy()
        walked = np.zeros(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            at = rows[open_rows]
            stop = self.sampled_before[at + 1] > self.sampled_before[at]
            open_rows = open_rows[~stop]
            at = at[~stop]
            symbols = self.matrix.at(at)
            rows[open_rows] = self.starts[symbols] + self.matrix.rank(symbols, at)
            walked[open_rows] += 1
        return self.samples[self.sampled_before[rows]] + walked


class Searcher:
    """Searches shards of documents for the phrases of one block."""

    def __init__(self, phrases: Phrases):
        import numpy as np

        self.phrases = phrases
        texts = list(phrases.items_of)
        self.items = [sorted(phrases.items_of[text]) for text in texts]
        self.lengths = np.array([len(text) for text in texts], np.int64)
        self.rows = np.full((len(texts), int(self.lengths.max(initial=0))), -1, np.int64)
        for number, text in enumerate(texts):
            self.rows[number, : len(text)] = text

    def search(self, shard: list[list[bytes]]):
        """For each document: merged spans (first word, words), and item ids."""
        import numpy as np

        spans: list[list[dict]] = [[] for _ in shard]
        items: list[set[str]] = [set() for _ in shard]
        if not len(self.items) or not shard:
            return spans, items
        get = self.phrases.numbers.get
        counts = np.array([len(words) for words in shard], np.int64)
        # a zero after each document keeps stretches of neighbours apart
        bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        numbers = np.zeros(bounds[-1], np.int64)
        for begin, words in zip(bounds.tolist(), shard, strict=False):
            numbers[begin : begin + len(words)] = [get(word, 0) for word in words]
        inside = np.concatenate([[0], numbers != 0, [0]]).astype(np.int8)
        edges = np.diff(inside)
        first, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = stop - first >= self.phrases.shortest
        first, stop = first[long], stop[long]
        if not len(first):
            return spans, items
        sizes = stop - first
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        sequence = np.zeros(begins[-1], np.int64)
        offsets = np.repeat(first - begins[:-1], sizes)
        places = np.arange(begins[-1])
        places = np.delete(places, begins[1:] - 1)
        sequence[places] = numbers[places + offsets]
        index = FmIndex(sequence)
        low, high = index.search(self.rows)
        hits = high - low
        found = np.repeat(np.arange(len(hits)), hits)
        if not len(found):
            return spans, items
        rows = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(len(found))
        position = index.locate(rows)
        stretch = np.searchsorted(begins, position, side="right") - 1
        place = position - begins[stretch] + first[stretch]
        document = np.searchsorted(bounds, place, side="right") - 1
        begin = place - bounds[document]
        end = begin + self.lengths[found]
        order = np.lexsort((begin, document))
        for d, a, b, phrase in zip(
            document[order].tolist(), begin[order].tolist(), end[order].tolist(), found[order].tolist(), strict=True
        ):
            items[d].update(self.items[phrase])
            if spans[d] and a <= spans[d][-1]["first_word"] + spans[d][-1]["n_words"]:
                spans[d][-1]["n_words"] = max(spans[d][-1]["n_words"], b - spans[d][-1]["first_word"])
            else:
                spans[d].append({"first_word": a, "n_words": b - a})
        return spans, items


def _search_block(docs: DataFrame, block, shard_words: int) -> DataFrame:
    """Adds n_words, spans and item_ids to (doc_id, text, *rest); `text` is dropped."""
    kept = [field for field in docs.schema.fields if field.name != "text"]
    schema = T.StructType(
        kept
        + [
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", SPANS),
            T.StructField("item_ids", T.ArrayType(T.StringType())),
        ]
    )
    names = [field.name for field in kept]

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        searcher = Searcher(Phrases.from_plain(block.value))
        span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
        for batch in batches:
            texts = batch.column("text")
            done = 0
            while done < len(batch):
                shard, held = [], 0
                while done + len(shard) < len(batch) and held < shard_words:
                    words = words_of_bytes(texts[done + len(shard)].as_py())
                    shard.append(words)
                    held += len(words)
                spans, items = searcher.search(shard)
                part = batch.slice(done, len(shard))
                yield pa.RecordBatch.from_arrays(
                    [part.column(name) for name in names]
                    + [
                        pa.array([len(words) for words in shard], pa.int64()),
                        pa.array(spans, span_type),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names + ["n_words", "spans", "item_ids"],
                )
                done += len(shard)

    return docs.mapInArrow(compute, schema)


def benchmark_blocks(
    benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most block_bytes of text, or of a single longer item."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if total <= block_bytes:
        yield [(r.item, bytes(r.text)) for r in items.collect()]
        return
    # twice as many blocks as needed, by hash: a block holds half of the limit on average
    n = 2 * -(-total // block_bytes)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    sizes = dealt.groupBy("block").agg(F.sum(F.octet_length("text") + 16).alias("size"))
    for number, size in sorted((r.block, r["size"]) for r in sizes.collect()):
        part = dealt.filter(F.col("block") == number).select("item", "text")
        if size <= 2 * block_bytes:
            yield [(r.item, bytes(r.text)) for r in part.collect()]
            continue
        held, held_bytes = [], 0
        for row in part.toLocalIterator():
            if held and held_bytes + len(row.text) > block_bytes:
                yield held
                held, held_bytes = [], 0
            held.append((row.item, bytes(row.text)))
            held_bytes += len(row.text) + 16
        yield held


def _merged(frame: DataFrame) -> DataFrame:
    """Results of several blocks by document number: spans united, items together."""
    spans = frame.select("row", F.inline("spans")).withColumn("stop", F.expr("first_word + n_words"))
    order = Window.partitionBy("row").orderBy("first_word", "stop")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("first_word") > F.coalesce(F.max("stop").over(before), F.lit(-1))
    united = (
        spans.withColumn("begins", fresh.cast("int"))
        .withColumn("part", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "part")
        .agg(F.min("first_word").alias("first_word"), F.max("stop").alias("stop"))
        .groupBy("row")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("first_word", F.expr("stop - first_word AS n_words")))
            ).alias("spans")
        )
    )
    items = (
        frame.select("row", F.explode("item_ids").alias("item"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )
    return united.join(items, "row")


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = SIZE,
    whole_rows: bool = False,
    block_bytes: int = BLOCK_BYTES,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, spans, item_ids, n_hit, contaminated.

    `spans` are the merged word ranges to remove.  With whole_rows the input row comes
    along as the struct `document`.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    row = [F.struct("*").alias("document")] if whole_rows else []
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *row)
    blocks = [
        spark.sparkContext.broadcast(Phrases(items, size).as_plain())
        for items in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    ]
    if len(blocks) == 1:
        found = _search_block(narrow, blocks[0], shard_words)
    else:
        # rows are numbered by content; equal rows have equal results
        numbered = narrow.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("hash")))
        plain = numbered.select("row", "text")
        hits = [_search_block(plain, block, shard_words).filter("size(spans) > 0") for block in blocks]
        together = hits[0]
        for more in hits[1:]:
            together = together.unionAll(more)
        count = _search_block(numbered, spark.sparkContext.broadcast(Phrases([], size).as_plain()), shard_words)
        found = (
            count.drop("spans", "item_ids")
            .join(_merged(together), "row", "left")
            .drop("row")
            .withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
            .withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
        )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["n_words"])
    return found.withColumn("n_hit", n_hit).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def remove_spans(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans; what stands between words of a span goes too."""
    begins, stops, inside = [], [], False
    for place, byte in enumerate(text.translate(WORD_BYTES)):
        if (byte != 32) != inside:
            (stops if inside else begins).append(place)
            inside = not inside
    if inside:
        stops.append(len(text))
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : begins[span["first_word"]]])
        at = stops[span["first_word"] + span["n_words"] - 1]
    return b"".join([*kept, text[at:]])
