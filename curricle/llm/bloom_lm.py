"""Language-model scores from a log-frequency Bloom filter.

Training n-grams (words and pairs) are counted over the whole training part of the corpus.
A count c is quantised to a level q: the number of thresholds ceil(BASE ** j) that it
reaches.  The filter holds the n-gram once for each level up to q; a query probes level 1,
2, ... until one is missing.  A false positive can only raise a count, and seldom by more
than a level.

    P(w)     = (f(w) + 0.5) / (N + 0.5 * (V + 1))
    P(w | v) = (f(v w) + strength * P(w)) / (g(v) + strength)

f is the least count of the level found, g the greatest: so the probabilities after any
word sum to one at most.  The word before the first, and after the last, is the end.

The filter is cut into blocks by hash.  The n-grams of a block are counted where they are
inserted, so counting takes one shuffle (after a count per batch), and a task holds only
the bits of its blocks.  Blocks are built as many as the tokens could fill to a half if no
n-gram repeated, and lie in the shared folder; so the filter grows with the corpus and every
counted n-gram is in it, at any size.  As blocks are cut by the upper bits of a key, or-ing
neighbours gives the filter of half as many: they are folded while the bits they hold stay
within one half of a block.  A filter within `filter_bytes`, the bound of the broadcast, is
broadcast.  A larger one is never whole anywhere: each batch of documents sends its distinct
keys, with their counts in its training documents, to the shelf of blocks that holds them;
there the blocks are filled from the counts of all batches and probed, and each batch gets back
its levels, one byte a key.  So one shuffle counts and asks.  Keys travel with 48 of their 64
bits; sharing those is far rarer than a false positive, and like one can only raise a count.

Base scores are exact: counts of the `head` most frequent words are broadcast (a bounded
number), all others are joined by word.  Words of the join are rare, so none is a hot key.

Null and blank texts consist of one end; a null id counts as the text '' for the split.
Each row is scored by itself.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curricle.llm.frames import gathered, stored, text_batches

BASE = 1.5
LEVELS = 64
#: THRESHOLDS[j]: the least count of level j + 1.
THRESHOLDS: list[int] = []
while len(THRESHOLDS) < LEVELS:
    THRESHOLDS.append(max(math.ceil(BASE ** len(THRESHOLDS)), THRESHOLDS[-1] + 1 if THRESHOLDS else 1))
HASHES = 5
BLOCK_BITS = 1 << 17
FILTER_BYTES = 64 << 20
BITS_PER_TOKEN = 8
#: Blocks that answer together when the filter is not broadcast (2 MB), and the text of a batch that asks.
SHELF_BLOCKS = 128
BATCH_BYTES = 4 << 20
#: N-grams that are put into the filter together.
GATHERED = 50_000
HEAD = 300_000
STRENGTH = 1000.0


def mixed(x):
    """Spreads the bits of an array of 64-bit numbers."""
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_numbers(words: list[bytes]):
    import numpy as np
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def indexed(documents: list[list[bytes]]):
    """The distinct words of some documents and, in order, the place of each word in them."""
    import numpy as np

    index: dict[bytes, int] = {}
    place = index.setdefault
    ids = [place(word, len(index)) for words in documents for word in words]
    return list(index), np.array(ids, np.int64)


def unigram_keys(numbers):
    import numpy as np

    return mixed(numbers ^ np.uint64(0x9E3779B97F4A7C15))


def bigram_keys(before, numbers):
    import numpy as np

    turned = before * np.uint64(0xD6E8FEB86659FD93)
    turned = (turned << np.uint64(31)) | (turned >> np.uint64(33))
    return mixed(turned + numbers)


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased words and the end, which is the empty word."""
    return [*text.lower().split(), b""]


def _places(keys, level: int, number: int):
    """Bits inside a block for one level and one hash function."""
    import numpy as np

    return mixed(keys + np.uint64((level * HASHES + number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(
        BLOCK_BITS - 1
    )


def _block_of(keys, n_blocks: int):
    """The block of each key: its upper bits, n_blocks being a power of two."""
    import numpy as np

    return (keys >> np.uint64(64 - n_blocks.bit_length() + 1)) if n_blocks > 1 else keys * np.uint64(0)


class LogFilter:
    """The finished filter, or its blocks from `first` on: levels of arrays of keys."""

    def __init__(self, bits, n_blocks: int, first: int = 0):
        self.bits, self.n_blocks, self.first = bits, n_blocks, first

    def levels(self, keys):
        import numpy as np

        found = np.zeros(len(keys), np.int64)
        active = np.arange(len(keys))
        start = (_block_of(keys, self.n_blocks) - np.uint64(self.first)) * np.uint64(BLOCK_BITS)
        for level in range(1, LEVELS + 1):
            for number in range(HASHES):
                at = start[active] + _places(keys[active], level, number)
                there = self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
                active = active[there == 1]
            if not len(active):
                break
            found[active] = level
        return found


def _count_tokens(batches: Iterator) -> Iterator:
    from collections import Counter

    import pyarrow as pa

    def out(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["token", "n"],
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            counts.update(tokens_of(text.as_py()))
            if len(counts) > 300_000:
                yield out(counts)
                counts = Counter()
    yield out(counts)


def _count_pairs(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def out(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"]
        )

    def keys_of(documents):
        # every document ends with the end, which is the context of the next one's first word
        distinct, ids = indexed(documents)
        numbers = word_numbers(distinct)[ids]
        return bigram_keys(np.concatenate([numbers[-1:], numbers[:-1]]), numbers)

    held, documents, size, waiting = [], [], 0, 0
    for batch in batches:
        for text in batch.column(0):
            documents.append(tokens_of(text.as_py()))
            waiting += len(documents[-1])
            if waiting > 200_000:
                held.append(keys_of(documents))
                size += waiting
                documents, waiting = [], 0
                if size > 2_000_000:
                    yield out(held)
                    held, size = [], 0
    if documents:
        held.append(keys_of(documents))
    if held:
        yield out(held)


def _word_keys(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in gathered(batches, GATHERED):
        keys = unigram_keys(word_numbers(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1)], ["key", "n"])


def _build_blocks(batches: Iterator, n_blocks: int) -> Iterator:
    """From (key, n), whole blocks in a partition, to (block, least_count, bits)."""
    import numpy as np
    import pyarrow as pa

    thresholds = np.array(THRESHOLDS, np.int64)
    # for each bit the highest level of the n-grams that set it: the bits of a filter that
    # holds n-grams from some level on are those of at least that level
    rows_of: dict[int, int] = {}
    highest = np.zeros((0, BLOCK_BITS), np.uint8)
    for batch in gathered(batches, GATHERED):
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        counts = batch.column(1).to_numpy(zero_copy_only=False)
        top = np.searchsorted(thresholds, counts, side="right").astype(np.uint8)
        blocks, row = np.unique(_block_of(keys, n_blocks).astype(np.int64), return_inverse=True)
        rows = np.array([rows_of.setdefault(block, len(rows_of)) for block in blocks.tolist()], np.int64)
        if len(rows_of) > len(highest):
            grown = np.zeros((2 * len(rows_of), BLOCK_BITS), np.uint8)
            grown[: len(highest)] = highest
            highest = grown
        start = (rows[row] if len(rows) else row).astype(np.uint64) * np.uint64(BLOCK_BITS)
        for level in range(1, int(top.max(initial=0)) + 1):
            inside = top >= level
            keys, top, start = keys[inside], top[inside], start[inside]
            for number in range(HASHES):
                np.maximum.at(highest.reshape(-1), start + _places(keys, level, number), top)
    for block, row in rows_of.items():
        held = np.cumsum(np.bincount(highest[row], minlength=LEVELS + 2)[::-1])[::-1]
        least = next(level for level in range(1, LEVELS + 2) if 2 * held[level] <= BLOCK_BITS)
        bits = np.packbits(highest[row] >= least, bitorder="little").tobytes()
        count = int(thresholds[min(least, LEVELS) - 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([count], pa.int64()), pa.array([bits], pa.binary())],
            ["block", "least_count", "bits"],
        )


class Answered:
    """Levels that the filter gave for sorted keys."""

    def __init__(self, keys, found):
        self.keys, self.found = keys, found

    def levels(self, keys):
        import numpy as np

        # sorted keys are looked up several times faster than keys in the order of the text
        asked, place = np.unique(narrowed(keys), return_inverse=True)
        return self.found[np.searchsorted(self.keys, asked)][place]


def _packed(rows) -> bytes:
    """Rows as compressed Arrow: texts are written and shuffled once each."""
    import pyarrow as pa

    out = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(out, rows.schema, options=options) as writer:
        writer.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpacked(held):
    import pyarrow as pa

    (rows,) = pa.ipc.open_stream(held.as_buffer())
    return rows


def _batched(batches: Iterator) -> Iterator:
    """From (doc_id, held_out, text) to (batch, documents): documents of about BATCH_BYTES a row, compressed."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def out(held):
        nonlocal number
        documents = _packed(pa.concat_batches(held))
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([number - 1]), pa.array([documents], pa.binary())], ["batch", "documents"]
        )

    held, size = [], 0
    for batch in batches:
        # no row is cut; a batch ends with the row that fills BATCH_BYTES, to which empty texts add too
        ends = size + np.cumsum([len(text.as_buffer()) + 16 for text in batch.column(2)], dtype=np.int64)
        first = 0
        while first < len(batch):
            full = int(np.searchsorted(ends, BATCH_BYTES))
            held.append(batch.slice(first, min(full + 1, len(batch)) - first))
            if full < len(batch):
                yield out(held)
                ends -= ends[full]
                held = []
            first = full + 1
        size = int(ends[-1]) if len(batch) else size
    if held:
        yield out(held)


def narrowed(keys):
    """Keys without their last 16 bits, as they travel: two n-grams of a corpus seldom share the others."""
    import numpy as np

    return keys & np.uint64(0xFFFFFFFFFFFF0000)


def _stretches(texts) -> Iterator:
    """From texts, for documents of about 300,000 tokens each: sizes, distinct words, the place of each token, keys of the words and of the pairs."""
    import numpy as np

    end = word_numbers([b""])
    documents, held = [], 0
    for at, text in enumerate(texts):
        documents.append(tokens_of(text.as_py()))
        held += len(documents[-1])
        if held >= 300_000 or at == len(texts) - 1:
            distinct, ids = indexed(documents)
            words = word_numbers(distinct)
            numbers = words[ids]
            # every document ends with the end, the context of the next one's first word
            pairs = bigram_keys(np.concatenate([end, numbers[:-1]]), numbers)
            yield np.array([len(words) for words in documents], np.int64), distinct, ids, unigram_keys(words), pairs
            documents, held = [], 0


def _keys_of(stretches):
    """The sorted distinct keys of a batch, its words and its pairs."""
    import numpy as np

    held = [unigram_keys(word_numbers([b""])), *(keys for *_, words, pairs in stretches for keys in (words, pairs))]
    keys = np.sort(narrowed(np.concatenate(held)))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def _asked(texts, held_out):
    """The same keys, and how often each occurs in the documents that are learned from."""
    import numpy as np

    held, times, first = [unigram_keys(word_numbers([b""]))], [np.zeros(1)], 0
    for sizes, distinct, ids, words, pairs in _stretches(texts):
        learned = np.repeat(~held_out[first : first + len(sizes)], sizes)
        held += [words, pairs]
        times += [np.bincount(ids, learned, len(distinct)), learned]
        first += len(sizes)
    keys, place = np.unique(narrowed(np.concatenate(held)), return_inverse=True)
    return keys, np.bincount(place, np.concatenate(times), len(keys)).astype(np.uint32)


def _planes(numbers, width: int) -> bytes:
    """The lowest `width` bytes of whole numbers, all first bytes first: the upper ones are mostly zero and compress."""
    import numpy as np

    return numbers.view(np.uint8).reshape(len(numbers), -1)[:, :width].T.tobytes()


def _unplaned(held, width: int, kind):
    import numpy as np

    planes = np.frombuffer(held.as_buffer(), np.uint8).reshape(width, -1)
    whole = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    whole[:, :width] = planes.T
    return whole.view(kind).reshape(-1)


def _requests(batches: Iterator, n_blocks: int) -> Iterator:
    """From (batch, documents) to (shelf, batch, keys, counts); the keys of a shelf are neighbours."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for row in range(len(batch)):
            documents = _unpacked(batch.column(1)[row])
            held_out = documents.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            keys, counts = _asked(documents.column("text"), held_out)
            shelves = _block_of(keys, n_blocks) // np.uint64(SHELF_BLOCKS)
            names, starts = np.unique(shelves, return_index=True)
            numbers = keys >> np.uint64(16)
            steps = np.diff(numbers, prepend=np.uint64(0))
            steps[starts] = numbers[starts]
            ends = [*starts[1:].tolist(), len(keys)]
            parts = list(zip(starts.tolist(), ends, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names.astype(np.int32)),
                    pa.array(np.full(len(names), batch.column(0)[row].as_py(), np.int64)),
                    pa.array([_planes(steps[a:b], 6) for a, b in parts], pa.binary()),
                    pa.array([_planes(counts[a:b], 4) for a, b in parts], pa.binary()),
                ],
                ["shelf", "batch", "keys", "counts"],
            )


def _shelf(keys, counts, n_blocks: int, first: int, size: int) -> LogFilter:
    """The filter's blocks `first` to `first + size`, from the counts of all n-grams in them."""
    import numpy as np
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])
    bits = np.zeros((size, BLOCK_BITS // 8), np.uint8)
    for built in _build_blocks(iter([batch]), n_blocks):
        # never seen: chance would have to heap half as many n-grams again into one block
        if built.column(1)[0].as_py() > 1:
            return _shelf(keys, counts, 2 * n_blocks, 2 * first, 2 * size)
        bits[built.column(0)[0].as_py() - first] = np.frombuffer(built.column(2)[0].as_buffer(), np.uint8)
    return LogFilter(bits.reshape(-1), n_blocks, first)


def _answers(requests, n_blocks: int):
    """One shelf: builds its blocks from the counts of all batches; to (batch, shelf, levels)."""
    import numpy as np
    import pyarrow as pa

    asked = [np.cumsum(_unplaned(keys, 6, np.uint64)) << np.uint64(16) for keys in requests.column("keys")]
    counts = np.concatenate([_unplaned(n, 4, np.uint32) for n in requests.column("counts")])
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, counts, len(keys)).astype(np.int64)
    size = min(SHELF_BLOCKS, n_blocks)
    learned = total > 0
    lookup = _shelf(keys[learned], total[learned], n_blocks, requests.column("shelf")[0].as_py() * SHELF_BLOCKS, size)
    levels = lookup.levels(keys).astype(np.uint8)[place]
    ends = np.cumsum([len(part) for part in asked])
    return pa.table(
        {
            "batch": requests.column("batch"),
            "shelf": requests.column("shelf"),
            "levels": pa.array([part.tobytes() for part in np.split(levels, ends[:-1])], pa.binary()),
        }
    )


def _score_answered(batches, replies, head, total: float, strength: float):
    """Scores of the documents of one batch, whose keys the filter has answered."""
    import numpy as np
    import pyarrow as pa

    rows = _unpacked(batches.column("documents")[0])
    levels = [found.as_py() for found in replies.sort_by("shelf").column("levels")]
    found = np.frombuffer(b"".join(levels), np.uint8).astype(np.int64)
    stretches = list(_stretches(rows.column("text")))
    lookup = Answered(_keys_of(stretches), found)
    if len(lookup.keys) != len(found):
        raise ValueError("a batch and the answers to it differ")
    return pa.Table.from_batches(_scores(rows, stretches, lookup, head.value, total, strength))


def _score(batches: Iterator, filter_parts, head, total: float, strength: float) -> Iterator:
    """Scores against the broadcast filter."""
    lookup = LogFilter(*filter_parts.value)
    for batch in batches:
        yield from _scores(batch, _stretches(batch.column(2)), lookup, head.value, total, strength)


def _scores(batch, stretches, lookup, counts, total: float, strength: float) -> Iterator:
    """Adds the model's score, the head's part of the base score, and the other words."""
    import numpy as np
    import pyarrow as pa

    least = np.array([0, *THRESHOLDS], np.float64)
    most = np.array([0, *[t - 1 for t in THRESHOLDS[1:]], THRESHOLDS[-1]], np.float64)
    end_level = lookup.levels(unigram_keys(word_numbers([b""])))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"]

    done = 0
    for sizes, distinct, ids, words, pairs in stretches:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        levels = lookup.levels(words)[ids]
        context = np.concatenate([end_level, levels[:-1]])
        alone = (least[levels] + 0.5) / total
        pair = least[lookup.levels(pairs)]
        score = np.log10((pair + strength * alone) / (most[context] + strength))
        logged = np.array([counts.get(word, 0.0) for word in distinct])[ids]
        # no frequent word has probability one, so a zero stands for a rare word
        rare = np.flatnonzero(logged == 0)
        document = np.repeat(np.arange(len(sizes)), sizes)[rare]
        found, times = np.unique(document * len(distinct) + ids[rare], return_counts=True)
        owner, word = np.divmod(found, len(distinct))
        tokens = pa.array(distinct, pa.binary()).take(pa.array(word))
        offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
        rare_words = pa.StructArray.from_arrays([tokens, pa.array(times.astype(np.int32))], ["token", "n"])
        part = batch.slice(done, len(sizes))
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(1),
                pa.array(sizes),
                pa.array(np.add.reduceat((logged != 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(logged, starts)),
                pa.array(np.add.reduceat(score, starts)),
                pa.ListArray.from_arrays(pa.array(offsets), rare_words),
            ],
            names,
        )
        done += len(sizes)


def _frequent(vocabulary: DataFrame, head: int) -> dict[bytes, int]:
    """Counts of at most `head` words: all from some count on."""
    sizes = vocabulary.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    least, held = None, 0
    # there are fewer different counts than the square root of twice the tokens
    for row in sizes.orderBy(F.desc("n")).toLocalIterator():
        held += row["words"]
        if held > head:
            break
        least = row["n"]
    if least is None:
        return {}
    return {bytes(r["token"]): r["n"] for r in vocabulary.filter(F.col("n") >= least).collect()}


def _blocks_for(n_tokens: int, bits_per_token: int) -> int:
    """So many blocks that the n-grams fill a half, a power of two."""
    # a token adds a level to its word and to its pair at most, so even if none repeats
    # the places they set are one half of these bits
    wanted = n_tokens * max(bits_per_token, 2 * 2 * HASHES)
    return 1 << (-(-wanted // BLOCK_BITS) - 1).bit_length()


def _built(training: DataFrame, vocabulary: DataFrame, n_tokens: int, bits_per_token: int):
    """The stored blocks (block, held, bits) with all n-grams, and their number."""
    n_blocks = _blocks_for(n_tokens, bits_per_token)
    words = vocabulary.mapInArrow(_word_keys, "key long, n long")
    ngrams = training.mapInArrow(_count_pairs, "key long, n long").unionAll(words)
    while True:
        shift = 64 - (n_blocks.bit_length() - 1)
        block = F.shiftrightunsigned("key", shift) if n_blocks > 1 else F.lit(0).cast("long")
        counted = (
            ngrams.withColumn("block", block)
            .repartition("block")
            .groupBy("block", "key")
            .agg(F.sum("n").alias("n"))
        )
        blocks = counted.select("key", "n").mapInArrow(
            lambda batches, n=n_blocks: _with_held(_build_blocks(batches, n)),
            "block int, least_count long, held long, bits binary",
        )
        with text_batches(training.sparkSession):
            built = stored(blocks)
        # never seen: chance would have to heap half as many n-grams again into one block
        if built.filter("least_count > 1").isEmpty():
            return built.select("block", "held", "bits"), n_blocks
        n_blocks *= 2


def _with_held(batches: Iterator) -> Iterator:
    """Adds how many bits each block holds."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        held = [int(np.bitwise_count(np.frombuffer(bits.as_buffer(), np.uint8)).sum()) for bits in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(held, pa.int64()), batch.column(2)],
            ["block", "least_count", "held", "bits"],
        )


def _foldings(built: DataFrame, n_blocks: int, least_bits: int, filter_bytes: int) -> int:
    """How often the filter can be halved: no block over one half, and `least_bits` if they can be broadcast."""
    times = 0
    while n_blocks >> times > 1:
        bits = (n_blocks >> times) * BLOCK_BITS
        if bits // 2 < least_bits and bits <= filter_bytes * 8:
            break
        folded = F.shiftright("block", times + 1).alias("block")
        held = built.groupBy(folded).agg(F.sum("held").alias("held"))
        if not held.filter(F.col("held") * 2 > BLOCK_BITS).isEmpty():
            break
        times += 1
    return times


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    held_fold: int = 1,
    strength: float = STRENGTH,
    head: int = HEAD,
    filter_bytes: int = FILTER_BYTES,
    bits_per_token: int = BITS_PER_TOKEN,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(id) modulo `folds` is `held_fold` are not learned from.
    """
    import numpy as np

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")
    corpus = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.crc32(id_text) % folds == held_fold).alias("held_out"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    training = corpus.filter("NOT held_out").select("text")
    words = training.mapInArrow(_count_tokens, "token binary, n long")
    with text_batches(spark):
        vocabulary = stored(words.groupBy("token").agg(F.sum("n").alias("n")))
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_tokens, n_words = int(sums[0]), int(sums[1])
    total = n_tokens + 0.5 * (n_words + 1)

    learned, filter_parts = max(1, n_tokens), None
    # a filter that cannot be folded to that size is built where its answers are wanted
    if learned * bits_per_token <= filter_bytes * 8:
        built, n_blocks = _built(training, vocabulary, learned, bits_per_token)
        folds_of = _foldings(built, n_blocks, learned * bits_per_token, filter_bytes)
        if (n_blocks >> folds_of) * BLOCK_BITS <= filter_bytes * 8:
            bits = np.zeros((n_blocks >> folds_of, BLOCK_BITS // 8), np.uint8)
            for row in built.toLocalIterator():
                bits[row.block >> folds_of] |= np.frombuffer(row.bits, np.uint8)
            filter_parts = spark.sparkContext.broadcast((bits.reshape(-1), n_blocks >> folds_of))
            del bits
    frequent = {w: math.log10((n + 0.5) / total) for w, n in _frequent(vocabulary, head).items()}
    head_words = spark.sparkContext.broadcast(frequent)

    schema = T.StructType(
        [
            T.StructField("doc_id", kind),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField(
                "rare",
                T.ArrayType(
                    T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.IntegerType())])
                ),
            ),
        ]
    )
    if filter_parts:
        found = corpus.mapInArrow(
            lambda batches: _score(batches, filter_parts, head_words, total, strength), schema
        )
    else:
        with text_batches(spark):
            batched = stored(corpus.mapInArrow(_batched, "batch long, documents binary"))
        n_blocks = _blocks_for(learned, bits_per_token)
        requests = batched.mapInArrow(
            lambda batches: _requests(batches, n_blocks), "shelf int, batch long, keys binary, counts binary"
        )
        replies = requests.groupBy("shelf").applyInArrow(
            lambda asked: _answers(asked, n_blocks), "batch long, shelf int, levels binary"
        )
        found = (
            batched.groupBy("batch")
            .cogroup(replies.groupBy("batch"))
            .applyInArrow(
                lambda batches, levels: _score_answered(batches, levels, head_words, total, strength), schema
            )
        )
    with text_batches(spark):
        scored = stored(found.withColumn("row", F.monotonically_increasing_id()))
    # nothing below reads them; each executor holds a copy, and each of its workers another
    for shared in filter(None, (filter_parts, head_words)):
        shared.unpersist()
    rare = scored.select("row", F.inline("rare")).withColumnRenamed("n", "times")
    joined = rare.join(vocabulary, "token", "left")
    seen = F.coalesce("n", F.lit(0))
    rest = (
        joined.groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10((seen + F.lit(0.5)) / F.lit(total))).alias("rare_score"),
            F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    return scored.drop("rare").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        "score",
    )
