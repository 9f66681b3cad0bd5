"""Stretches of words that repeat with a period, and texts with them collapsed.

A run is a stretch of consecutive words with smallest period q (words q apart are equal),
at least `least` words and four periods long, that no neighbouring word extends.  Runs are
found through string synchronising sets.  At scale t (a power of two) a position is chosen
if, among the hashes of the t-word windows that start at it and the next t positions, the
least one stands first or last.  Whether a position is chosen depends on its next 2t words
only, so equal contexts are chosen alike; every t positions hold a chosen one unless all
windows around have a period of t/4 or less.  Such windows lie inside runs that smaller
scales have found, and are left out; periods 1 to 3 are found by comparing neighbours.

A run with period q, t <= q < 2t, holds a chosen position in its first t words, and the
next position with an equal context is exactly q words on.  So the distance of neighbours
with equal contexts proposes every period; proposals are extended and measured by comparing
the words themselves, so hashes alone decide nothing that is returned.

Defined results: a null list of words is an empty one, null words count as empty words,
empty lists have no runs and an empty collapsed text.  Rows are independent: equal ids or
rows give equal results, columns of any other name do not matter, an empty table gives an
empty result.  Time grows as n log n with the words of a text; memory with the longest
text, as texts are read in pieces of about `PIECE` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 1 << 18
LEAST = 6
TIMES = 4
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _doubled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of windows of 2*size words from those of size words."""
    return _mixed(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + hashes[size:])


def _window_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of each `size` consecutive values; size is a power of two."""
    step = 1
    while step < size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return values


def _equal_ahead(x: np.ndarray, i: int, j: int) -> int:
    """How many words from i and from j > i on are equal."""
    start, step = i, 32
    while True:
        a, b = x[i : i + step], x[j : j + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            return i + int(differ[0]) - start
        if len(b) < step:
            return i + len(b) - start
        i, j, step = i + step, j + step, step * 2


def _equal_behind(x: np.ndarray, i: int, j: int) -> int:
    """How many words before i and before j > i are equal."""
    start, step = i, 32
    while i:
        size = min(step, i)
        differ = np.flatnonzero(x[i - size : i] != x[j - size : j])
        if len(differ):
            return start - (i - size + int(differ[-1]) + 1)
        i, j, step = i - size, j - size, step * 2
    return start


def _smallest(x: np.ndarray, start: int, period: int) -> bool:
    """No proper divisor of the period is a period; others cannot be, by length."""
    word, rest, factor = x[start : start + period], period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            part = period // factor
            if np.array_equal(word[part:], word[:-part]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _small_periods(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for period in (1, 2, 3):
        if len(x) <= period:
            break
        equal = np.concatenate(([False], x[:-period] == x[period:], [False]))
        edges = np.flatnonzero(equal[1:] != equal[:-1])
        starts, ends = edges[::2], edges[1::2]
        long = ends - starts >= (TIMES - 1) * period
        for a, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            if period == 1 or _smallest(x, a, period):
                yield a, e + period, period


def _proposals(hashes: np.ndarray, wide: np.ndarray, skipped: np.ndarray, size: int):
    """Positions and distances of neighbouring chosen positions with equal contexts."""
    order = hashes.copy()
    order[skipped[: len(order)]] = _TOP
    first, last = order[: len(order) - size], order[size:]
    least = np.minimum(_window_least(order, size)[: len(first)], last)
    chosen = np.flatnonzero(((least == first) | (least == last)) & (least != _TOP))
    chosen = chosen[chosen < len(wide)]
    contexts = wide[chosen]
    by_context = np.argsort(contexts, kind="stable")
    contexts, at = contexts[by_context], chosen[by_context]
    gaps = at[1:] - at[:-1]
    near = (contexts[1:] == contexts[:-1]) & (gaps >= size) & (gaps < 2 * size)
    return at[:-1][near], gaps[near]


def word_runs(x: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of four periods in texts laid end to end.

    Each text is followed by a number that occurs nowhere else, counted in its length.
    """
    found = list(_small_periods(x))
    hashes = _mixed(x.astype(np.uint64) + np.uint64(0x51ED270B))
    for size in (1, 2):
        if len(hashes) <= size:
            return found
        hashes = _doubled(hashes, size)
    here = np.arange(len(x))  # positions in x of what is still looked at
    left, size = lengths, 4
    while True:
        stay = left > TIMES * size
        if not stay.all():
            mask = np.repeat(stay, left)
            here, left = here[mask], left[stay]
            hashes = hashes[mask[: len(hashes)]]
        if len(hashes) <= 2 * size:
            return found
        hidden = np.zeros(len(x) + 1, np.int32)
        for a, b, q in found:
            if 4 * q <= size <= b - a:
                hidden[a] += 1
                hidden[b - size + 1] -= 1
        skipped = (np.cumsum(hidden[:-1]) > 0)[here]
        wide = _doubled(hashes, size)
        at, gaps = _proposals(hashes, wide, skipped, size)
        at = here[at]
        done = (0, 0)  # period and end of the last stretch compared
        for k in np.lexsort((at, gaps)).tolist():
            s, q = int(at[k]), int(gaps[k])
            if done[0] == q and s < done[1]:
                continue
            a, e = s - _equal_behind(x, s, s + q), s + _equal_ahead(x, s, s + q)
            done = (q, max(e, s + 1))
            if e - a >= (TIMES - 1) * q and _smallest(x, a, q):
                found.append((a, e + q, q))
        hashes, size = wide, 2 * size


def _piece(ids: pa.Array, words: pa.ListArray, least: int) -> pa.RecordBatch:
    sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0)).astype(np.int64)
    flat = pc.fill_null(words.flatten(), "")
    n, total = len(sizes), int(sizes.sum())
    codes = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    x = np.empty(total + n, np.int64)
    ends = firsts[1:] + np.arange(n)
    inside = np.ones(total + n, bool)
    inside[ends] = False
    x[inside] = codes
    x[ends] = total + np.arange(n)
    runs: list[list[dict]] = [[] for _ in range(n)]
    dropped = np.zeros(total + n + 1, np.int32)
    for a, b, q in sorted(word_runs(x, sizes + 1), key=lambda r: (r[0], r[2])):
        if b - a >= least:
            text = int(np.searchsorted(ends, a))
            offset = a - int(firsts[text]) - text
            runs[text].append({"start": offset, "length": b - a, "period": q})
            dropped[a + q] += 1
            dropped[b] -= 1
    keep = np.cumsum(dropped[:-1])[inside] == 0
    counts = np.concatenate(([0], np.cumsum(keep)))[firsts]
    kept = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), flat.filter(pa.array(keep)))
    joined = pc.binary_join(kept, " ")
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes), pa.array(runs, _RUNS), joined], names=["id", "n", "runs", "collapsed"]
    )


_RUNS = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))


def _pieces(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch.column(0), batch.column(1)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0))
        begin = held = 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > PIECE:
                yield _piece(ids[begin:i], words[begin:i], least)
                begin, held = i, 0
            held += size + 1
        if begin < len(sizes):
            yield _piece(ids[begin:], words[begin:], least)


def find_runs(docs: DataFrame, words: Column, id_col: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Id, n_words, runs (by start, then period) and the text without repeated periods.

    A word goes if any run holds it after that run's first period; the others are joined
    by one space.  `words` is an array of strings over the columns of `docs`.
    """
    kind = docs.schema[id_col].dataType
    run = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])
    schema = T.StructType(
        [
            T.StructField("id", kind),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run)),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def work(batches):
        return _pieces(batches, least)

    found = docs.select(F.col(id_col).alias("id"), words.alias("words")).mapInArrow(work, schema)
    return found.withColumnRenamed("id", id_col)


def repeat_tails(words: Column, key: Column) -> Column:
    """Words of which one text in ten ends in a periodic tail, chosen by a checksum of its key.

    A null key leaves the words alone.
    """
    n, h = F.size(words), F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

    def original(word: Column, i: Column) -> Column:
        return F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(word)

    return F.when((h % 10 == 0) & (n > 0), F.transform(words, original)).otherwise(words)


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest run (ties: least start, then period) and digests of runs and text."""
    longest = F.array_min(
        F.transform("runs", lambda r: F.struct(-r.length, r.start, r.period))
    )
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))
    )
    length, period = -longest["col1"], longest["period"]
    return found.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        longest["start"].alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
