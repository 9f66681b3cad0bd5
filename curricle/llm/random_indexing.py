"""Quality scores of documents from random-indexing word vectors.

Words are runs of letters, of digits or of other signs.  Each falls by hash into one of
`SLOTS` slots, a fixed number, so tables of word vectors have a bounded size whatever the
corpus; words that share a slot share a vector.  A slot has a sparse index vector of +1 and
-1; its word vector is the sum of the index vectors of the `REACH` words on either side,
over every word of every document, set to length one after the mean vector is taken off.
A task adds up what it reads and emits one row a slot; Spark adds those.

A document's features are the mean of its words' vectors and of their index vectors, the
length of both, and the logarithm of its number of words.  A two-layer network in numpy is
fitted to the features of at most `SAMPLE` labelled documents (those with the least hashes
of their ids): four fifths of them fit the weights, one fifth the temperature by which
logits are divided, so that scores are calibrated probabilities.  Then every document is
scored with the broadcast vectors and weights.  Texts are cut into words once; their slots
lie in the shared folder, two bytes a word.

Defined results: null and blank texts have no words and zero features, and are scored like
any other.  Labels are read where id and label are not null; an id that has several labels
or several documents counts with each of them.  Without labelled documents every score is
one half, with a single label it is the share (n1 + 1) / (n + 2).  Rows are scored one by
one, equal texts alike; a null id belongs to neither side and is scored.  Columns of any
other name do not matter.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curricle.llm.frames import stored

SLOTS = 1 << 14
DIM = 32
NON_ZERO = 4
REACH = 2
SAMPLE = 20_000
HIDDEN = 32
EPOCHS = 40
PIECE = 1 << 16
KEPT_WORDS = 1 << 19
FEATURES = 2 * DIM + 3
WORDS = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


class _Slots(dict):
    """Slots of the words of a stretch without blanks; keeps those seen before, up to a bound."""

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        words = (stretch,) if stretch.isalpha() else WORDS.findall(stretch)
        found = tuple([xxhash.xxh64_intdigest(word, 11) % SLOTS for word in words])
        if len(stretch) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[stretch] = found
        return found


def index_vectors() -> np.ndarray:
    """One sparse vector a slot, and a zero vector for the space between documents."""
    rng = np.random.default_rng(5)
    vectors = np.zeros((SLOTS + 1, DIM), np.int8)
    places = rng.random((SLOTS, DIM)).argsort(axis=1)[:, :NON_ZERO]
    signs = rng.choice(np.array([-1, 1], np.int8), (SLOTS, NON_ZERO))
    np.put_along_axis(vectors[:SLOTS], places, signs, axis=1)
    return vectors


def slot_table(texts: DataFrame) -> DataFrame:
    """key and slots of every text (key, text), two bytes a word, in the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            rows = [
                np.fromiter(chain.from_iterable(map(slots.__getitem__, (text or "").split())), np.uint16)
                for text in batch.column(1).to_pylist()
            ]
            packed = pa.array([row.tobytes() for row in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["key", "slots"])

    kind = texts.schema["key"].dataType.simpleString()
    return stored(texts.select("key", "text").mapInArrow(work, f"key {kind}, slots binary"))


def _pieces(packed: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of texts laid end to end, with `REACH` gaps after each, and their sizes."""
    sizes = np.asarray(pc.binary_length(packed)).astype(np.int64) // 2
    volume = np.cumsum(sizes + REACH)
    begin = 0
    while begin < len(sizes):
        before = int(volume[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(volume, before + PIECE, side="right")))
        row = np.full(int(volume[end - 1]) - before, SLOTS, np.uint16)
        word = np.ones(len(row), bool)
        stops = volume[begin:end] - before
        for k in range(1, REACH + 1):
            word[stops - k] = False
        joined = b"".join(packed[begin:end].to_pylist())
        row[word] = np.frombuffer(joined, np.uint16)
        yield row, sizes[begin:end]
        begin = end


def add_contexts(row: np.ndarray, index: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds the index vectors around each word to its slot's sum.

    Four sums travel in one 64-bit number: made positive, they stay within 16 bits for
    stretches of up to 4,096 words.
    """
    near = np.full((len(row), DIM), 2 * REACH, np.int8)
    vectors = index[row]
    for k in range(1, REACH + 1):
        near[k:] += vectors[:-k]
        near[:-k] += vectors[k:]
    packed = near.astype(np.uint16).view(np.uint64)
    order = np.argsort(row, kind="stable")
    by_slot = row[order]
    new = np.concatenate(([True], by_slot[1:] != by_slot[:-1]))
    new[::4096] = True
    starts = np.flatnonzero(new)
    slots, sizes = by_slot[starts], np.diff(np.concatenate((starts, [len(row)])))
    total = np.add.reduceat(packed[order], starts, axis=0).view(np.uint16).astype(np.int64)
    total -= 2 * REACH * sizes[:, None]
    real = slots < SLOTS
    differs = np.concatenate(([True], slots[1:] != slots[:-1], [True]))
    single = real & differs[:-1] & differs[1:]
    sums[slots[single]] += total[single]
    counts[slots[single]] += sizes[single]
    rest = real & ~single
    np.add.at(sums, slots[rest], total[rest])
    np.add.at(counts, slots[rest], sizes[rest])


def context_sums(slots: DataFrame) -> DataFrame:
    """slot, n (its words in the corpus) and the sums v0, v1, ... over all texts (slots)."""
    names = [f"v{i}" for i in range(DIM)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        sums, counts = np.zeros((SLOTS, DIM), np.int64), np.zeros(SLOTS, np.int64)
        for batch in batches:
            for row, _ in _pieces(batch.column(0)):
                add_contexts(row, index, sums, counts)
        seen = np.flatnonzero(counts)
        columns = [seen, counts[seen], *sums[seen].T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "n", *names])

    schema = T.StructType([T.StructField(k, T.LongType()) for k in ("slot", "n", *names)])
    parts = slots.select("slots").mapInArrow(work, schema)
    return parts.groupBy("slot").agg(*(F.sum(k).alias(k) for k in ("n", *names)))


def word_vectors(slots: DataFrame) -> np.ndarray:
    """Unit context vectors of all slots; a zero vector for slots without words."""
    table = context_sums(slots).toArrow()  # at most SLOTS rows
    vectors = np.zeros((SLOTS + 1, DIM), np.float32)
    if len(table):
        at = np.asarray(table["slot"])
        sums = np.stack([np.asarray(table[f"v{i}"]) for i in range(DIM)], axis=1).astype(np.float64)
        n = np.asarray(table["n"]).astype(np.float64)[:, None]
        mean = sums / n
        mean -= (sums.sum(axis=0) / n.sum())[None, :]
        vectors[at] = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
    return vectors


def _features(row: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes + REACH).tolist()
    begins = [0, *ends[:-1]]
    means = np.stack([table[row[a:b]].sum(axis=0) for a, b in zip(begins, ends, strict=True)])
    means = means / np.maximum(sizes, 1)[:, None]
    lengths = [np.linalg.norm(means[:, i : i + DIM], axis=1) for i in (0, DIM)]
    return np.column_stack([means, *lengths, np.log1p(sizes)])


def pooled(packed: pa.Array, table: np.ndarray) -> np.ndarray:
    """A row of features for each text, given its slots."""
    parts = [_features(row, sizes, table) for row, sizes in _pieces(packed)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


@dataclass
class Network:
    """Two layers over standardised features; logits are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0
    constant: float | None = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, order: np.ndarray) -> Network:
    """A network by Adam on four fifths of the rows, its temperature on the others.

    `order` is a number by which rows are dealt and sorted, so that a fit does not depend
    on the order of rows.
    """
    by = np.lexsort((*x.T[:3], y, order))
    x, y = x[by], y[by].astype(np.float64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(1), np.ones(1), [], constant=float(share))
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2:
        held[:] = False
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    z, t = (x[~held] - mean) / scale, y[~held]
    rng = np.random.default_rng(3)
    weights = [
        rng.normal(size=(x.shape[1], HIDDEN)) / math.sqrt(x.shape[1]),
        np.zeros(HIDDEN),
        rng.normal(size=HIDDEN) / math.sqrt(HIDDEN),
        np.array(math.log((t.sum() + 1) / (len(t) - t.sum() + 1))),
    ]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = 0.003 * (1 - epoch / EPOCHS)
        deal = rng.permutation(len(t))
        for begin in range(0, len(t), 128):
            own = deal[begin : begin + 128]
            w1, b1, w2, b2 = weights
            hidden = np.tanh(z[own] @ w1 + b1)
            error = (1 / (1 + np.exp(-(hidden @ w2 + b2))) - t[own]) / len(own)
            back = np.outer(error, w2) * (1 - hidden**2)
            slopes = [z[own].T @ back, back.sum(axis=0), hidden.T @ error, error.sum()]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                even = first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
                weights[i] = weights[i] - rate * (even + 0.01 * weights[i])
    model = Network(mean, scale, weights)
    if held.any():
        logits = model.logits(x[held])
        model.temperature = min(np.geomspace(0.2, 10, 80), key=lambda c: _loss(logits / c, y[held]))
    return model


def _by_slots(emit: Callable[[np.ndarray], np.ndarray], shared) -> Callable:
    """A task function: (key, slots) to (key, emit(features))."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.float32).reshape(-1, 2 * DIM)
        for batch in batches:
            found = emit(pooled(batch.column(1), table))
            if found.ndim == 2:
                flat = pa.array(found.reshape(-1), pa.float64())
                ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                out = pa.ListArray.from_arrays(ends, flat)
            else:
                out = pa.array(found, pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=["key", "value"])

    return work


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
) -> DataFrame:
    """Id and score (0 to 1, the probability of label 1) of every document.

    `labels`: id and label (0 or 1); `learn` says from which of their rows to learn.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    slots = slot_table(texts)
    table = np.concatenate([word_vectors(slots), index_vectors().astype(np.float32)], axis=1)
    shared = spark.sparkContext.broadcast(table.astype(np.float32).tobytes())  # 4 MB, fixed
    usable = labels.filter(learn).filter(F.col(id_col).isNotNull() & F.col(label).isNotNull())
    picked = (
        usable.select(F.col(id_col).alias("key"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key", "label")
        .limit(sample)
    )
    kind = docs.schema[id_col].dataType.simpleString()
    own = slots.join(F.broadcast(picked.select("key").distinct()), "key", "left_semi")
    features = own.mapInArrow(_by_slots(lambda x: x, shared), f"key {kind}, value array<double>")
    known = features.join(F.broadcast(picked), "key").select(
        "value", "label", F.xxhash64("key").alias("order")
    )
    got = known.orderBy("order", "label").limit(sample).toArrow()
    x = np.asarray(got["value"].combine_chunks().flatten()).reshape(-1, FEATURES)
    model = fit(x, np.asarray(got["label"]), np.asarray(got["order"]))
    scored = slots.mapInArrow(_by_slots(model.scores, shared), f"key {kind}, value double")
    return scored.select(F.col("key").alias(id_col), F.col("value").alias("score"))
