"""Hard negatives from an inverted multi-index over integer vectors.

Two codebooks, one for each half of the components, cut the space into cells.  For an
anchor, a codeword's bound is its inner product with the codeword plus the anchor's norm
times the greatest distance of any row from that codeword; the sum of two bounds limits
the score of every row of their cell.  Cells are visited by falling sum (multi-sequence
order) until no cell left can change the answer: the least of an anchor's certified scores
lies above all sums to come.  Windows that hold too few rows are certified by their lower
end.  So results are exact, whatever the codebooks; these are fitted on a sample of at most
`SAMPLE` vectors (by hash of the id), while every row is indexed and every radius covers
all rows.

Positives are searched first, negatives then with the positives' scores as windows.  Cells
are visited in three rounds, up to 1/16, 1/4 and all of the rows, as one join of probes
with shards of rows each: neighbouring cells share a shard, a cell of more than `BLOCK` rows
is dealt over several and anchors over batches of `BATCH`, so no task holds a whole cell or
all anchors.  A probe is an anchor with a bit for each cell of a shard, not a row a cell, and
a task keeps the best k rows of a window only, so memory does not grow with the cells.

Defined results: rows whose id, label, vector or any component is null, or with a component
that is not finite, take no part.  Rows that share an id count once, as the least by label,
then vector.  Vectors of unequal length are filled up with zeros.  Equal scores go by
smaller id.  Inner products must fit into 64 bits.  Empty tables, and tables without
anchors, give empty results; columns of any other name do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curricle.llm.frames import stored

SAMPLE = 8_192
BLOCK = 8_192
BATCH = 16_384
CELL_ROWS = 256
MOST_CODEWORDS = 256
SHARES = (1 / 16, 1 / 4, 1.0)
SHARDS = 24  # at least, of tables that fill them
SHARD_ROWS = (2_048, 65_536)
SHARD_CELLS = 256  # a multiple of 8
VALUES = 1 << 20  # components held by the anchors of a batch; four times that by the rows of a shard
VISITS_AT_ONCE = 1 << 15
SCORES_AT_ONCE = 1 << 18
FOUND_AT_ONCE = 1 << 18
LEAST, MOST = np.iinfo(np.int64).min + 1, np.iinfo(np.int64).max


@dataclass(frozen=True)
class Index:
    """Codebooks, radii and cell sizes; at most MOST_CODEWORDS squared cells."""

    rows: DataFrame  # vec_id, label, v, cell, block, shard, place
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray  # rows by cell
    blocks: np.ndarray  # by cell
    shards: np.ndarray  # of the first block by cell; the others follow
    places: np.ndarray  # in the shard, by cell
    dim: int
    most: int  # the largest component
    norm: float

    @property
    def stored_as(self) -> str:
        """The smallest type that holds every component."""
        return "smallint" if self.most < 1 << 15 else "int" if self.most < 1 << 31 else "bigint"

    @property
    def scored_as(self) -> type:
        """The fastest type whose inner products are exact."""
        sums = self.dim * self.most * self.most
        return np.float32 if sums < 1 << 24 else np.float64 if sums < 1 << 53 else np.int64


def integer_vectors(vectors: DataFrame, scale: float, label: Column | str = "label") -> DataFrame:
    """vec_id, label and floor(scale * x) of every usable row, each id once."""
    x = F.col("embedding")
    usable = F.forall(
        x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y.cast("double")) < float("inf"))
    )
    label = F.col(label) if isinstance(label, str) else label
    v = F.transform(x, lambda y: F.floor(y.cast("double") * F.lit(float(scale))))
    rows = vectors.select("vec_id", label.alias("label"), v.alias("v"), usable.alias("usable"))
    rows = rows.filter("usable AND vec_id IS NOT NULL AND label IS NOT NULL")
    least = F.min(F.struct("label", "v")).alias("r")
    return rows.groupBy("vec_id").agg(least).select("vec_id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.list_value_length(column)).astype(np.int64)
    flat = np.asarray(column.flatten())
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _codebook(x: np.ndarray, size: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's centres, from rows far apart in a fixed order."""
    rng = np.random.default_rng(7)
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:size]].astype(np.float64)
    for _ in range(rounds):
        nearest = _nearest(x, centres)[0]
        for k in range(len(centres)):
            own = x[nearest == k]
            if len(own):
                centres[k] = own.mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and the distance from it."""
    x = x.astype(np.float64)
    away = (centres**2).sum(axis=1) - 2 * x @ centres.T
    nearest = away.argmin(axis=1)
    return nearest, np.sqrt(((x - centres[nearest]) ** 2).sum(axis=1))


def _shards(sizes: np.ndarray, blocks: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each cell's first block, and the cell's place among those that share it.

    Neighbouring cells share a shard of up to `rows` rows; blocks of a dealt cell have their own.
    """
    shards, places = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
    last, held, cells = -1, rows, 0
    for cell in np.flatnonzero(sizes):
        if blocks[cell] > 1 or held + sizes[cell] > rows or cells == SHARD_CELLS:
            last, held, cells = last + 1, 0, 0
        shards[cell], places[cell] = last, cells
        held, cells = held + int(sizes[cell]), cells + 1
        if blocks[cell] > 1:
            last, held = last + int(blocks[cell]) - 1, rows
    return shards, places


def build_index(rows: DataFrame) -> Index | None:
    """Index of stored rows (vec_id, label, v); None if there are none."""
    spark = rows.sparkSession
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    norm = F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n, dim, most, norm = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), largest, norm).first()
    if not n:
        return None
    dim, most = dim or 0, most or 0
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    sample = _matrix(picked.column("v"), dim)
    codewords = max(4, min(MOST_CODEWORDS, int(math.sqrt(n / CELL_ROWS))))
    half = dim // 2
    books = (_codebook(sample[:, :half], codewords), _codebook(sample[:, half:], codewords))
    width = len(books[1])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            (c1, r1), (c2, r2) = _nearest(x[:, :half], books[0]), _nearest(x[:, half:], books[1])
            cell = pa.array((c1 * width + c2).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, cell, pa.array(r1), pa.array(r2)],
                names=["vec_id", "label", "v", "cell", "r1", "r2"],
            )

    kind = dict(rows.dtypes)["label"]
    schema = f"vec_id long, label {kind}, v array<long>, cell int, r1 double, r2 double"
    placed = stored(rows.select("vec_id", "label", "v").mapInArrow(assign, schema))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1"), F.max("r2"))
    sizes = np.zeros(len(books[0]) * width, np.int64)
    radii = (np.zeros(len(books[0])), np.zeros(width))
    for cell, size, r1, r2 in cells.collect():  # one row a cell, a bounded number
        i, j = divmod(cell, width)
        sizes[cell] = size
        radii[0][i] = max(radii[0][i], r1)
        radii[1][j] = max(radii[1][j], r2)
    most_rows = min(SHARD_ROWS[1], max(1, 4 * VALUES // max(1, dim)))
    blocks = -(-sizes // min(BLOCK, most_rows))
    shards, places = _shards(sizes, blocks, min(most_rows, max(SHARD_ROWS[0], n // SHARDS)))
    split = spark.createDataFrame(
        [tuple(int(y[c]) for y in (range(len(sizes)), blocks, shards, places)) for c in np.flatnonzero(sizes)],
        "cell int, blocks int, first int, place int",
    )
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    dealt = placed.join(F.broadcast(split), "cell").select(
        "vec_id", "label", "v", "cell", block.alias("block"),
        (F.col("first") + block).alias("shard"), "place",
    )
    return Index(dealt, books, radii, sizes, blocks, shards, places, dim, most, math.sqrt(norm or 0.0))


def _visits(first: np.ndarray, second: np.ndarray, least: float) -> np.ndarray:
    """Pairs of positions, as i * len(second) + j, by falling sum of two lists of bounds, down to `least`."""
    sums = np.add.outer(first, second).ravel()
    pairs = np.flatnonzero(sums >= least)
    return pairs[np.argsort(-sums[pairs], kind="stable")]


def _next_cells(
    index: Index,
    begin: float,
    end: float,
    carried: tuple[str, ...] = ("batch", "anchor_id", "label", "v", "tops"),
):
    """A task function: cells to visit for anchors, from one share of the rows to the next.

    An anchor's cells stay in one Arrow batch, others join them up to VISITS_AT_ONCE rows.
    """
    books, radii, sizes, dim, top = index.books, index.radii, index.sizes, index.dim, index.norm
    half, total = dim // 2, int(sizes.sum())
    blocks = index.blocks

    def cells_of(v: np.ndarray, floor: float, ceiling: float) -> np.ndarray:
        # one anchor at a time: sums rounded otherwise in another round could leave a cell out
        scores = [b @ a for a, b in ((v[:half], books[0]), (v[half:], books[1]))]
        spans = [np.sqrt((a**2).sum()) * r for a, r in ((v[:half], radii[0]), (v[half:], radii[1]))]
        slack = 1e-9 * top * np.sqrt((v**2).sum()) + 1e-6
        cells = _visits(scores[0] + spans[0], scores[1] + spans[1], floor - slack)
        seen = np.cumsum(sizes[cells]) - sizes[cells]
        cells = cells[(seen >= begin * total) & (seen < end * total) & (sizes[cells] > 0)]
        lows = np.add.outer(scores[0] - spans[0], scores[1] - spans[1]).ravel()
        return cells[lows[cells] - slack <= ceiling]

    def dealt(batch: pa.RecordBatch, rows: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(found)
        parts = blocks[cells]
        at = pa.array(np.repeat(np.repeat(rows, [len(c) for c in found]), parts), pa.int64())
        block = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(cells, parts).astype(np.int32)),
                pa.array(block.astype(np.int32)),
                *(batch.column(k).take(at) for k in carried),
            ],
            names=["cell", "block", *carried],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            floors = batch.column("floor").to_pylist()
            ceilings = batch.column("ceiling").to_pylist()
            rows, found, n = [], [], 0
            for a in range(len(x)):
                cells = cells_of(x[a].astype(np.float64), floors[a], ceilings[a])
                own = int(blocks[cells].sum())
                if n and n + own > VISITS_AT_ONCE:
                    yield dealt(batch, rows, found)
                    rows, found, n = [], [], 0
                if own:
                    rows.append(a)
                    found.append(cells)
                    n += own
            if n:
                yield dealt(batch, rows, found)

    return work


def _probes(index: Index, begin: float, end: float):
    """A task function: anchors, once for each shard where they visit cells, with a bit a cell."""
    shards, places = index.shards, index.places
    next_cells = _next_cells(index, begin, end, ("at",))
    carried = ("batch", "anchor_id", "label", "v", "tops", "leasts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = batch.append_column("at", pa.array(np.arange(len(batch))))
            for visits in next_cells(iter([numbered])):
                cell, block, at = (np.asarray(visits.column(c)) for c in ("cell", "block", "at"))
                shard = shards[cell] + block
                order = np.lexsort((shard, at))
                cell, shard, at = cell[order], shard[order], at[order]
                first = np.ones(len(at), bool)
                first[1:] = (at[1:] != at[:-1]) | (shard[1:] != shard[:-1])
                bits = np.zeros((int(first.sum()), SHARD_CELLS), bool)
                bits[np.cumsum(first) - 1, places[cell]] = True
                cells = [b.tobytes() for b in np.packbits(bits, axis=1)]
                rows = pa.array(at[first])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard[first].astype(np.int32)),
                        pa.array(cells, pa.binary()),
                        *(batch.column(k).take(rows) for k in carried),
                    ],
                    names=["shard", "cells", *carried],
                )

    return work


class _Windows:
    """Windows of anchors, by their places, and the best k rows found for each so far."""

    def __init__(self, probes: pa.Table, k: int, percent: tuple[int, int] | None) -> None:
        self.k = k
        lists = probes["tops"].combine_chunks()
        self.counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.tops = np.asarray(lists.flatten())
        leasts = probes["leasts"].combine_chunks().flatten()
        self.low, self.high = np.full(len(self.tops), LEAST), np.full(len(self.tops), MOST)
        if percent is not None:  # of tops not below zero; the products may exceed 64 bits
            hundreds, rest = np.divmod(self.tops, 100)
            self.low = percent[0] * hundreds - -percent[0] * rest // 100
            self.high = percent[1] * hundreds + percent[1] * rest // 100
        self.low = np.maximum(self.low, np.asarray(leasts.fill_null(LEAST)))
        self.last = np.full(len(self.low), MOST)  # the id of the k-th row found, if its score is the low one
        self.best = [np.zeros(0, np.int64)] * 3  # window, vec_id, score
        self.more: list[list[np.ndarray]] = []
        self.n = 0

    def least(self) -> np.ndarray:
        """The least score of each anchor that can still enter one of its windows."""
        return np.minimum.reduceat(self.low, self.starts)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> bool:
        """Takes scored rows of anchors; true if the bounds may have changed."""
        step, settled = max(1, FOUND_AT_ONCE // int(self.counts.max())), False
        for begin in range(0, len(at), step):
            own = at[begin : begin + step]
            counts = self.counts[own]
            window = np.arange(counts.sum()) + np.repeat(self.starts[own] - np.cumsum(counts) + counts, counts)
            row = begin + np.repeat(np.arange(len(own)), counts)
            score, low = scores[row], self.low[window]
            inside = (score > low) | (score == low) & (ids[row] <= self.last[window])
            inside &= score <= self.high[window]
            window, row = window[inside], row[inside]
            self.more.append([window, ids[row], scores[row]])
            self.n += len(row)
            if self.n >= FOUND_AT_ONCE:
                self.settle()
                settled = True
        return settled

    def settle(self) -> None:
        window, ids, scores = (np.concatenate(c) for c in zip(self.best, *self.more, strict=True))
        order = np.lexsort((ids, -scores, window))
        window = window[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        kept = order[place < self.k]
        last = place == self.k - 1
        self.low[window[last]], self.last[window[last]] = scores[order[last]], ids[order[last]]
        self.best, self.more, self.n = [window[place < self.k], ids[kept], scores[kept]], [], 0


def _score_blocks(index: Index, k: int, percent: tuple[int, int] | None):
    """A task function: the best rows of one shard for the anchors of one batch that visit it.

    Without `percent` rows of the anchor's label, else rows of other labels in the windows.
    """
    dim, kind = index.dim, index.scored_as
    names = ["anchor_id", "top", "vec_id", "score"]

    def work(probes: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(probes) or not len(rows):
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names=names)
        rows = rows.sort_by("place")
        ids, anchors = np.asarray(rows["vec_id"]), np.asarray(probes["anchor_id"])
        labels = pa.chunked_array([*rows["label"].chunks, *probes["label"].chunks])
        codes = np.asarray(labels.combine_chunks().dictionary_encode().indices)
        own_codes, codes = codes[len(ids) :], codes[: len(ids)]
        x, a = (_matrix(t["v"], dim).astype(kind) for t in (rows, probes))
        bits = np.frombuffer(b"".join(probes["cells"].to_pylist()), np.uint8)
        visits = np.unpackbits(bits.reshape(len(anchors), -1), axis=1).view(bool)
        ends = np.searchsorted(np.asarray(rows["place"]), np.arange(SHARD_CELLS + 1))
        windows = _Windows(probes, k, percent)
        least = windows.least().astype(kind)
        most = np.maximum.reduceat(windows.high, windows.starts).astype(kind)
        for place in np.flatnonzero(visits.any(axis=0) & (ends[1:] > ends[:-1])):
            cell = slice(ends[place], ends[place + 1])
            visiting = np.flatnonzero(visits[:, place])
            step = max(1, SCORES_AT_ONCE // (cell.stop - cell.start))
            for begin in range(0, len(visiting), step):
                own = visiting[begin : begin + step]
                scores = a[own] @ x[cell].T
                good = scores >= least[own, None]
                same = own_codes[own, None] == codes[cell]
                if percent is None:
                    good &= same & (anchors[own, None] != ids[cell])
                else:
                    good &= ~same & (scores <= most[own, None])
                at, row = np.nonzero(good)
                if windows.add(own[at], ids[cell][row], scores[at, row].astype(np.int64)):
                    least = windows.least().astype(kind)
        windows.settle()
        window, found, scores = windows.best
        at = np.repeat(np.arange(len(anchors)), windows.counts)[window]
        columns = [pa.array(c, pa.int64()) for c in (anchors[at], windows.tops[window], found, scores)]
        return pa.Table.from_arrays(columns, names=names)

    return work


def _search(
    index: Index, anchors: DataFrame, k: int, percent: tuple[int, int] | None
) -> DataFrame:
    """The best k rows (anchor_id, top, vec_id, score) of each anchor and window.

    `anchors`: anchor_id, label, v, batch, tops (scores whose windows are searched).
    """
    spark = anchors.sparkSession
    kind, number = dict(anchors.dtypes)["label"], index.stored_as
    probe = (
        f"shard int, cells binary, batch int, anchor_id long, label {kind}, v array<{number}>, "
        "tops array<long>, leasts array<long>"
    )
    result = "anchor_id long, top long, vec_id long, score long"
    key = ["shard", "batch"]
    short = F.col("v").cast(f"array<{number}>").alias("v")
    window = Window.partitionBy("anchor_id", "top").orderBy(F.desc("score"), "vec_id")
    if percent is None:
        low, ceiling = F.lit(float("-inf")), F.lit(float("inf"))
    else:
        low = F.col("top").cast("double") * percent[0] / 100
        ceiling = F.array_max("tops").cast("double") * percent[1] / 100
    best = spark.createDataFrame([], result)
    begin = 0.0
    for end in SHARES:
        # A window is settled down to its k-th score, or to its lower end.
        full = best.groupBy("anchor_id", "top").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        full = full.filter(F.col("n") >= k).drop("n")
        wanted = anchors.select("anchor_id", F.explode("tops").alias("top"))
        floors = (
            wanted.join(full, ["anchor_id", "top"], "left")
            .groupBy("anchor_id")
            .agg(
                F.min(F.greatest(F.col("least").cast("double"), low)).alias("floor"),
                F.collect_list(F.struct("top", "least")).alias("windows"),
            )
        )
        state = anchors.join(floors, "anchor_id").select(
            "anchor_id", "label", short, "batch", F.col("windows.top").alias("tops"),
            F.col("windows.least").alias("leasts"), "floor", ceiling.alias("ceiling"),
        )
        probes = stored(state.mapInArrow(_probes(index, begin, end), probe))
        visited = probes.select("shard", F.col("batch").alias("of")).distinct()
        rows = index.rows.join(F.broadcast(visited), "shard").select(
            "shard", F.col("of").alias("batch"), "vec_id", "label", short, "place"
        )
        found = (
            probes.groupBy(key)
            .cogroup(rows.groupBy(key))
            .applyInArrow(_score_blocks(index, k, percent), result)
        )
        ranked = best.unionAll(found).withColumn("at", F.row_number().over(window))
        best = stored(ranked.filter(F.col("at") <= k).drop("at"))
        begin = end
    return best


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
) -> DataFrame:
    """For each anchor and positive, the first different-label rows within the window.

    `rows`: vec_id, label, v of integers, as `integer_vectors` gives them.  A negative's
    score lies between the two percentages of the positive's score.
    """
    spark = rows.sparkSession
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stored(rows.select(F.col("vec_id").cast("long"), "label", "v"))
    chosen = rows.filter(is_anchor)
    index, n_anchors = build_index(rows), chosen.count()
    if index is None or not n_anchors:
        return spark.createDataFrame([], result)
    most = min(BATCH, max(1, VALUES // max(1, index.dim)))
    batch = F.pmod(F.xxhash64("vec_id"), F.lit(-(-n_anchors // most))).cast("int")
    anchors = stored(
        chosen.select(
            F.col("vec_id").alias("anchor_id"), "label", "v", batch.alias("batch"),
            F.array(F.lit(0).cast("long")).alias("tops"),
        )
    )
    found = _search(index, anchors, positives, None)
    pairs = found.select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("top")
    )
    open_windows = pairs.filter("top >= 0").groupBy("anchor_id")  # below zero they are empty
    tops = open_windows.agg(F.collect_set("top").alias("tops"))
    with_windows = stored(anchors.drop("tops").join(tops, "anchor_id"))
    if with_windows.isEmpty():
        return spark.createDataFrame([], result)
    near = _search(index, with_windows, negatives, percent)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    return pairs.join(near, ["anchor_id", "top"]).select(
        "anchor_id",
        "positive_id",
        F.row_number().over(order).alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("top").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
