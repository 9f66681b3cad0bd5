"""Greedy packing of ordered pieces, exact and parallel inside one source.

Packing is an order-dependent fold: a piece opens a new group when the open
group is non-empty and would exceed the budget.  Ordinary sources fit into one
block and are folded by a native ``aggregate``.  A source of any length is cut
into blocks of bounded size.  What a block does to the fold depends only on the
size of the group that is open when the block begins, and that size is capped by
the budget, so each block is summarised by one table ``open size → (open size,
start of the open group)``.  Tables compose, which lets the entry state of every
block be found by a two-level scan over summaries; then all blocks fold at once.
"""

from __future__ import annotations

import sys
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curricle.functions.exprs import fresh, let

# the numpy helpers travel with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
BLOCKS_PER_GROUP = 1024


# --- native fold inside one array --------------------------------------------
NO_QUEUE = "cast(array() AS array<int>)"


def starts_rule(
    sizes: str, budget: str | int, overlap: str | int = 0, size: str = "-1", queue: str = NO_QUEUE
) -> str:
    """``struct<starts, size>`` of a fold over ``array<int>`` sizes.

    ``starts`` are the indexes at which a new group begins.  ``size`` describes the
    group that is open at the beginning; size -1 means that none is, so the first
    element begins one.  ``queue`` are the last ``overlap`` sizes before the first
    element, as far as there are any: a group begins with what it carries over.
    """
    full = f"(s.size >= 0 AND s.size + x.n > {budget})"

    def fold(all_sizes: str) -> str:
        before = f"(x.i + size({all_sizes}) - size({sizes}))"
        carried = (
            f"aggregate(slice({all_sizes}, {before} - least({overlap}, {before}) + 1, least({overlap}, {before})), "
            "0, (c_, y_) -> c_ + y_)"
        )
        if overlap == 0:
            carried = "0"
        return (
            f"aggregate(transform({sizes}, (n, i) -> named_struct('i', i, 'n', n)), "
            f"named_struct('starts', cast(array() AS array<int>), 'size', int(coalesce({size}, -1))), "
            f"(s, x) -> named_struct("
            f"'starts', if(s.size < 0 OR {full}, concat(s.starts, array(x.i)), s.starts), "
            f"'size', CASE WHEN {full} THEN {carried} + x.n WHEN s.size < 0 THEN x.n ELSE s.size + x.n END))"
        )

    return fold(sizes) if overlap == 0 else let(f"concat(coalesce({queue}, {NO_QUEUE}), {sizes})", fold)


def parts_rule(items: str, budget: int) -> str:
    """Pack ``array<struct<t, n>>`` texts into space-joined ``struct<t, n>`` parts."""

    def cut(xs: str) -> str:
        starts = starts_rule(f"transform({xs}, q_ -> q_.n)", budget) + ".starts"

        def parts(st: str) -> str:
            j, first = fresh("j"), fresh("first")
            stop = f"coalesce(get({st}, {j} + 1), size({xs}))"
            members = f"slice({xs}, {first} + 1, {stop} - {first})"
            body = let(
                members,
                lambda ms: f"named_struct('t', array_join(transform({ms}, m_ -> m_.t), ' '), "
                f"'n', aggregate({ms}, 0, (a_, m_) -> a_ + m_.n))",
            )
            return f"transform({st}, ({first}, {j}) -> {body})"

        return let(starts, parts)

    return let(items, cut)


# --- block summaries for long sources ----------------------------------------
def _carried(queue: np.ndarray, sizes: np.ndarray, overlap: int) -> np.ndarray:
    """Sum of the last ``overlap`` sizes before each piece, those before the block included."""
    cum = np.concatenate(([0], np.cumsum(np.concatenate((queue, sizes)))))
    at = np.arange(len(queue), len(queue) + len(sizes))
    return cum[at] - cum[np.maximum(0, at - overlap)]


def _last_of_chain(following: np.ndarray) -> np.ndarray:
    """Where each chain ``i -> following[i]`` ends inside the block, by pointer jumping."""
    m = len(following)
    last = np.where(following < m, np.minimum(following, m - 1), np.arange(m))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return last
        last = further


def _summarise(seqs: np.ndarray, sizes: np.ndarray, budget: int, carried: np.ndarray):
    """Table over the open size after the block's first piece."""
    m = len(sizes)
    cum = np.cumsum(sizes)
    opened = np.minimum(budget, carried + sizes)
    following = np.searchsorted(cum, budget - opened + cum, side="right")
    last = _last_of_chain(following)
    exit_size = np.minimum(budget, opened[last] + cum[-1] - cum[last])
    exit_start = seqs[last]
    state = np.arange(budget + 1, dtype=np.int64)
    first = np.searchsorted(cum, budget - state + cum[0], side="right")
    ends_open = first >= m
    at = np.where(ends_open, 0, first)
    table_size = np.where(ends_open, np.minimum(budget, state + cum[-1] - cum[0]), exit_size[at])
    table_start = np.where(ends_open, -1, exit_start[at])
    return table_size, table_start


def _enter(size, start, block):
    """State after the first piece of a block, for one or many entry states."""
    budget = int(block.budget)
    n0 = min(int(block.tok0), budget)
    fresh = size < 0
    full = ~fresh & (size + block.tok0 > budget)
    opened = min(budget, int(block.carried0) + int(block.tok0))
    after = np.where(full, opened, np.where(fresh, n0, size + block.tok0))
    opened_at = np.where(fresh | full, block.seq0, start)
    return after.astype(np.int64), opened_at


def _through(size, start, block):
    after, opened_at = _enter(size, start, block)
    table_size = np.frombuffer(block.table_size, dtype=np.int64)
    table_start = np.frombuffer(block.table_start, dtype=np.int64)
    inner = table_start[after]
    return table_size[after], np.where(inner < 0, opened_at, inner)


_SUMMARY = "budget int, seq0 long, tok0 int, carried0 long, table_size binary, table_start binary"
_Block = namedtuple("_Block", [part.split()[0] for part in _SUMMARY.split(", ")])
_STATE = "open_size int, open_start long"
_STATE_NAMES = ("open_size", "open_start")


def _field_ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _entry_states(tails: DataFrame, seeds: DataFrame, keys: list[str], fan: int) -> DataFrame:
    """Entry state of every tail block: ``keys, blk`` and the ``_STATE`` columns."""
    key_ddl = _field_ddl(tails, keys)
    names = [part.split()[0] for part in _SUMMARY.split(", ")]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seqs, sizes, budget, overlap, queue in zip(
                batch["seqs"], batch["sizes"], batch["budget"], batch["overlap"], batch["queue"]
            ):
                seqs, sizes, queue = (np.asarray(x, np.int64) for x in (seqs, sizes, queue))
                carried = _carried(queue, sizes, overlap)
                size, start = _summarise(seqs, sizes, budget, carried)
                rows.append(
                    (budget, seqs[0], sizes[0], carried[0], size.tobytes(), start.astype(np.int64).tobytes())
                )
            out = {k: batch[k] for k in [*keys, "blk"]}
            yield pd.DataFrame({**out, **{n: [r[i] for r in rows] for i, n in enumerate(names)}})

    blocks = (
        tails.select(
            *keys, "blk", "budget", "overlap",
            F.col("pieces.seq").alias("seqs"), F.col("pieces.n").alias("sizes"), F.col("queue.n").alias("queue"),
        )
        .mapInPandas(summarise, f"{key_ddl}, blk long, {_SUMMARY}")
        .withColumn("grp", F.floor(F.col("blk") / fan))
    )

    def together(rows: DataFrame, by: list[str], unit: str) -> DataFrame:
        """One row per group, its tables as arrays in order: a task takes many groups at a time."""
        gathered = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(unit, *names))).alias("_all"))
        return gathered.select(*by, *[F.col(f"_all.{c}").alias(c) for c in [unit, *names]])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tables in zip(*(batch[n] for n in names)):
                first, *others = (_Block(*values) for values in zip(*tables))
                size = np.frombuffer(first.table_size, dtype=np.int64)
                start = np.frombuffer(first.table_start, dtype=np.int64)
                for block in others:
                    # start -1 keeps meaning "the group that was open at the first piece"
                    size, start = _through(size, start, block)
                head = (first.budget, first.seq0, first.tok0, first.carried0)
                rows.append((*head, size.astype(np.int64).tobytes(), start.astype(np.int64).tobytes()))
            out = {k: batch[k] for k in [*keys, "grp"]}
            yield pd.DataFrame({**out, **{n: [r[i] for r in rows] for i, n in enumerate(names)}})

    groups = together(blocks, [*keys, "grp"], "blk").mapInPandas(compose, f"{key_ddl}, grp long, {_SUMMARY}")

    def scan(unit: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                at, units, states = [], [], []
                entries = zip(*(batch[c] for c in [*_STATE_NAMES, unit]), zip(*(batch[n] for n in names)))
                for i, (open_size, open_start, own, tables) in enumerate(entries):
                    state = (-1, -1) if pd.isna(open_size) else (int(open_size), int(open_start))
                    for number, values in zip(own, zip(*tables)):
                        at.append(i)
                        units.append(number)
                        states.append(state)
                        size, start = _through(np.array([state[0]]), np.array([state[1]]), _Block(*values))
                        state = (int(size[0]), int(start[0]))
                out = {k: batch[k].to_numpy()[np.array(at, np.int64)] for k in keys}
                out[unit] = units
                yield pd.DataFrame({**out, **{n: [s[i] for s in states] for i, n in enumerate(_STATE_NAMES)}})

        return run

    group_entries = (
        together(groups, keys, "grp")
        .join(seeds, keys, "left")
        .mapInPandas(scan("grp"), f"{key_ddl}, grp long, {_STATE}")
    )
    return (
        together(blocks, [*keys, "grp"], "blk")
        .join(group_entries, [*keys, "grp"])
        .mapInPandas(scan("blk"), f"{key_ddl}, blk long, {_STATE}")
    )


def _queues(blocks: DataFrame, keys: list[str], most_overlap: int) -> DataFrame:
    """``queue``, the last ``overlap`` pieces before each block, in order.

    A block that exists holds a piece, so as many blocks before it as pieces are carried
    over always hold enough; the window runs over the ends of blocks only.
    """
    ends = blocks.select(
        *keys, "blk",
        F.expr("transform(slice(pieces, -least(size(pieces), greatest(overlap, 1)), size(pieces)), p -> named_struct('seq', p.seq, 'n', p.n))").alias("ends"),
        "overlap",
    )
    before = Window.partitionBy(*keys).orderBy("blk").rowsBetween(-max(1, most_overlap), -1)
    gathered = ends.withColumn("queue", F.flatten(F.collect_list("ends").over(before)))
    last = F.expr("slice(queue, -greatest(1, least(size(queue), overlap)), least(size(queue), overlap))")
    return gathered.select(*keys, "blk", F.when(F.size("queue") == 0, F.col("queue")).otherwise(last).alias("queue"))


def fold_pieces(rows: DataFrame, *entry: str) -> DataFrame:
    """Adds ``fold`` to rows with ``pieces, budget, overlap``; ``entry``: open size and queue."""
    return rows.withColumn("fold", F.expr(starts_rule("pieces.n", "budget", "overlap", *entry)))


def cut_groups(
    rows: DataFrame, keys: list[str], carried: list[str], inherited: Column | None = None
) -> DataFrame:
    """One row per group of folded rows: ``keys, carried, group_seq, members``."""
    return (
        rows.select(*keys, *carried, F.explode_outer(_cut(inherited)).alias("g"))
        .filter(F.col("g").isNotNull())
        .select(*keys, *carried, "g.group_seq", "g.members")
    )


def pack_groups(
    pieces: DataFrame,
    keys: tuple[str, ...] = ("source_id",),
    payload: tuple[str, ...] = ("locator", "text"),
    carried: tuple[str, ...] = (),
    block_rows: int = BLOCK_ROWS,
    fan: int = BLOCKS_PER_GROUP,
) -> DataFrame:
    """Pack ``keys, seq, n, budget, overlap, payload`` into groups, one row each.

    Result: ``keys, carried, group_seq`` (sequence number of the piece that began
    the group) and ``members``, the ordered array of ``struct<seq, n, payload>``.
    ``n`` must be at least 1, which bounds a group by its budget.  ``budget``,
    ``overlap`` (any number of pieces) and ``carried`` are constant per key.

    Which keys are longer than one block is checked first.  Usually none is, and
    the plan is one shuffle by key followed by a native fold.
    """
    keys, carried = list(keys), list(carried)
    item = F.struct("seq", F.col("n").cast("int").alias("n"), *payload)
    rule = [F.first(c).alias(c) for c in dict.fromkeys(["budget", "overlap", *carried])]

    def gather(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*keys, *by).agg(
            F.sort_array(F.collect_list(item)).alias("pieces"), *rule
        )

    late = pieces.filter(F.col("seq") >= block_rows)
    most_overlap = late.agg(F.max("overlap")).first()[0]
    if most_overlap is None:
        return cut_groups(fold_pieces(gather(pieces)), keys, carried)

    long_keys = late.select(*keys).distinct()
    short = cut_groups(
        fold_pieces(gather(pieces.join(long_keys, keys, "left_anti"))), keys, carried
    )
    blocks = gather(
        pieces.join(long_keys, keys, "left_semi").withColumn(
            "blk", F.floor(F.col("seq") / block_rows)
        ),
        "blk",
    )
    heads = fold_pieces(blocks.filter(F.col("blk") == 0))
    tails = blocks.filter(F.col("blk") > 0).join(_queues(blocks, keys, most_overlap), [*keys, "blk"])
    seeds = heads.select(
        *keys,
        F.least(F.col("fold.size"), F.col("budget")).alias("open_size"),
        F.get(F.col("pieces.seq"), F.element_at("fold.starts", -1)).alias("open_start"),
    )
    entered = fold_pieces(
        tails.join(_entry_states(tails, seeds, keys, fan), [*keys, "blk"]), "open_size", "queue.n"
    )
    # with overlap, a group that begins early in a block also holds pieces from before it
    early = F.filter("fold.starts", lambda i: i < F.col("overlap"))
    borrowed = (
        entered.select(*keys, "overlap", "queue", "pieces", F.explode(early).alias("_at"))
        .select(
            *keys,
            F.get("pieces", F.col("_at"))["seq"].alias("group_seq"),
            F.explode(F.expr("if(size(queue) = 0, array(), slice(queue.seq, -least(size(queue), overlap - _at), size(queue)))")).alias("seq"),
        )
        .join(pieces, [*keys, "seq"])
        .select(*keys, *carried, "group_seq", F.array(item).alias("members"))
    )
    parts = (
        cut_groups(heads, keys, carried)
        .unionByName(cut_groups(entered, keys, carried, F.col("open_start")))
        .unionByName(borrowed)
    )
    merged = parts.groupBy(*keys, "group_seq").agg(
        F.sort_array(F.flatten(F.collect_list("members"))).alias("members"),
        *[F.first(c).alias(c) for c in carried],
    )
    return short.unionByName(merged)


def _cut(inherited: Column | None) -> Column:
    """``array<struct<group_seq, members>>`` of one folded block."""
    pieces, starts = F.col("pieces"), F.col("fold.starts")

    def group(start: Column, j: Column) -> Column:
        stop = F.coalesce(F.get(starts, j + 1), F.size(pieces))
        low = F.greatest(F.lit(0), start - F.col("overlap"))
        return F.struct(
            F.get(pieces, start)["seq"].alias("group_seq"),
            F.slice(pieces, low + 1, stop - low).alias("members"),
        )

    own = F.transform(starts, group)
    if inherited is None:
        return own
    stop = F.coalesce(F.get(starts, F.lit(0)), F.size(pieces))
    carried_on = F.filter(
        F.array(
            F.struct(
                inherited.alias("group_seq"), F.slice(pieces, F.lit(1), stop).alias("members")
            )
        ),
        lambda g: F.size(g["members"]) > 0,
    )
    return F.concat(carried_on, own)


# --- batches with two budgets ------------------------------------------------------
def _next_starts(sizes: np.ndarray, max_items: int, max_tokens: int) -> np.ndarray:
    """For a batch that begins at i, the index at which the next one begins."""
    cum = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    index = np.arange(len(sizes))
    full = np.searchsorted(cum, cum[index] + max_tokens, side="right") - 1
    return np.maximum(index + 1, np.minimum(index + max_items, full))


def batch_groups(
    items: DataFrame,
    keys: list[str],
    max_items: int,
    max_tokens: int,
    block_rows: int,
    fan: int = BLOCKS_PER_GROUP,
) -> DataFrame:
    """``keys, pos, batch_start`` for items ``keys, pos, n`` with dense positions.

    A batch never holds more than ``max_items`` items, so the fold's state at a
    block border is how many of the last items belong to the open batch.  Each
    block carries that many items of its predecessor and maps every possible
    state to the state at its end; those tables compose like the ones above.
    """
    if block_rows < max_items:
        raise ValueError("a block must hold at least one full batch")
    key_ddl = _field_ddl(items, keys)
    own = F.floor(F.col("pos") / block_rows)
    reach = F.col("pos") % block_rows >= block_rows - max_items
    copies = items.select(
        *keys, "pos", F.col("n").cast("int").alias("n"),
        F.explode(F.when(reach, F.array(own, own + 1)).otherwise(F.array(own))).alias("blk"),
    )
    blocks = copies.groupBy(*keys, "blk").agg(
        F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("pieces")
    ).filter(F.element_at("pieces.pos", -1) >= F.col("blk") * block_rows)

    def split(blk: int, pos, sizes):
        pos, sizes = np.asarray(pos, np.int64), np.asarray(sizes, np.int64)
        halo = int(np.searchsorted(pos, blk * block_rows))
        return pos, sizes, halo

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frames = []
            for row in batch.itertuples(index=False):
                pos, sizes, halo = split(row.blk, row.pos, row.n)
                nxt = _next_starts(sizes, max_items, max_tokens)
                begin = np.empty(len(sizes), dtype=np.int64)
                at = halo - int(row.open)
                while at < len(sizes):
                    begin[at : nxt[at]] = pos[at]
                    at = int(nxt[at])
                head = {k: [getattr(row, k)] * (len(sizes) - halo) for k in keys}
                frames.append(pd.DataFrame({**head, "pos": pos[halo:], "batch_start": begin[halo:]}))
            if frames:
                yield pd.concat(frames)

    def fold(rows: DataFrame) -> DataFrame:
        flat = rows.select(*keys, "blk", F.col("pieces.pos").alias("pos"), F.col("pieces.n").alias("n"), "open")
        return flat.mapInPandas(starts, f"{key_ddl}, pos long, batch_start long")

    if items.filter(F.col("pos") >= block_rows).isEmpty():
        return fold(blocks.withColumn("open", F.lit(0)))

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                _, sizes, halo = split(row.blk, row.pos, row.n)
                m = len(sizes)
                last = _last_of_chain(_next_starts(sizes, max_items, max_tokens))
                states = halo - np.minimum(np.arange(max_items + 1), halo)
                out.append((m - last[states]).astype(np.int64).tobytes())
            yield pd.DataFrame({**{k: batch[k] for k in [*keys, "blk"]}, "steps": out})

    steps = (
        blocks.select(*keys, "blk", F.col("pieces.pos").alias("pos"), F.col("pieces.n").alias("n"))
        .mapInPandas(tables, f"{key_ddl}, blk long, steps binary")
        .withColumn("grp", F.floor(F.col("blk") / fan))
    )

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        state = np.arange(max_items + 1)
        for table in group.sort_values("blk")["steps"]:
            state = np.frombuffer(table, dtype=np.int64)[state]
        head = {k: [group.iloc[0][k]] for k in [*keys, "grp"]}
        return pd.DataFrame({**head, "steps": [state.astype(np.int64).tobytes()]})

    def scan(unit: str):
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(unit)
            state, out = int(group.iloc[0]["open"]), []
            for table in group["steps"]:
                out.append(state)
                state = int(np.frombuffer(table, dtype=np.int64)[state])
            return group[[*keys, unit]].assign(open=out)

        return run

    groups = steps.groupBy(*keys, "grp").applyInPandas(compose, f"{key_ddl}, grp long, steps binary")
    group_open = (
        groups.withColumn("open", F.lit(0).cast("long"))
        .groupBy(*keys)
        .applyInPandas(scan("grp"), f"{key_ddl}, grp long, open long")
    )
    block_open = (
        steps.join(group_open, [*keys, "grp"])
        .groupBy(*keys, "grp")
        .applyInPandas(scan("blk"), f"{key_ddl}, blk long, open long")
    )
    return fold(blocks.join(block_open, [*keys, "blk"]))
