"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At every level each child draws
`-ln(u) / weight`, u being a hash of (id, child); the smallest draw wins, which picks a
child with a probability in proportion to its weight.  A node weighs what its leaves
weigh.  If a weight changes, draws change for the nodes above that leaf alone, so at each
level documents move only into (or out of) the subtree whose weight changed.

A shard that is added later hangs at the top as a region and rack of its own.  It takes
documents only into itself: no other draw changes, and below it there is one choice.

Placement is row local.  Slots (gapless numbers inside a shard) come from counts per input
partition, so no shard is ever gathered in one task.  Only DataFrame functions are used.

Null ids are placed like any other value (all in one shard); null texts have size
`overhead`; rows with equal id share a shard and get different slots; other input columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curricle.llm.frames import stored

#: weights[region][rack][shard]
Tree = Sequence[Sequence[Sequence[float]]]


def even_tree(shards: int, regions: int = 2, racks: int = 4) -> list[list[list[float]]]:
    """Shards of equal weight dealt evenly over regions and racks."""
    tree: list[list[list[float]]] = [[[] for _ in range(racks)] for _ in range(regions)]
    for shard in range(shards):
        place = shard * regions * racks // shards
        tree[place // racks][place % racks].append(1.0)
    return [kept for region in tree if (kept := [rack for rack in region if rack])]


def with_added(tree: Tree, weight: float = 1.0) -> list[list[list[float]]]:
    """The tree with one more shard, numbered after all others."""
    return [[list(rack) for rack in region] for region in tree] + [[[weight]]]


def _draw(id_text: Column, child: str, weight: float) -> Column:
    hashed = F.xxhash64(id_text, F.lit(child))
    uniform = (F.shiftrightunsigned(hashed, 11) + F.lit(1)) / F.lit(float(2**53 + 1))
    return -F.log(uniform) / F.lit(float(weight))


def _choice(id_text: Column, children: list[tuple[str, float]]) -> Column:
    """The number of the child with the least draw; of equal draws, the first."""
    draws = F.array(*[_draw(id_text, child, weight) for child, weight in children])
    return F.transform(
        F.array(draws), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1
    )[0]


def _weight(node) -> float:
    return sum(map(_weight, node)) if isinstance(node, (list, tuple)) else float(node)


def place(docs: DataFrame, tree: Tree, name: str = "shard", id_col: str = "doc_id") -> DataFrame:
    """Adds the column `name`: the shard of each row, decided by its id and the tree."""
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    racks = [(r, k) for r, region in enumerate(tree) for k in range(len(region))]
    rack_of = {place: number for number, place in enumerate(racks)}
    first = [sum(len(tree[r][k]) for r, k in racks[:number]) for number in range(len(racks))]

    def below(chosen: Column, branches: list[Column]) -> Column:
        result = branches[-1]
        for number in range(len(branches) - 2, -1, -1):
            result = F.when(chosen == number, branches[number]).otherwise(result)
        return result

    regions = [(f"{r}", _weight(region)) for r, region in enumerate(tree)]
    rack_choices = [
        _choice(id_text, [(f"{r}/{k}", _weight(rack)) for k, rack in enumerate(region)])
        + rack_of[r, 0]
        for r, region in enumerate(tree)
    ]
    shard_choices = [
        _choice(id_text, [(f"{r}/{k}/{s}", w) for s, w in enumerate(tree[r][k])]) + first[number]
        for number, (r, k) in enumerate(racks)
    ]
    return (
        docs.withColumn("__region", _choice(id_text, regions))
        .withColumn("__rack", below(F.col("__region"), rack_choices))
        .withColumn(name, below(F.col("__rack"), shard_choices).cast("int"))
        .drop("__region", "__rack")
    )


def with_slots(placed: DataFrame, order: Sequence[str], shard: str = "shard") -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard; `__part` (input partition) splits the shards.

    Inside a partition rows are numbered by `order`; the rows before that partition are a
    count.  The largest window holds the rows of one shard and one input partition.
    """
    counts = placed.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(shard).alias("__shard"),
        F.col("__part").alias("__piece"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"),
    )
    inside = Window.partitionBy(shard, "__part").orderBy(*order)
    numbered = placed.withColumn("__row", F.row_number().over(inside) - 1)
    return numbered.join(
        starts,
        (F.col(shard) == F.col("__shard")) & (F.col("__part") == F.col("__piece")),
    ).withColumn("slot", (F.col("__start") + F.col("__row")).cast("long"))


def shard_documents(
    docs: DataFrame,
    tree: Tree,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 16,
) -> DataFrame:
    """Shard manifest: id, size, checksum, shard, slot, and the shard in the grown tree."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.spark_partition_id().alias("__part"),
    )
    placed = place(place(narrow, tree), with_added(tree), "grown_shard")
    # one reading of the partition numbers serves both counts and rows
    placed = stored(placed)
    return with_slots(placed, ("doc_id", "text_crc32", "size")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )
