"""Connected components of a table of links, by alternating star contractions.

Large star: every neighbour greater than a node is linked to the least node around it.
Small star: every neighbour smaller than a node, and the node, are linked to the least.
Both keep the components; after a number of rounds that grows with the logarithm of the
number of nodes each component is a star around its least node.  Each step is an
aggregate with map-side combine and a join that adaptive execution can split, so a hub
with very many links is not gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curricle.llm.frames import spread_join, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return spread_join(both.filter("b > a"), least, "a").select(
        F.col("b").alias("a"), F.col("m").alias("b")
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = spread_join(down, least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
        least.select("a", F.col("m").alias("b"))
    )


def _tidy(links: DataFrame) -> DataFrame:
    return links.filter("a != b").distinct()


def _signature(links: DataFrame):
    """Number of links and a sum over their hashes; equal for equal sets."""
    mixed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed)).first())


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (a, b) of integers to (node, root): each linked node but the roots, once."""
    links = stored(_tidy(links))
    before = _signature(links)
    for _ in range(rounds):
        if not before[0]:
            break
        links = stored(_tidy(_small_star(_tidy(_large_star(links)))))
        after = _signature(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links have not settled after {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
