"""Which of many needles a text contains, in one pass over the text.

The needles come as a table of any size.  They are cut into blocks of bounded bytes; each
block becomes an Aho-Corasick automaton, sent to the workers as a broadcast and built once
per task.  A text is read once per block, however many needles a block holds, and the plan
only grows with the number of blocks.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curricle.functions.exprs import ColumnLike, col

# the matcher travels with the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 20


def _matcher(shared):
    """Texts → sorted distinct groups of the needles that they contain."""

    def match(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        groups_of: dict[str, list[int]] = {}
        for needle, group in shared.value:
            groups_of.setdefault(needle, []).append(group)
        always = groups_of.pop("", [])
        automaton = ahocorasick.Automaton()
        for needle, groups in groups_of.items():
            automaton.add_word(needle, groups)
        if groups_of:
            automaton.make_automaton()
        for batch in texts:
            rows = []
            for text in batch.to_pylist():
                found = set(always) if text is not None else set()
                if text and groups_of:
                    for _, groups in automaton.iter(text):
                        found.update(groups)
                rows.append(sorted(found))
            yield pa.array(rows, pa.list_(pa.int64()))

    match.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(match, "array<long>")


def needle_groups(needles: DataFrame, block_bytes: int = BLOCK_BYTES) -> Callable[[ColumnLike], Column]:
    """From ``grp long, needle string`` to ``text -> array<long>`` of the groups found.

    A group is listed once, however many of its needles a text contains.  Null needles are
    left out, an empty one is contained in every text, a null text contains none.
    """
    spark = needles.sparkSession
    usable = needles.filter("needle IS NOT NULL AND grp IS NOT NULL").select(
        "needle", F.col("grp").cast("long").alias("grp")
    )
    size = usable.agg(F.sum(F.octet_length("needle") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("needle"), F.lit(blocks))
    matchers = [
        _matcher(spark.sparkContext.broadcast([tuple(r) for r in usable.filter(block == i).collect()]))
        for i in range(blocks)
    ]

    def groups(text: ColumnLike) -> Column:
        found = [m(col(text)) for m in matchers]
        return found[0] if blocks == 1 else F.array_distinct(F.flatten(F.array(*found)))

    return groups
