"""Near-duplicates by SimHash, found through tables of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to REFERENCES, taken over each
quarter of the bits.  Two fingerprints at most `radius` = 2 bits apart agree on at least
two quarters, hence in all reference distances over those; the vector of these distances
is the join key of one of six tables.  Inside a bucket the distances over the whole 64
bits can differ by 2 at most: pairs with a greater coordinate difference are discarded,
survivors are verified bit by bit.  Nothing is missed and no pair is emitted: a bucket
yields its links as stars (fingerprint, least fingerprint it reaches in the bucket), one
row a fingerprint, which keeps the components.

Buckets beyond `limit` fingerprints are split exactly: the undecided half of the bits is
cut in three, one third of which must agree again (at most two bits differ), and again.
After two splits 15 bits at most are open, so a bucket holds at most 2 ** 15 fingerprints.

Exact copies share a fingerprint and meet in its map-side combine, so they cost one row.
Null and wordless texts have fingerprint zero and are linked like any other.  Rows with
equal ids are one document to `component_id`; a null id is ignored there, a component with
null ids alone has component null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curricle.llm.components import connected_components
from curricle.llm.frames import spread_join, stored

SHINGLE = 3
SEED = 42
RADIUS = 2
QUARTERS = tuple(0xFFFF << shift for shift in (0, 16, 32, 48))
#: 64-bit fingerprints that distances are measured to, made by rule.
REFERENCES = tuple(
    int.from_bytes(hashlib.sha256(b"reference %d" % number).digest()[:8], "little")
    for number in range(16)
)
#: Largest bucket that is compared as it is.
LIMIT = 1024


def fingerprint_of(text: bytes, width: int = SHINGLE) -> int:
    """SimHash over the XXH64 of word shingles; zero for no words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:n].tolist()
    stops = ends[min(width, len(words)) - 1 :].tolist()
    hashes = np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for begin in range(0, n, 1 << 16):
        part = hashes[begin : begin + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType

    def compute(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [_signed(fingerprint_of(text.as_py())) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"]
            )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(compute, schema)


def _pieces(mask: int, count: int) -> list[int]:
    """The bits of a mask in `count` masks of nearly equal size."""
    bits = [bit for bit in range(64) if mask >> bit & 1]
    cuts = [len(bits) * k // count for k in range(count + 1)]
    return [sum(1 << bit for bit in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _tables() -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """For each pair of quarters: its bits, and the bits that two further splits add."""
    result = []
    for pair in combinations(QUARTERS, 2):
        same = pair[0] | pair[1]
        first = _pieces(~same & (1 << 64) - 1, 3)
        result.append((same, [(x, _pieces(~(same | x) & (1 << 64) - 1, 3)) for x in first]))
    return result


def _pivot_key(number: int, mask: int) -> Column:
    """Hash of the distances to the references over each quarter in the mask."""
    distances = [
        F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(ref))).bitwiseAND(F.lit(_signed(quarter))))
        for quarter in QUARTERS
        if quarter & mask
        for ref in REFERENCES
    ]
    return F.xxhash64(F.lit(number), *distances)


def _bit_key(path: list[int], mask: int) -> Column:
    return F.xxhash64(*map(F.lit, path), F.col("fp").bitwiseAND(F.lit(_signed(mask))))


def _bucket_links(batches: Iterator) -> Iterator:
    """From (key, fp) sorted by key to (a, b): stars of the links inside each bucket."""
    import numpy as np
    import pyarrow as pa

    refs = np.array(REFERENCES, np.uint64)

    def stars(keys, fps):
        left, right = [], []
        table = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
        active = np.arange(len(fps) - 1)
        step = 1
        while len(active):
            active = active[active + step < len(fps)]
            active = active[keys[active] == keys[active + step]]
            for begin in range(0, len(active), 1 << 18):
                a = active[begin : begin + (1 << 18)]
                near = np.abs(table[a] - table[a + step]).max(axis=1) <= RADIUS
                a = a[near]
                a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= RADIUS]
                left.append(a)
                right.append(a + step)
            step += 1
        a = np.concatenate(left) if left else np.zeros(0, np.int64)
        b = np.concatenate(right) if right else np.zeros(0, np.int64)
        # labels are row numbers; rows of a bucket are adjacent, links stay inside a bucket
        label = np.arange(len(fps))
        while True:
            least = np.minimum(label[a], label[b])
            fresh = label.copy()
            np.minimum.at(fresh, label[a], least)
            np.minimum.at(fresh, label[b], least)
            fresh = fresh[fresh]
            if (fresh == label).all():
                break
            label = fresh
        rows = np.flatnonzero(label != np.arange(len(fps)))
        return fps[rows].view(np.int64), fps[label[rows]].view(np.int64)

    def emit(keys, fps):
        a, b = stars(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([held_keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate(
            [held_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
        )
        if not len(keys):
            continue
        open_from = int(np.searchsorted(keys, keys[-1]))
        if open_from:
            yield emit(keys[:open_from], fps[:open_from])
        held_keys, held_fps = keys[open_from:], fps[open_from:]
    if len(held_keys):
        yield emit(held_keys, held_fps)


def near_links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """From distinct fingerprints (fp) to links (a, b) with the components of radius 2."""
    tables = _tables()
    rows = fps.select(
        "fp",
        F.posexplode(F.array(*[_pivot_key(k, same) for k, (same, _) in enumerate(tables)])).alias(
            "path", "key"
        ),
    )
    found = None
    for depth in range(3):
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        last = depth == 2
        small = sizes.filter("n > 1" if last else f"n > 1 AND n <= {limit}")
        ready = spread_join(rows, small.select("key"), "key", "left_semi")
        links = (
            ready.select("key", "fp")
            .repartition("key")
            .sortWithinPartitions("key")
            .mapInArrow(_bucket_links, "a long, b long")
        )
        found = links if found is None else found.unionAll(links)
        if last:
            return found
        hot = sizes.filter(f"n > {limit}").select("key")
        spilled = stored(spread_join(rows, hot, "key", "left_semi"))
        if spilled.isEmpty():
            return found
        if depth == 0:
            choices = [
                F.array(*[_bit_key([k, j], same | x) for j, (x, _) in enumerate(parts)])
                for k, (same, parts) in enumerate(tables)
            ]
        else:
            choices = [
                F.array(*[_bit_key([k, j, i], same | x | y) for i, y in enumerate(more)])
                for k, (same, parts) in enumerate(tables)
                for j, (x, more) in enumerate(parts)
            ]
        chosen = choices[-1]
        for number in range(len(choices) - 2, -1, -1):
            chosen = F.when(F.col("path") == number, choices[number]).otherwise(chosen)
        rows = spilled.select("fp", "path", F.posexplode(chosen).alias("branch", "key")).select(
            "fp", (F.col("path") * 3 + F.col("branch")).alias("path"), "key"
        )
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    prints = stored(fingerprints(docs, id_col, text_col))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(near_links(classes.select("fp"), limit))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    members = spread_join(rooted.select("fp", "root"), least, "root").select("fp", "component_id")
    return spread_join(prints, members, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
