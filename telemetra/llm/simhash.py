"""Near-duplicate documents by SimHash and pigeonhole blocks.

The fingerprint of a document has 64 bits; one is set if it is set in over half of the
XXH64 values (seed 42) of the document's word shingles, repeats included.  Documents whose
fingerprints differ in at most ``distance`` bits are linked; a group is what links connect.

1. Equal fingerprints are one node, aggregated before the shuffle.
2. Blocks.  The bits are cut into b blocks.  At most ``distance`` of them differ in a
   linked pair, so it agrees on b - distance blocks: for each choice of so many blocks
   a node has a key, and linked nodes share one.  b grows with the number of nodes,
   so that a key has more values than there are nodes and chance buckets stay small.
3. Verify.  Buckets of two nodes are compared as they are aggregated.  Buckets of up to
   ``CROWD`` nodes are spanned in a task: a node is compared with those not
   reached yet, and only the links of a spanning tree are written.
4. Crowds.  Nodes of larger buckets meet by midpoints: linked fingerprints have a
   value at most half the distance from both, so each node is written once for each value
   that near, and whoever is at one value is linked to its least node.  That is a fixed
   number of rows a node however large the crowd, with a map-side minimum.
5. Components by star contraction, and the least document of each.

Null texts and texts without words have the fingerprint zero and are linked like any other;
texts with fewer words have their whole sequence as one shingle.  A row without doc_id takes
part, but the least document of a group is one with an id, if there is any.  Rows that share an id are judged by their own texts; equal rows get
equal results.  Other columns play no part.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.llm import arrays
from telemetra.llm.common import stage
from telemetra.llm.components import components
from telemetra.session import ship_package

SEED = 42
#: Nodes of a bucket that one task spans.
CROWD = 2048
#: Blocks in use at most; C(10, 4) = 210 keys of 38 bits.
MOST_BLOCKS = 10
SLICE_BYTES = 1 << 20

#: Eight counters in a word: bit i of a byte is byte i of the entry.
_LANES = (
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    .reshape(256, 8).copy().view(np.uint64).reshape(-1)
)


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of each text, repeats included, and their n + 1 offsets."""
    data, at = arrays.flat(texts)
    found = arrays.Words(arrays.LOWER[data], at, arrays.SPACED)
    rows, count = found.rows, found.counts()
    # every word followed by one space, so that a shingle is one range of bytes
    size = found.end - found.start + 1
    stop = np.cumsum(size)
    spelled = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    letter = np.ones(len(spelled), bool)
    letter[stop - 1] = False
    spelled[letter] = found._packed
    raw = spelled.tobytes()
    begin, end = stop - size, stop - 1
    held = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    first = np.repeat(rows[:-1] - np.r_[0, np.cumsum(held)[:-1]], held) + np.arange(held.sum())
    last = first + np.repeat(np.minimum(words, count), held) - 1
    spots = zip(begin[first].tolist(), end[last].tolist(), strict=True)
    pieces = [raw[low:high] for low, high in spots]
    value = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))
    return value, np.r_[0, np.cumsum(held)]


def fingerprints(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each text; counters of eight bits are emptied every 255 hashes."""
    n = len(at) - 1
    out = np.zeros(n, np.uint64)
    size = np.diff(at)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    parts = -(-size[full] // 255)
    turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(at[full], parts) + 255 * turn
    texts = np.cumsum(parts) - parts
    octets = value.astype("<u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), texts, axis=0)
        ones = 2 * counts > size[full][:, None]
        octet = np.packbits(ones, axis=1, bitorder="little")[:, 0].astype(np.uint64)
        out[full] |= octet << np.uint64(8 * j)
    return out


def _sketch(words: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text", SLICE_BYTES):
            value, at = shingle_hashes(part.column("text"), words)
            mark = arrays.signed(fingerprints(value, at))
            yield pa.RecordBatch.from_arrays([part.column("_doc"), pa.array(mark)], ["_doc", "mark"])

    return run


def block_masks(nodes: int, distance: int) -> list[int]:
    """The bits of each choice of blocks, for so many nodes; a key has twice as many values."""
    need = math.log2(max(nodes, 2)) + 1
    for blocks in range(distance + 1, MOST_BLOCKS + 1):
        edge = [round(64 * i / blocks) for i in range(blocks + 1)]
        block = [(1 << high) - (1 << low) for low, high in zip(edge, edge[1:])]
        masks = [sum(chosen) for chosen in combinations(block, blocks - distance)]
        if min(m.bit_count() for m in masks) >= need:
            break
    return masks


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def spanning_links(marks: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that connect what links of one bucket connect, one less than the nodes at most."""
    x: list[int] = []
    y: list[int] = []
    left = marks.view(np.uint64)  # numpy counts the bits of absolute values
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            node = reached.pop()
            close = np.bitwise_count(left ^ node) <= distance
            if close.any():
                hit = left[close]
                reached.extend(hit)
                x.extend([int(node.view(np.int64))] * len(hit))
                y.extend(hit.view(np.int64).tolist())
                left = left[~close]
    return x, y


def _spanned(rows: DataFrame, distance: int) -> DataFrame:
    """Links of buckets of at most CROWD nodes; a task streams sorted rows and holds one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, key, mark = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            new = [batch.column(c).to_numpy().astype(np.int64) for c in ("slot", "key", "mark")]
            slot, key, mark = (np.r_[a, b] for a, b in zip((slot, key, mark), new, strict=True))
            edge = np.flatnonzero((np.diff(slot) != 0) | (np.diff(key) != 0)) + 1
            if len(edge):
                yield _linked(mark[: edge[-1]], np.r_[0, edge], distance)
                slot, key, mark = slot[edge[-1] :], key[edge[-1] :], mark[edge[-1] :]
        yield _linked(mark, np.array([0, len(mark)]), distance)

    # by a hash, not by the columns: Spark drops a repartition by the keys of the join before it, and
    # as nothing after it asks for whole buckets, adaptive execution may read that join's shuffle in pieces
    dealt = rows.repartition(F.xxhash64("slot", "key")).sortWithinPartitions("slot", "key")
    return dealt.mapInArrow(run, "x long, y long")


def _linked(mark: np.ndarray, edge: np.ndarray, distance: int) -> pa.RecordBatch:
    x: list[int] = []
    y: list[int] = []
    for low, high in zip(edge[:-1], edge[1:], strict=True):
        a, b = spanning_links(mark[low:high], distance)
        x += a
        y += b
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])


def midpoints(distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The differences to values up to half the distance away, and whether a link's other half
    may be as long; for an odd distance one of both may be one bit further."""
    near = distance // 2
    flips, inner = [], []
    for bits in range(near + distance % 2 + 1):
        for chosen in combinations(range(64), bits):
            flips.append(sum(1 << i for i in chosen))
            inner.append(bits <= near)
    return np.array(flips, np.uint64), np.array(inner)


def _crowded(nodes: DataFrame, distance: int) -> DataFrame:
    """Links of nodes of large buckets, by the values halfway."""
    flips, inner = midpoints(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark").to_numpy()
            for low in range(0, len(marks), 64):
                some = marks[low : low + 64]
                value = arrays.signed((some.view(np.uint64)[:, None] ^ flips).reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value), pa.array(np.repeat(some, len(flips))), pa.array(np.tile(inner, len(some)))],
                    ["value", "mark", "inner"],
                )

    spread = nodes.mapInArrow(run, "value long, mark long, inner boolean")
    least = F.min(F.when(F.col("inner"), F.col("mark"))).alias("least")
    met = spread.groupBy("value").agg(least, F.count("*").alias("n"))
    met = stage(met.filter("n > 1 AND least IS NOT NULL").drop("n"), "midpoints")
    pairs = spread.join(met, "value").filter("mark <> least")
    return pairs.select(F.col("least").alias("x"), F.col("mark").alias("y")).distinct()


def linked_nodes(nodes: DataFrame, distance: int) -> DataFrame:
    """Links (x, y) that connect the fingerprints ``mark`` of a staged table as all links do."""
    masks = block_masks(nodes.count(), distance)
    chosen = F.array(*[F.lit(_long(m)) for m in masks])
    keys = nodes.select(
        "mark",
        F.posexplode(F.transform(chosen, lambda m: F.col("mark").bitwiseAND(m))).alias("slot", "key"),
    )
    buckets = keys.groupBy("slot", "key").agg(
        F.count("*").alias("n"), F.min("mark").alias("x"), F.max("mark").alias("y")
    )
    buckets = stage(buckets.filter("n > 1"), "buckets")
    pairs = buckets.filter("n = 2").select("x", "y").filter(_near("x", "y", distance))
    some = buckets.filter(F.col("n").between(3, CROWD)).select("slot", "key")
    links = pairs.unionByName(_spanned(keys.join(some, ["slot", "key"]), distance))
    crowds = buckets.filter(F.col("n") > CROWD).select("slot", "key")
    if crowds.isEmpty():
        return links
    crowd = stage(keys.join(crowds, ["slot", "key"]).select("mark").distinct(), "crowd")
    return links.unionByName(_crowded(crowd, distance))


def near_fingerprints(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``; fingerprint is a long."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text")
    sketches = stage(texts.mapInArrow(_sketch(words), "_doc long, mark long"), "fingerprints")
    nodes = stage(sketches.groupBy("mark").agg(F.min("_doc").alias("_doc")), "nodes")
    groups = components(linked_nodes(nodes.select("mark"), distance))
    grouped = nodes.join(groups.withColumnRenamed("node", "mark"), "mark", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "mark"))
    least = grouped.groupBy("component").agg(F.min("_doc").alias("least"))
    named = grouped.join(least, "component").select("mark", "least")
    return sketches.join(named, "mark").select(
        F.col("_doc").alias("doc_id"),
        F.col("mark").alias("fingerprint"),
        F.col("least").alias("component_id"),
    )
