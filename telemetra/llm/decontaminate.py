"""Benchmark decontamination by n-gram windows.

The windows of the benchmark are a broadcast hash set; training texts are
scanned window by window, hash hits are verified on the words themselves, and
all words inside verified windows are marked.  A window has ``n`` consecutive
words; an item with fewer words, but not none, is one window.

The set is broadcast in blocks of about ``block_windows`` pairs of a window and an item.  A
larger benchmark makes more blocks, each a pass of its own over the rows, written
before the next, so what a task, a worker and the driver hold is one block however the
benchmark grows, also if one window is in very many items.  A worker builds a block once.

Null texts have no words.  Items without an id count under the empty id; items
that share an id count as one.  An empty benchmark marks nothing; an empty table
gives an empty result.  Rows with null or repeated doc_id are marked like all
others.  ``mark`` keeps all columns and adds (or replaces) one struct column.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm import arrays
from telemetra.llm.common import schema_with, stage, with_column
from telemetra.session import ship_package

_FLAG_BITS = 20
MARK = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW_MARK = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.int64())),
        ("items", pa.list_(pa.string())),
    ]
)


def _words(texts: pa.Array) -> arrays.Words:
    data, at = arrays.flat(texts)
    return arrays.Words(arrays.LOWER[data], at, arrays.ALNUM)


def _spelled(words: arrays.Words, low: int, high: int) -> bytes:
    return b" ".join(
        words.data[a:b].tobytes() for a, b in zip(words.start[low:high], words.end[low:high])
    )


def windows(items: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, size, window) of the benchmark; a window is its words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text"):
            words = _words(part.column("text"))
            ids = part.column("item").to_pylist()
            for i, item in enumerate(ids):
                low, high = int(words.rows[i]), int(words.rows[i + 1])
                size = min(n, high - low)
                found = {_spelled(words, s, s + size) for s in range(low, high - size + 1) if size}
                rows = sorted(found)
                yield pa.RecordBatch.from_pydict(
                    {"item": [item] * len(rows), "size": pa.array([size] * len(rows), pa.int32()),
                     "window": pa.array(rows, pa.binary())}
                )

    source = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.col(text).alias("text"),
    )
    return source.mapInArrow(run, "item string, size int, window binary").distinct()


class _Block:
    """A hash set of windows with the items of each."""

    def __init__(self, rows: list[tuple[str, int, bytes]]):
        items: dict[tuple[int, bytes], list[str]] = defaultdict(list)
        for item, size, window in rows:
            items[size, window].append(item)
        self.items = items
        self.hashes: dict[int, np.ndarray] = {}
        self.flags: dict[int, np.ndarray] = {}
        for size in {size for size, _ in items}:
            spelled = [w for s, w in items if s == size]
            words = arrays.hash_all([w for x in spelled for w in x.split(b" ")])
            units = words.reshape(len(spelled), size)
            hashes = np.concatenate([arrays.gram_hashes(u, size) for u in units])
            self.hashes[size] = np.sort(hashes)
            flags = np.zeros(1 << _FLAG_BITS, bool)
            flags[hashes >> np.uint64(64 - _FLAG_BITS)] = True
            self.flags[size] = flags

    def hits(self, words: arrays.Words, units: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, size, items) of each verified window."""
        for size, known in self.hashes.items():
            grams = arrays.gram_hashes(units, size)
            spot = np.flatnonzero(self.flags[size][grams >> np.uint64(64 - _FLAG_BITS)])
            at = np.minimum(np.searchsorted(known, grams[spot]), len(known) - 1)
            spot = spot[known[at] == grams[spot]]
            text = np.searchsorted(words.rows, spot, side="right") - 1
            spot = spot[spot + size <= words.rows[text + 1]]
            for low in spot.tolist():
                items = self.items.get((size, _spelled(words, low, low + size)))
                if items:
                    yield low, size, items


def _scan(block: _Block | None, part: pa.RecordBatch, text: str, into: str, old: bool) -> pa.Array:
    words = _words(part.column(text))
    n = part.num_rows
    inside = np.zeros(len(words), bool)
    items: list[set[str]] = [set() for _ in range(n)]
    if old:  # what earlier blocks have found
        for i, mark in enumerate(part.column(into).to_pylist()):
            items[i].update(mark["items"])
            for low, high in zip(mark["spans"][::2], mark["spans"][1::2], strict=True):
                inside[words.rows[i] + low : words.rows[i] + high] = True
    if block is not None and len(words):
        for low, size, found in block.hits(words, words.hashes()):
            inside[low : low + size] = True
            items[int(np.searchsorted(words.rows, low, side="right")) - 1].update(found)
    hit = np.r_[0, np.cumsum(inside)][words.rows]
    counts, out = words.counts(), []
    for i in range(n):
        spans: list[int] = []
        if hit[i + 1] > hit[i]:
            own = inside[words.rows[i] : words.rows[i + 1]].astype(np.int8)
            edge = np.diff(np.r_[0, own, 0])
            pairs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)
            spans = pairs.reshape(-1).tolist()
        out.append(
            {"n_words": int(counts[i]), "n_hit": int(hit[i + 1] - hit[i]), "spans": spans,
             "items": sorted(items[i])}
        )
    return pa.array(out, _ARROW_MARK)


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    text: str = "text",
    into: str = "leak",
    block_windows: int = 1 << 20,
) -> DataFrame:
    """Adds a struct: n_words, n_hit, spans (first word, end, ...), items with occurring windows."""
    spark = docs.sparkSession
    ship_package(spark)
    known = stage(windows(benchmark, n), "windows")
    total = known.count()
    blocks = max(1, -(-total // block_windows))
    out, held = docs, None
    for k in range(blocks):
        if held is not None:
            out = stage(out, "marked")
            held.unpersist()
        rows = known.filter(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast([tuple(r) for r in rows.collect()])  # one block
        out = out.mapInArrow(_pass(held, text, into, k > 0), schema_with(out, into, MARK))
    return out


#: The block that this worker has built last.
_BUILT: dict[str, _Block | None] = {}


def _built(name: str, rows: list[tuple]) -> _Block | None:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = _Block([(i, s, bytes(w)) for i, s, w in rows]) if rows else None
    return _BUILT[name]


def _pass(held, text: str, into: str, old: bool):  # noqa: ANN001, ANN202
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _built(name, held.value)
        for part in arrays.slices(batches, text):
            yield with_column(part, into, _scan(block, part, text, into, old))

    return run


def remove_spans(marked: DataFrame, text: str = "text", mark: str = "leak") -> DataFrame:
    """The texts without their marked words and what separates words inside a span."""
    ship_package(marked.sparkSession)

    def cut(part: pa.RecordBatch) -> Iterator[str | None]:
        texts = part.column(text)
        words = _words(texts)
        data, at = arrays.flat(texts)
        for i, found in enumerate(part.column(mark).to_pylist()):
            if not found["spans"]:
                yield texts[i].as_py()
                continue
            keep = np.ones(at[i + 1] - at[i], bool)
            base = words.rows[i]
            for low, high in zip(found["spans"][::2], found["spans"][1::2], strict=True):
                keep[words.start[base + low] - at[i] : words.end[base + high - 1] - at[i]] = False
            yield data[at[i] : at[i + 1]][keep].tobytes().decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, text):
            yield with_column(part, text, pa.array(cut(part), pa.string()))

    return marked.mapInArrow(run, marked.schema)
