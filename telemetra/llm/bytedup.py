"""Byte-level deduplication with suffix arrays.

A window is ``size`` bytes of one document; a byte is removed if a window that
covers it also occurs in a document of smaller id.

1. Route.  Each window has one anchor, the least of its byte grams (winnowing), so
   equal windows share it.  Each run of windows with one anchor spans a short
   string.  Runs meet by anchor; equal strings (64-bit hashes of anchor and span)
   are one, for which its smallest document stands: the runs of larger documents
   are repeats from end to end.  Anchors left with strings of one document only
   cannot repeat further and stay behind.
2. Shard.  The other strings, the bytes of one run each, go to the shards of their
   anchor.  A shard holds about ``SHARD_BYTES`` in memory.
3. Per shard.  A suffix array by Larsson-Sadakane refinement and Kasai's common
   prefixes: neighbours that share ``size`` bytes are one window.  Each knows its
   smallest document.
4. Across shards.  An anchor with more strings than a shard takes goes on into the
   next; the sorted windows of its earlier shards are searched by bisection.
5. Hot anchors.  Anchors of many different strings, found in a sample, are no anchors:
   their windows are runs of one window each, dealt by the hash of the whole window.
   Any set of hot anchors gives the same result; the sample bounds only the shards.

Equal strings of a task are one before the shuffle, so a hot passage costs a row
for each task.  Nothing is paired.  Anchors travel packed, as columns of a block.

Order, nulls, repeated ids and rows, empty tables and columns are as in
``substrings``: place by doc_id (null first), for different texts with one id by a
hash of the text; equal rows count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm import arrays, suffixes
from telemetra.llm.common import KEYED, keyed, schema_with, shield, span_arrays, span_table, with_column
from telemetra.session import ship_package

GRAM = 16
#: Strings of a shard, in bytes.
SHARD_BYTES = 1 << 20
#: Anchors after which a task drops equal strings and hands on the rest.
HELD = 1 << 18
#: Strings of an anchor above which its windows are dealt one by one; about half a shard.
HOT_STRINGS = 1 << 13
#: One of so many pieces of ``PIECE`` bytes is sampled to find them.
SAMPLE = 64
PIECE = 1 << 12

RESULT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField("text", T.StringType()),
    ]
)
#: A 64-bit unit for each byte value.
_UNITS = arrays.mix(np.arange(1, 257, dtype=np.uint64))



def _batch(schema: pa.Schema, *columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c).cast(f.type) for c, f in zip(columns, schema)],
        schema=schema,
    )


#: Columns of a block of runs; ``m`` counts windows and is under 128.
_RUN = (
    ("hash", "<u4"), ("span", "<u8"), ("doc", "<i8"), ("tie", "<i8"), ("pos", "<u4"), ("m", "u1"),
)
_BLOCK = "deal int, sure boolean, n int, block binary"
_BLOCK_ARROW = pa.schema(
    [("deal", pa.int32()), ("sure", pa.bool_()), ("n", pa.int32()), ("block", pa.binary())]
)


def _packed(columns: dict[str, np.ndarray], kinds: tuple[tuple[str, str], ...]) -> bytes:
    """Columns one after the other, each as planes of equal bytes, which compress well."""
    planes = []
    for name, kind in kinds:
        value = np.ascontiguousarray(columns[name].astype(kind))
        planes.append(value.view(np.uint8).reshape(len(value), -1).T.tobytes())
    return b"".join(planes)


def _unpacked(
    block: bytes, n: int, kinds: tuple[tuple[str, str], ...]
) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(block, np.uint8, n * width, at).reshape(width, n)
        out[name] = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
        at += n * width
    return out


def _firsts(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Runs in order of (hash, span, place), and which are in a larger document than an equal one."""
    order = np.lexsort((c["pos"], c["tie"], c["doc"], c["span"], c["hash"]))
    c = {k: v[order] for k, v in c.items()}
    new = np.r_[True, (c["hash"][1:] != c["hash"][:-1]) | (c["span"][1:] != c["span"][:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return c, (c["doc"] != c["doc"][head]) | (c["tie"] != c["tie"][head])


class _Anchors:
    """Runs of a task."""

    def __init__(self) -> None:
        self.parts: list[dict[str, np.ndarray]] = []
        self.size = 0

    def add(self, **columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns["pos"])

    def flush(self, deals: int) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        rows = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
        self.__init__()
        rows["hash"] = rows["gram"]  # whole here, 32 bits beside the partition from here on
        rows, sure = _firsts(rows)
        mixed = arrays.mix(rows["gram"])
        deal = (mixed % np.uint64(deals)).astype(np.int64)
        by_doc = arrays.mix(rows["doc"].astype(np.uint64)) % np.uint64(deals)
        deal = np.where(sure, by_doc.astype(np.int64), deal)
        rows["hash"] = mixed >> np.uint64(32)
        order = np.lexsort((rows["pos"], rows["tie"], rows["doc"], deal, sure))
        key = (sure * deals + deal)[order]
        edges = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            part = order[low:high]
            block = _packed({name: rows[name][part] for name, _ in _RUN}, _RUN)
            yield _batch(
                _BLOCK_ARROW, deal[part[:1]], sure[part[:1]], np.array([high - low]),
                pa.array([block], pa.binary()),
            )


def _routes(gram: np.ndarray, deals: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition and short hash of anchors."""
    mixed = arrays.mix(gram)
    return (mixed % np.uint64(deals)).astype(np.int32), (mixed >> np.uint64(32)).astype(np.uint32)


_SAMPLED = "gram long, span long, _text long, n long"
_SAMPLED_ARROW = pa.schema([(c, pa.int64()) for c in ("gram", "span", "_text", "n")])


def _sampled(size: int, share: int):  # noqa: ANN202
    """How often each anchor and string stand in the sampled pieces of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text"):
            data, at = arrays.flat(part.column("text"))
            text = part.column("_text").to_numpy(zero_copy_only=False).view(np.uint64)
            pieces = -(-np.diff(at) // PIECE)
            row = np.repeat(np.arange(len(pieces)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            picked = arrays.mix(text[row] + arrays.mix(nth.astype(np.uint64))) % np.uint64(share) == 0
            row, nth = row[picked], nth[picked]
            if not len(row):
                continue
            low = at[row] + nth * PIECE
            # a piece holds the windows that begin in it
            length = np.minimum(low + PIECE + size - 1, at[row + 1]) - low
            end = np.r_[0, np.cumsum(length)]
            units = _UNITS[data[np.repeat(low - end[:-1], length) + np.arange(end[-1])]]
            first, count, gram = arrays.anchors(units, end, size, min(GRAM, size))
            if not len(first):
                continue
            span = arrays.span_hashes(units, first, first + count + size - 1)
            owner = text[row[np.searchsorted(end, first, side="right") - 1]]
            order = np.lexsort((owner, span, gram))
            keys = [arrays.signed(np.ascontiguousarray(k[order])) for k in (gram, span, owner)]
            new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            begin = np.flatnonzero(new)
            yield _batch(
                _SAMPLED_ARROW, *[k[begin] for k in keys], np.diff(np.r_[begin, len(order)])
            )

    return run


def hot_anchors(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted anchors of about ``HOT_STRINGS`` strings or more.

    Equal strings of different texts count once, those of one text each.
    """
    texts = docs.select("text", F.xxhash64("text").alias("_text"))
    found = texts.mapInArrow(_sampled(size, SAMPLE), _SAMPLED)
    in_text = found.groupBy("gram", "span", "_text").agg(F.sum("n").alias("n"))
    strings = in_text.groupBy("gram", "span").agg(F.max("n").alias("n"))
    hot = strings.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") * SAMPLE >= HOT_STRINGS)
    return np.sort(np.array([r["gram"] for r in hot.select("gram").collect()], np.int64).view(np.uint64))


def _anchors(size: int, deals: int, hot: np.ndarray):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Anchors()
        for part in arrays.slices(batches, "text"):
            data, at = arrays.flat(part.column("text"))
            units = _UNITS[data]
            first, count, gram = arrays.anchors(units, at, size, min(GRAM, size))
            single = np.isin(gram, hot)
            windows, many = first[single], count[single]
            first, count, gram = first[~single], count[~single], gram[~single]
            text = np.searchsorted(at, first, side="right") - 1
            span = arrays.span_hashes(units, first, first + count + size - 1)
            doc, tie = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_tie"))
            rows.add(
                gram=gram, span=span, doc=doc[text], tie=tie[text], pos=first - at[text], m=count
            )
            if rows.size > HELD:
                yield from rows.flush(deals)
            if not len(windows):
                continue
            # windows of hot anchors, each with a second hash of its own as anchor
            others = arrays.mix(units + np.uint64(1))
            begins = np.cumsum(many) - many
            first = np.repeat(windows - begins, many) + np.arange(many.sum())
            for low in range(0, len(first), HELD):
                here = first[low : low + HELD]
                text = np.searchsorted(at, here, side="right") - 1
                rows.add(
                    gram=arrays.span_hashes(others, here, here + size),
                    span=arrays.span_hashes(units, here, here + size),
                    doc=doc[text], tie=tie[text], pos=here - at[text],
                    m=np.ones(len(here), np.int64),
                )
                if rows.size > HELD:
                    yield from rows.flush(deals)
        yield from rows.flush(deals)

    return run


_TURN = "deal int, n int, block binary"
_TURN_ARROW = pa.schema([("deal", pa.int32()), ("n", pa.int32()), ("block", pa.binary())])
_CODED = (("doc", "<i8"), ("tie", "<i8"), ("pos", "<u4"), ("code", "u1"))
_LIST = "_doc long, _tie long, _pos binary, _code binary"
_LIST_ARROW = pa.schema(
    [("_doc", pa.int64()), ("_tie", pa.int64()), ("_pos", pa.binary()), ("_code", pa.binary())]
)


def _to_documents(
    c: dict[str, np.ndarray], sure: np.ndarray, deals: int
) -> Iterator[pa.RecordBatch]:
    """Runs dealt by document: place, and m * 2 + 1 for a repeat or m * 2 for a string to compare."""
    if not len(sure):
        return
    c = c | {"code": c["m"].astype(np.uint8) * 2 + sure}
    deal = (arrays.mix(c["doc"].astype(np.uint64)) % np.uint64(deals)).astype(np.int64)
    order = np.lexsort((c["pos"], c["tie"], c["doc"], deal))
    deal = deal[order]
    edges = np.r_[np.flatnonzero(np.r_[True, deal[1:] != deal[:-1]]), len(deal)]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        block = _packed({k: c[k][order[low:high]] for k, _ in _CODED}, _CODED)
        yield _batch(
            _TURN_ARROW, deal[low : low + 1], np.array([high - low]), pa.array([block], pa.binary())
        )


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of the partition, its places and codes packed."""
    held = [_unpacked(r["block"], r["n"], _CODED) for b in batches for r in b.to_pylist()]
    if not held:
        return
    c = {k: np.concatenate([h[k] for h in held]) for k, _ in _CODED}
    held.clear()
    order = np.lexsort((c["pos"], c["tie"], c["doc"]))
    doc, tie, pos, code = (c[k][order] for k, _ in _CODED)
    at = np.r_[np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(tie) != 0)]), len(doc)]
    raw = np.ascontiguousarray(pos).view(np.uint8)
    yield _batch(
        _LIST_ARROW, doc[at[:-1]], tie[at[:-1]], arrays.binary_array(raw, at * 4),
        arrays.binary_array(code, at),
    )


def _meet(batches: Iterator[pa.RecordBatch], deals: int) -> Iterator[pa.RecordBatch]:
    """The runs of a partition's anchors: repeats, and strings to compare."""
    held = []
    for batch in batches:
        for row in batch.to_pylist():
            columns = _unpacked(row["block"], row["n"], _RUN)
            if row["sure"]:
                yield from _to_documents(columns, np.ones(row["n"], bool), deals)
            else:
                held.append(columns)
    if not held:
        return
    c, sure = _firsts({k: np.concatenate([h[k] for h in held]) for k, _ in _RUN})
    held.clear()
    # strings of one anchor are compared if they stand for several documents
    left = {k: v[~sure] for k, v in c.items()}
    begin = np.flatnonzero(np.r_[True, np.diff(left["hash"].astype(np.int64)) != 0])
    size = np.diff(np.r_[begin, len(left["hash"])])
    other = (left["doc"] != np.repeat(left["doc"][begin], size)) | (
        left["tie"] != np.repeat(left["tie"][begin], size)
    )
    open_ = np.zeros(len(sure), bool)
    open_[~sure] = np.repeat(np.logical_or.reduceat(other, begin), size)
    out = sure | open_
    yield from _to_documents({k: v[out] for k, v in c.items()}, sure[out], deals)


def _met(deals: int):  # noqa: ANN202
    return lambda batches: _meet(batches, deals)


def _runs_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, code) of packed places and codes; a null has none."""
    pos, _ = arrays.flat(part.column("_pos"))
    code, at = arrays.flat(part.column("_code"))
    row = arrays.owners(at)
    return row, np.ascontiguousarray(pos).view("<u4").astype(np.int64), code.astype(np.int64)


_STRING = "deal int, hash long, _doc long, _tie long, pos int, m int, string binary"
_STRING_ARROW = pa.schema([
    ("deal", pa.int32()), ("hash", pa.int64()), ("_doc", pa.int64()), ("_tie", pa.int64()),
    ("pos", pa.int32()), ("m", pa.int32()), ("string", pa.binary()),
])


def _strings(size: int, deals: int):  # noqa: ANN202
    """The bytes of the runs to compare, to the partitions where their anchors met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text", 1 << 20):
            row, pos, code = _runs_of(part)
            open_ = code % 2 == 0
            row, pos, m = row[open_], pos[open_], code[open_] // 2
            if not len(row):
                continue
            data, at = arrays.flat(part.column("text"))
            first, _, gram = arrays.anchors(_UNITS[data], at, size, min(GRAM, size))
            low = at[row] + pos
            run_of = np.searchsorted(first, low, side="right") - 1
            deal, short = _routes(gram[run_of], deals)
            length = m + size - 1
            end = np.r_[0, np.cumsum(length)]
            source = np.repeat(low - end[:-1], length) + np.arange(end[-1])
            doc, tie = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_tie"))
            yield _batch(
                _STRING_ARROW, deal, short.astype(np.int64), doc[row], tie[row], pos, m,
                arrays.binary_array(data[source], end),
            )

    return run


class _Shard:
    """Strings of one or more anchors, in the order (deal, hash, document)."""

    def __init__(self, rows: pa.Table, size: int):
        self.size = size
        coded = rows.column("string").combine_chunks().dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc, self.tie, self.pos, self.m = (
            rows.column(c).to_numpy() for c in ("_doc", "_tie", "pos", "m")
        )
        self.data, self.at = arrays.flat(coded.dictionary)
        # documents as numbers in their order
        order = np.lexsort((self.tie, self.doc))
        new = (np.diff(self.doc[order]) != 0) | (np.diff(self.tie[order]) != 0)
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(np.r_[0, new])
        self.least = np.full(len(self.at) - 1, len(order))
        np.minimum.at(self.least, self.code, self.rank)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Group of equal windows of each position that has one (else -1); a place of each group."""
        order, rank = suffixes.suffix_array(self.data, self.at)
        shared = suffixes.common_prefixes(self.data, self.at, order, rank)
        group = np.cumsum(shared < self.size) - 1
        end = np.repeat(self.at[1:], np.diff(self.at))
        whole = np.arange(len(self.data)) + self.size <= end
        of = np.where(whole, group[rank], -1)
        return of, order

    def judge(self, carried: _Carried | None) -> tuple[Iterator[pa.RecordBatch], _Carried]:
        of, _ = self.windows()
        spot = np.flatnonzero(of >= 0)
        string = np.searchsorted(self.at, spot, side="right") - 1
        groups, group = np.unique(of[spot], return_inverse=True)
        least = np.full(len(groups), len(self.doc))
        np.minimum.at(least, group, self.least[string])
        sample = np.zeros(len(groups), np.int64)
        sample[group] = spot
        seen = np.zeros(len(groups), bool)
        text = np.zeros(0, f"V{self.size}")
        if len(groups):
            text = np.lib.stride_tricks.sliding_window_view(self.data, self.size)[sample]
            text = np.ascontiguousarray(text).view(f"S{self.size}")[:, 0]
        if carried is not None:
            seen = carried.has(text)
        # every window of every row: its group's smallest document against the row's
        row = np.repeat(np.arange(len(self.m)), self.m)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(self.m) - self.m, self.m)
        place = np.full(len(self.data), -1)
        place[spot] = group
        which = place[self.at[self.code[row]] + offset]
        gone = seen[which] | (self.rank[row] > least[which])
        row, offset = row[gone], offset[gone]
        begin, length = arrays.runs(offset, row)
        row, offset = row[begin], offset[begin]
        out = _batch(
            _SPAN_ARROW, self.doc[row], self.tie[row], self.pos[row] + offset, length
        )
        return iter([out]), _Carried(text)


class _Carried:
    """Sorted windows of an anchor's earlier shards, whose documents are no larger."""

    def __init__(self, windows: np.ndarray):
        self.windows = np.unique(windows)

    def has(self, windows: np.ndarray) -> np.ndarray:
        if not len(self.windows):
            return np.zeros(len(windows), bool)
        at = np.minimum(np.searchsorted(self.windows, windows), len(self.windows) - 1)
        return self.windows[at] == windows

    def merged(self, other: _Carried) -> _Carried:
        new = other.windows[~self.has(other.windows)]
        out = _Carried.__new__(_Carried)
        out.windows = np.insert(self.windows, np.searchsorted(self.windows, new), new)
        return out


_SPAN = "_doc long, _tie long, pos int, m int"
_SPAN_ARROW = pa.schema(
    [("_doc", pa.int64()), ("_tie", pa.int64()), ("pos", pa.int32()), ("m", pa.int32())]
)


def _judge(size: int):  # noqa: ANN202
    """Strings sorted by (deal, hash, document) to runs of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight, carried = 0, None
        for batch in _whole_documents(batches):
            if not batch.num_rows:
                continue
            key = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            if held and weight > SHARD_BYTES:
                last = _last_key(held)
                found, windows = _Shard(pa.Table.from_batches(held), size).judge(carried)
                yield from found
                single = _last_key(held[:1], first=True) == last
                keep = last == key
                carried = (carried.merged(windows) if carried and single else windows) if keep else None
                held, weight = [], 0
            held.append(batch)
            weight += batch.nbytes
        if held:
            found, _ = _Shard(pa.Table.from_batches(held), size).judge(carried)
            yield from found

    return run


def _last_key(batches: list[pa.RecordBatch], first: bool = False) -> tuple[int, int]:
    batch, i = (batches[0], 0) if first else (batches[-1], batches[-1].num_rows - 1)
    return batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches re-cut into pieces after which a new document or anchor begins."""
    left: pa.RecordBatch | None = None
    for batch in batches:
        if left is not None:
            batch = pa.concat_batches([left, batch])
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new)
        if not len(cut):
            left = batch
            continue
        step = max(1, len(cut) // max(1, batch.nbytes // (SHARD_BYTES // 4)))
        low = 0
        for high in [*cut[step - 1 : -1 : step].tolist(), int(cut[-1])]:
            if high > low:
                yield batch.slice(low, high - low)
                low = high
        left = batch.slice(low)
    if left is not None:
        yield left


def compared_strings(
    docs: DataFrame, size: int, hot: np.ndarray
) -> tuple[DataFrame, DataFrame]:
    """Runs of keyed documents, and the strings whose anchors must be compared."""
    deals = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("_doc", "_tie", "text")
    blocks = texts.mapInArrow(_anchors(size, deals, hot), _BLOCK).repartition(deals, "deal")
    # both uses read whole lists and whole rows, so each exchange is made once
    turns = blocks.mapInArrow(_met(deals), _TURN).repartition(deals, "deal")
    lists = turns.mapInArrow(_by_document, _LIST)
    return lists, docs.join(lists, ["_doc", "_tie"]).mapInArrow(_strings(size, deals), _STRING)


def repeats(docs: DataFrame, size: int, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Runs of repeated windows of keyed documents: (_doc, _tie, _pos, _code) whose odd codes
    are repeats, and (_doc, _tie, _spans)."""
    deals = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists, strings = compared_strings(docs, size, hot)
    sharded = strings.repartition(deals, "deal").sortWithinPartitions(
        "deal", "hash", "_doc", "_tie", "pos"
    )
    return lists, span_table(sharded.mapInArrow(_judge(size), _SPAN))


def remove_repeats(docs: DataFrame, size: int = 50, into: str = "repeats") -> DataFrame:
    """Adds a struct: n_bytes, n_removed, n_spans (removed runs), kept (bytes left), text (decoded)."""
    ship_package(docs.sparkSession)
    if size - min(GRAM, size) + 1 >= 128:
        raise ValueError(f"size must be under {128 + GRAM - 1}")
    docs, back = shield(docs.drop(into), *KEYED)
    rows = keyed(docs)
    lists, compared = repeats(rows, size, hot_anchors(docs, size))
    key = ["_doc", "_tie"]
    joined = rows.join(lists, key, "left").join(compared, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text"):
            data, at = arrays.flat(part.column("text"))
            row, pos, code = _runs_of(part)
            sure = code % 2 == 1
            row2, pos2, m2 = span_arrays(part.column("_spans"))
            row, pos = np.r_[row[sure], row2], np.r_[pos[sure], pos2]
            gone = arrays.covered(at[row] + pos, np.r_[code[sure] // 2, m2] + size - 1, len(data))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            opens = at[:-1][at[1:] > at[:-1]]
            begins[opens] = gone[opens]
            removed, spans = (
                np.diff(np.r_[0, np.cumsum(x)][at]) for x in (gone, begins)
            )
            kept_at = np.r_[0, np.cumsum(np.diff(at) - removed)]
            kept = arrays.binary_array(data[~gone], kept_at)
            decoded = [b.as_py().decode("utf-8", "replace") for b in kept]
            column = pa.StructArray.from_arrays(
                [pa.array(np.diff(at)), pa.array(removed), pa.array(spans), kept, pa.array(decoded, pa.string())],
                RESULT.names,
            )
            yield with_column(part, into, column)

    found = joined.mapInArrow(run, schema_with(joined, into, RESULT))
    return found.drop("_doc", "_tie", "_pos", "_code", "_spans").withColumnsRenamed(back)
