"""Linear recurrences and drift detection as chunked scans.

A log is cut into chunks of ``rows`` records.  Pass one turns every chunk that
is not the last of its log into a small *map* from start state to end state;
the maps are composed in two levels, so no task ever sees more than one chunk
or one block of maps; pass two runs every chunk from its true start state.
A task streams sorted rows and moves all chunks of a batch on together, so many short chunks
cost no call each.  Logs that fit one chunk need no maps.

Chunk functions are plain numpy over bounded arrays; partitioning, grouping and
shuffling are Spark's.  A numpy step moves one record of every block of every log at hand,
so no statement runs for a single record.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TYPES
from pyspark.sql.pandas.types import to_arrow_schema

from telemetra.frame import IDX, LOG, finite_or_zero
from telemetra.operators.layout import CHUNK_ROWS, log_sizes, python_tasks, whole_groups
from telemetra.operators.stats import baseline
from telemetra.session import settle

MAPS_PER_BLOCK = 1024
_NARROW = 512  # records of a block, unless all series are shorter or one is much longer


@dataclass(frozen=True)
class Scan:
    """What a chunked scan needs to know about one recurrence.

    ``run(chunks, states) -> (offsets, positions, outputs)`` moves all chunks at hand on together, from a
    column of ``states`` for each; that of a log's first chunk is not looked at.  ``summarise(chunks)``
    gives the map of each chunk as a flat array; ``compose(a, b)`` is "a, then b"; ``apply(map, state)``
    moves a state, None before the first chunk.  A state has ``order`` numbers.
    """

    run: Callable
    summarise: Callable
    compose: Callable
    apply: Callable
    order: int


@dataclass(frozen=True)
class Chunks:
    """Rows of complete chunks in order, and where each chunk lies in its log."""

    idx: np.ndarray
    values: np.ndarray
    at: np.ndarray  # the chunks' n + 1 offsets
    size: np.ndarray  # records in the log of each
    side: dict  # side columns of each chunk's first row

    @property
    def is_first(self) -> np.ndarray:
        return self.idx[self.at[:-1]] == 0

    @property
    def is_last(self) -> np.ndarray:
        return self.idx[self.at[1:] - 1] == self.size - 1


def _chunk_of(size: Column, rows: int) -> Column:
    """Chunk number; a short remainder belongs to the chunk before it."""
    count = F.greatest(F.floor(size / rows), F.lit(1).cast("long"))
    return F.least(F.floor(F.col(IDX) / rows), count - 1)


def chunk_scan(
    records: DataFrame,
    scan: Scan,
    value: str,
    out: str,
    side: Sequence[str] = (),
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    size: str = "n",
) -> DataFrame:
    """Run ``scan`` over ``value`` by ``idx``; returns keys, idx, n, ``out``.

    ``size`` is the column with the number of records of the log.
    """
    keys = list(keys)
    key_fields = [records.schema[k] for k in keys]
    vector, long = TYPES.ArrayType(TYPES.DoubleType()), TYPES.LongType()
    group = [*key_fields, TYPES.StructField("_chunk", long)]
    maps_schema = TYPES.StructType(
        [*group, TYPES.StructField("_map", vector), TYPES.StructField("_followed", TYPES.BooleanType())]
    )
    out_schema = TYPES.StructType(
        [
            *key_fields,
            TYPES.StructField(IDX, long),
            TYPES.StructField("n", long),
            TYPES.StructField(out, TYPES.DoubleType()),
        ]
    )
    maps_fields, out_fields = to_arrow_schema(maps_schema), to_arrow_schema(out_schema)
    tasks = python_tasks(records.sparkSession)
    chunked = records.select(
        *keys,
        F.col(IDX).cast("long").alias(IDX),
        F.col(value).cast("double").alias("_x"),
        *side,
        F.col(size).cast("long").alias("_size"),
        _chunk_of(F.col(size), rows).alias("_chunk"),
    )

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, *keys, "_chunk").sortWithinPartitions(*keys, "_chunk", IDX)

    def chunks_from(table: pa.Table, at: np.ndarray) -> Chunks:
        first = at[:-1]
        return Chunks(
            table.column(IDX).to_numpy(),
            table.column("_x").to_numpy(),
            at,
            table.column("_size").to_numpy()[first],
            {c: table.column(c).to_numpy()[first] for c in side},
        )

    def to_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, [*keys, "_chunk"]):
            chunks = chunks_from(table, at)
            first = table.take(pa.array(at[:-1]))
            number = first.column("_chunk").to_numpy()
            count = np.maximum(chunks.size // rows, 1) - 1  # maps of the log
            found = {
                "_map": pa.array(scan.summarise(chunks), pa.list_(pa.float64())),
                "_followed": pa.array((number // MAPS_PER_BLOCK + 1) * MAPS_PER_BLOCK < count),
            }
            yield from _table(first, found, maps_fields).to_batches()

    # Pass one shuffles only rows of logs with several chunks.
    more = (F.col("_chunk") + 2) * rows <= F.col("_size")  # another chunk follows
    maps = settle(dealt(chunked.filter(more)).mapInArrow(to_maps, maps_schema))
    states = _start_states(maps, scan, keys, group).withColumn(IDX, F.lit(-1).cast("long"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, [*keys, "_chunk"]):
            body = table.column(IDX).to_numpy() >= 0
            given = np.flatnonzero(~body[at[:-1]])  # a chunk's start state stands before its rows
            states = np.zeros((scan.order, len(at) - 1))
            if len(given):
                held = table.column("_state").take(pa.array(at[given])).combine_chunks()
                states[:, given] = pc.list_flatten(held).to_numpy().reshape(len(given), -1).T
            kept = table.filter(pa.array(body)).combine_chunks()
            at = np.r_[0, np.cumsum(body)][at]
            some = np.flatnonzero(np.diff(at))  # a state without rows gives none
            states, at = states[:, some], np.r_[at[some], at[-1]]
            if not len(some):
                continue
            edge, idx, y = scan.run(chunks := chunks_from(kept, at), states)
            length = np.diff(edge)
            first = kept.take(pa.array(np.repeat(at[:-1], length)))
            found = {IDX: pa.array(idx), "n": pa.array(np.repeat(chunks.size, length)), out: pa.array(y)}
            yield from _table(first, found, out_fields).to_batches()

    every = chunked.withColumn("_state", F.lit(None).cast(vector)).unionByName(states, allowMissingColumns=True)
    return dealt(every).mapInArrow(emit, out_schema)


def scan_logs(
    records: DataFrame,
    value: str,
    out: str,
    whole: Callable[[np.ndarray, np.ndarray, dict], np.ndarray],
    keys: Sequence[str],
    rows: int,
    chunked: Callable[[DataFrame], DataFrame],
    side: Sequence[str] = (),
    sizes: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """keys, idx, ``keep`` and ``out``: logs of one chunk by ``whole``, the others by ``chunked``.

    ``whole(x, at, side)`` gets the values of complete logs, their n + 1 offsets and the side
    columns of each; a task holds the logs of one batch.  ``records`` have their log's size n;
    ``sizes`` is a smaller table that has it too.
    """
    keys = list(keys)
    longer = F.col("n") >= 2 * rows  # a short remainder belongs to the chunk before it
    if (records if sizes is None else sizes).filter(longer).isEmpty():
        return _scan_short(records, value, out, whole, keys, side, keep)
    short = _scan_short(records.filter(~longer), value, out, whole, keys, side, keep)
    long = records.filter(longer)
    found = chunked(long)
    if keep:
        found = found.join(long.select(*keys, IDX, *keep), [*keys, IDX])
    return short.unionByName(found.select(*short.columns))


def _scan_short(
    records: DataFrame,
    value: str,
    out: str,
    whole: Callable,
    keys: list[str],
    side: Sequence[str],
    keep: Sequence[str],
) -> DataFrame:
    schema = TYPES.StructType(
        [
            *[records.schema[k] for k in keys],
            TYPES.StructField(IDX, TYPES.LongType()),
            *[records.schema[k] for k in keep],
            TYPES.StructField(out, TYPES.DoubleType()),
        ]
    )
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, keys):
            known = {c: table.column(c).to_numpy()[at[:-1]] for c in side}
            y = whole(table.column("_x").to_numpy().astype(float), at, known)
            columns = [table.column(c).cast(f.type) for c, f in zip((*keys, IDX, *keep), fields)]
            yield from pa.Table.from_arrays([*columns, pa.array(y)], schema=fields).to_batches()

    chosen = records.select(
        *keys, F.col(IDX).cast("long").alias(IDX), F.col(value).cast("double").alias("_x"), *side,
        *keep,
    )
    tasks = python_tasks(records.sparkSession)
    dealt = chosen.repartition(tasks, *keys).sortWithinPartitions(*keys, IDX)
    return dealt.mapInArrow(run, schema)


def _table(rows: pa.Table, columns: dict, fields: pa.Schema) -> pa.Table:
    """A table of ``fields``: the new columns, and the others as ``rows`` have them."""
    taken = [columns[f.name] if f.name in columns else rows.column(f.name) for f in fields]
    return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(taken, fields)], schema=fields)


def _start_states(maps: DataFrame, scan: Scan, keys: list[str], group: list) -> DataFrame:
    """Start state of every chunk after the first: keys, _chunk, _state.

    Blocks of maps are composed where another block follows, a log's blocks walked for the
    state each begins with, and every block's maps walked from there.
    """
    vector = TYPES.ArrayType(TYPES.DoubleType())
    *key_fields, _ = group
    block_schema = TYPES.StructType(
        [*key_fields, TYPES.StructField("_block", TYPES.LongType()), TYPES.StructField("_map", vector)]
    )
    state_schema = TYPES.StructType([*group, TYPES.StructField("_state", vector)])
    block_fields, state_fields = to_arrow_schema(block_schema), to_arrow_schema(state_schema)
    tasks = python_tasks(maps.sparkSession)

    def vectors(column: pa.ChunkedArray) -> list[np.ndarray]:
        lists = column.combine_chunks()
        flat = pc.list_flatten(lists).to_numpy()
        return np.split(flat, np.cumsum(pc.list_value_length(lists).to_numpy())[:-1])

    def in_order(df: DataFrame, by: list[str], number: str) -> DataFrame:
        return df.repartition(tasks, *by).sortWithinPartitions(*by, number)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, [*keys, "_block"]):
            m, totals = vectors(table.column("_map")), []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
                total = m[low]
                for k in range(low + 1, high):
                    total = scan.compose(total, m[k])
                totals.append(total)
            first = table.take(pa.array(at[:-1]))
            yield from _table(first, {"_map": pa.array(totals, pa.list_(pa.float64()))}, block_fields).to_batches()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, keys):
            m, found = vectors(table.column("_map")), []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
                state = None
                for k in range(low, high):
                    state = scan.apply(m[k], state)
                    found.append(state)
            new = {"_map": pa.array(found, pa.list_(pa.float64())), "_block": pc.add(table.column("_block"), 1)}
            yield from _table(table, new, block_fields).to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, [*keys, "_block"]):
            m, number = vectors(table.column("_map")), table.column("_chunk").to_numpy()
            found = []
            for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
                state = None
                for k in range(low, high):  # the state a block begins with stands first
                    state = m[k] if number[k] < 0 else scan.apply(m[k], state)
                    found.append(state)
            real = pa.array(number >= 0)
            new = {"_state": pa.array(found, pa.list_(pa.float64())).filter(real), "_chunk": pa.array(number + 1).filter(real)}
            yield from _table(table.filter(real), new, state_fields).to_batches()

    by_block = [*keys, "_block"]
    maps = maps.withColumn("_block", F.floor(F.col("_chunk") / MAPS_PER_BLOCK))
    blocks = in_order(maps.filter("_followed"), by_block, "_chunk").mapInArrow(fold, block_schema)
    entry = in_order(blocks, keys, "_block").mapInArrow(entries, block_schema)
    begun = maps.drop("_followed").unionByName(entry.withColumn("_chunk", F.lit(-1).cast("long")))
    return in_order(begun, by_block, "_chunk").mapInArrow(walk, state_schema)


# ---------------------------------------------------------------- affine maps


def _affine(moved: Callable, matrix: np.ndarray) -> Scan:
    """A scan whose state moves as s -> A s + b; a map is [A row by row, b].

    ``moved(chunks, states) -> (offsets, positions, outputs, end states)``.
    """
    order = len(matrix)

    def split(m):
        return m[: order * order].reshape(order, order), m[order * order :]

    def run(chunks, states):
        return moved(chunks, states)[:3]

    def summarise(chunks):
        ends = moved(chunks, np.zeros((order, len(chunks.size))))[3]
        length = np.diff(chunks.at)
        powers = {n: np.linalg.matrix_power(matrix, n).ravel() for n in set(length.tolist())}
        none = np.zeros(order * order)  # the first chunk starts on its own
        return [
            np.concatenate([none if first else powers[n], end])
            for n, first, end in zip(length.tolist(), chunks.is_first.tolist(), ends.T)
        ]

    def compose(a, b):
        (a1, b1), (a2, b2) = split(a), split(b)
        return np.concatenate([(a2 @ a1).ravel(), a2 @ b1 + b2])

    def apply(m, state):
        a, b = split(m)
        return b if state is None else a @ state + b

    return Scan(run, summarise, compose, apply, order)


class Blocks:
    """Several series, one after the other in a flat array, cut into blocks of one width.

    The blocks stand side by side, so that a step of a recurrence is one row of all; blocks
    that end sooner stand last and drop out.
    """

    def __init__(self, at: np.ndarray):
        size = np.diff(at)
        longest = int(size.max(initial=0))
        self.width = width = max(min(longest, max(math.isqrt(longest), _NARROW)), 1)
        count = -(-size // width)
        series = np.repeat(np.arange(len(size)), count)
        number = np.arange(len(series)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(size[series] - number * width, width)
        order = np.argsort(-length, kind="stable")
        self.series, self.number, self.length = series[order], number[order], length[order]
        self.start = at[:-1][self.series] + self.number * width
        #: how many blocks have a j-th record
        self.active = np.searchsorted(-self.length, -np.arange(width), side="left")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: the block before and after each in its series, -1 for none
        self.before = np.where(self.number > 0, place[np.maximum(order - 1, 0)], -1)
        follows = np.r_[series[1:] == series[:-1], False] if len(series) else np.zeros(0, bool)
        self.after = np.where(follows[order], place[np.minimum(order + 1, max(len(order) - 1, 0))], -1)
        self._cell = np.minimum(self.start + np.arange(width)[:, None], max(int(at[-1]) - 1, 0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Row j has the j-th record of each block; only the first active[j] count."""
        return x[self._cell]

    def flat(self, rows: np.ndarray, total: int) -> np.ndarray:
        out = np.empty(total)
        for j, k in enumerate(self.active):
            out[self._cell[j, :k]] = rows[j, :k]
        return out


def lockstep(step: Callable, matrix: np.ndarray, x: np.ndarray, at: np.ndarray, start: np.ndarray) -> tuple:
    """Outputs and end states of an affine recurrence over many series at once.

    ``at`` are the series' n + 1 offsets in ``x``, ``start`` a column for each.  ``step(x, s)
    -> (y, s)`` moves one record of all blocks.  Series of several blocks take two passes:
    one from zero states gives the blocks' maps, whose composition gives each its start.
    """
    blocks = Blocks(at)
    rows = blocks.rows(np.asarray(x, float))
    state = np.zeros((len(start), len(blocks.series)))
    first = np.flatnonzero(blocks.number == 0)
    state[:, first] = start[:, blocks.series[first]]
    inner = int(np.searchsorted(-blocks.length, -blocks.width, side="right"))  # full blocks
    if (blocks.number > 0).any():
        moved = np.zeros((len(start), inner))
        for j in range(blocks.width):
            moved = step(rows[j, :inner], moved)[1]
        power = np.linalg.matrix_power(matrix, blocks.width)
        here = first[blocks.after[first] >= 0]
        while len(here):
            there = blocks.after[here]
            state[:, there] = power @ state[:, here] + moved[:, here]
            here = there[blocks.after[there] >= 0]
    y = np.empty_like(rows)
    for j, k in enumerate(blocks.active):
        y[j, :k], state[:, :k] = step(rows[j, :k], state[:, :k])
    ends = np.zeros((len(start), len(at) - 1))
    last = np.flatnonzero(blocks.after < 0)
    ends[:, blocks.series[last]] = state[:, last]
    empty = np.diff(at) == 0
    ends[:, empty] = start[:, empty]
    return blocks.flat(y, len(x)), ends


def _ema_step(alpha: float) -> Callable:
    def step(x, s):
        level = alpha * x + (1.0 - alpha) * s[0]
        return level, level[None, :]

    return step


def _ema_scan(alpha: float) -> Scan:
    matrix = np.array([[1.0 - alpha]])

    def moved(chunks, states):
        start = np.where(chunks.is_first, chunks.values[chunks.at[:-1]], states)
        y, ends = lockstep(_ema_step(alpha), matrix, chunks.values, chunks.at, start)
        return chunks.at, chunks.idx, y, ends

    return _affine(moved, matrix)


def _sized(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    if "n" in records.columns:
        return records
    return records.join(settle(log_sizes(records, keys)), list(keys))


def exponential_moving_average(
    records: DataFrame,
    value: str,
    alpha: float = 0.2,
    out: str = "ema",
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """keys, idx, ``keep`` and the exponentially weighted mean, started at the first value."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be above 0 and at most 1")

    def whole(x: np.ndarray, at: np.ndarray, side: dict) -> np.ndarray:
        return lockstep(_ema_step(alpha), np.array([[1.0 - alpha]]), x, at, x[at[:-1]][None, :])[0]

    return scan_logs(
        _sized(records, keys), value, out, whole, keys, rows,
        lambda long: chunk_scan(long, _ema_scan(alpha), value, out, keys=keys, rows=rows).drop("n"),
        keep=keep,
    )


# ---------------------------------------------------------------- Butterworth


def butterworth_sections(
    cutoff: float, order: int, high: bool = False, textbook: bool = False
) -> list[tuple[float, float, float, float, float]]:
    """Second-order sections (b0, b1, b2, a1, a2) by the bilinear transform.

    The pole angle of the k-th pair is pi (2k + 1 + odd) / (2 order).  For odd
    orders the established results take its sine as damping; ``textbook`` uses
    the Butterworth prototype (its cosine there) instead.
    """
    wc = math.tan(math.pi * cutoff)
    sections = []
    odd = order % 2
    if odd:
        gain = (1.0 if high else wc) / (1.0 + wc)
        sections.append((gain, -gain if high else gain, 0.0, (wc - 1.0) / (wc + 1.0), 0.0))
    for k in range(order // 2):
        angle = math.pi * (2 * k + 1 + odd) / (2 * order)
        if textbook and odd:
            angle = math.pi / 2 - math.pi * (k + 1) / order
        spread = 2.0 * math.sin(angle) * wc
        square = wc * wc
        scale = 1.0 + spread + square
        b = (1.0 if high else square) / scale
        sections.append(
            (b, (-2.0 if high else 2.0) * b, b, 2.0 * (square - 1.0) / scale,
             (1.0 - spread + square) / scale)
        )
    return sections


def _cascade(sections: list[tuple]) -> tuple[Callable, np.ndarray, np.ndarray]:
    """All sections of a filter as one linear system with two states each.

    The stepping function, the state matrix, and the state that is at
    rest for an input of one.
    """
    rest = np.array([x for _, b1, b2, a1, a2 in sections for x in (b1 - a1 + b2 - a2, b2 - a2)])

    def step(x, s):
        moved = np.empty_like(s)
        for j, (b0, b1, b2, a1, a2) in enumerate(sections):
            v = b0 * x + s[2 * j]
            moved[2 * j] = b1 * x - a1 * v + s[2 * j + 1]
            moved[2 * j + 1] = b2 * x - a2 * v
            x = v
        return x, moved

    order = 2 * len(sections)
    matrix = step(np.zeros(order), np.eye(order))[1]  # where each unit state goes
    return step, matrix, rest


def _reflected(x: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple:
    """Series led in and followed by so many records of the odd reflection of their ends.

    The values, the extended series' offsets, and for each place its series and where it is in it.
    """
    size = np.diff(at)
    edge = np.r_[0, np.cumsum(size + before + after)]
    log = np.repeat(np.arange(len(size)), np.diff(edge))
    place = np.arange(edge[-1]) - edge[log] - before[log]
    first, last = at[log], at[log + 1] - 1
    mirrored = np.where(place < 0, -place, np.where(place < size[log], place, 2 * (size[log] - 1) - place))
    value = x[first + mirrored]
    value = np.where(place < 0, 2.0 * x[first] - value, np.where(place < size[log], value, 2.0 * x[last] - value))
    return value, edge, log, place


def _filter_scan(sections: list[tuple], reflect: bool) -> Scan:
    """One direction of a zero-phase filter.

    With ``reflect`` the first chunk is led in, and the last chunk followed, by
    the odd reflection of its end; the lead-in only settles the state, the
    followers become records past the end of the log.
    """
    step, matrix, rest = _cascade(sections)

    def moved(chunks, states):
        first, size = chunks.is_first, np.diff(chunks.at)
        pad = np.minimum(6 * len(sections), chunks.size - 1) if reflect else np.zeros_like(size)
        value, edge, log, place = _reflected(
            chunks.values, chunks.at, np.where(first, pad, 0), np.where(chunks.is_last, pad, 0)
        )
        start = np.where(first, rest[:, None] * value[edge[:-1]], states)
        y, ends = lockstep(step, matrix, value, edge, start)
        kept = place >= 0
        log, place = log[kept], place[kept]
        inside = np.minimum(place, size[log] - 1)
        idx = chunks.idx[chunks.at[log] + inside] + (place - inside)
        return np.r_[0, np.cumsum(np.bincount(log, minlength=len(size)))], idx, y[kept], ends

    return _affine(moved, matrix)


def butterworth_filtfilt(
    records: DataFrame,
    value: str,
    cutoff: float = 0.1,
    order: int = 2,
    high: bool = False,
    out: str = "filtered",
    textbook: bool = False,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Zero-phase Butterworth filter: keys, idx, ``keep`` and the filtered value.

    The series, extended at both ends by odd reflection, is scanned forward and
    then backward, each time from a settled start state.  Non-finite input
    counts as 0.
    """
    if not 1 <= order <= 8:
        raise ValueError("order must be 1 to 8")
    if not 0.0 < cutoff < 0.5:
        raise ValueError("cutoff must lie between 0 and 0.5")
    keys = list(keys)
    sections = butterworth_sections(min(max(cutoff, 0.001), 0.499), order, high, textbook)
    depth = 6 * len(sections)
    rows = max(rows, depth + 1)  # an end and its reflection lie in one chunk
    clean = _sized(records, keys).select(
        *keys, IDX, "n", finite_or_zero(F.col(value)).alias("_v"), *keep
    )
    return scan_logs(
        clean, "_v", out, _zero_phase(sections), keys, rows,
        lambda long: _filtfilt_chunks(long, sections, out, keys, rows),
        keep=keep,
    )


def _filtfilt_chunks(
    clean: DataFrame, sections: list[tuple], out: str, keys: list[str], rows: int
) -> DataFrame:
    depth = 6 * len(sections)
    forward = chunk_scan(clean, _filter_scan(sections, True), "_v", "_f", keys=keys, rows=rows)
    extended = F.col("n") + F.least(F.lit(depth).cast("long"), F.col("n") - 1)
    turned = forward.withColumn("_length", extended).withColumn(
        IDX, F.col("_length") - 1 - F.col(IDX)
    )
    backward = chunk_scan(
        turned.select(*keys, IDX, "_length", "_f"),
        _filter_scan(sections, False), "_f", out, keys=keys, rows=rows, size="_length",
    )
    # Position p of the reversed, extended series is record length - 1 - p; the
    # records past the end come first and are left out.
    length = F.col("n")
    records_in_log = F.when(length > 2 * depth, length - depth).otherwise(
        ((length + 1) / 2).cast("long")
    )
    position = length - 1 - F.col(IDX)
    return backward.filter(position < records_in_log).select(
        *keys, position.alias(IDX), out
    )


def _zero_phase(sections: list[tuple]) -> Callable:
    """Both directions over complete logs: led in and followed by reflections, then turned."""
    step, matrix, rest = _cascade(sections)

    def settled(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return lockstep(step, matrix, x, at, rest[:, None] * x[at[:-1]])[0]

    def whole(x: np.ndarray, at: np.ndarray, side: dict) -> np.ndarray:
        size = np.diff(at)
        pad = np.minimum(6 * len(sections), size - 1)
        value, edge, log, place = _reflected(x, at, pad, pad)
        forward = settled(value, edge)
        kept = place >= 0  # the lead-in only settles the state
        again = np.r_[0, np.cumsum(size + pad)]
        turn = again[log[kept]] + again[log[kept] + 1] - 1 - np.arange(again[-1])
        backward = settled(forward[kept][turn], again)[turn]
        return backward[(place < size[log])[kept]]

    return whole


# ---------------------------------------------------------------- drift


def _drift_pieces(steps: np.ndarray, h: float) -> list[list[tuple]]:
    """Maps of one clamped sum over blocks, one in each column, for starts in [0, h].

    A map is pieces (from, to, kind, number): kind 0 ends at ``number`` whatever the
    start, kind 1 ends at start + ``number``.  A path first meets the clamp where the running
    least of its sums takes its start to 0, or starts over where the running greatest takes
    it past ``h``; starts between two such edges share a path and are moved on by one
    of them, for all blocks at once.
    """
    sums = np.cumsum(steps, axis=0)
    count = steps.shape[1]
    edges = [np.zeros((0, 2))]
    for cut in (-np.minimum.accumulate(sums), h - np.maximum.accumulate(sums)):
        new = (cut > 0.0) & (cut < h)
        new[1:] &= cut[1:] != cut[:-1]
        at, block = np.nonzero(new)
        edges.append(np.stack([block, cut[at, block]], 1))
    ends = np.stack([np.repeat(np.arange(count), 2), np.tile([0.0, h], count)], 1)
    edge = np.unique(np.concatenate([*edges, ends]), axis=0)
    low, high = edge[:-1], edge[1:]
    inside = low[:, 0] == high[:, 0]
    block = low[inside, 0].astype(np.int64)
    low, high = low[inside, 1], high[inside, 1]
    # starts that meet neither end
    live = (low >= -sums.min(0)[block]) & (high <= h - sums.max(0)[block])
    state = (low + high) / 2.0
    for row in steps:
        state = np.fmax(state + row[block], 0.0)
        state = np.where(state > h, 0.0, state)
    number = np.where(live, sums[-1][block], state)
    out: list[list[tuple]] = [[] for _ in range(count)]
    for b, x, y, kind, v in zip(block.tolist(), low.tolist(), high.tolist(), live.tolist(), number.tolist()):
        pieces = out[b]
        if pieces and pieces[-1][2] == float(kind) and pieces[-1][3] == v:
            pieces[-1] = (pieces[-1][0], y, float(kind), v)
        else:
            pieces.append((x, y, float(kind), v))
    return out


def _drift_run(
    rise: np.ndarray, fall: np.ndarray, at: np.ndarray, start: np.ndarray, h: float
) -> tuple[np.ndarray, np.ndarray]:
    """Flags and end states of series of steps, exactly as record after record.

    Blocks are first run from zero sums; those whose block before ended elsewhere are run
    again from there until all starts are right.  Clamps and resets make blocks forget
    their start, so that is mostly once.
    """
    blocks = Blocks(at)
    up, down = blocks.rows(rise), blocks.rows(fall)
    flags = np.zeros_like(up)
    begin = np.zeros((2, len(blocks.series)))
    first = blocks.number == 0
    begin[:, first] = start[:, blocks.series[first]]
    end = np.zeros_like(begin)
    todo = np.arange(len(blocks.series))
    while len(todo):
        a, b = begin[0, todo], begin[1, todo]
        for j in range(int(blocks.length[todo].max(initial=0))):
            k = int(np.searchsorted(-blocks.length[todo], -j, side="left"))
            some = todo[:k]
            x = np.fmax(a[:k] + up[j, some], 0.0)
            y = np.fmax(b[:k] + down[j, some], 0.0)
            over, under = x > h, y > h
            flags[j, some] = np.where(over, 1.0, np.where(under, -1.0, 0.0))
            a[:k], b[:k] = np.where(over, 0.0, x), np.where(under, 0.0, y)
        end[0, todo], end[1, todo] = a, b
        due = np.flatnonzero(blocks.before >= 0)
        wrong = (begin[:, due] != end[:, blocks.before[due]]).any(0)
        todo = due[wrong]
        begin[:, todo] = end[:, blocks.before[todo]]
    ends = np.array(start, float)
    last = np.flatnonzero(blocks.after < 0)
    ends[:, blocks.series[last]] = end[:, last]
    return blocks.flat(flags, len(rise)), ends


def _drift_scan(k: float, h: float) -> Scan:
    """CUSUM: two sums clamped at 0 that start over once they pass ``h``; what is no number clears both.

    A map lists, for each of the two sums, the pieces of its start-to-end
    function: [count, pieces of the upper sum..., pieces of the lower sum...].
    """

    def steps(chunks):
        mean = np.repeat(chunks.side["baseline_mean"].astype(float), np.diff(chunks.at))
        return (chunks.values - mean) - k, (mean - chunks.values) - k

    def run(chunks, states):
        rise, fall = steps(chunks)
        return chunks.at, chunks.idx, _drift_run(rise, fall, chunks.at, states, h)[0]

    def pack(up, down):
        return np.array([float(len(up)), *(x for p in up + down for x in p)])

    def unpack(m):
        body = m[1:].reshape(-1, 4)
        n = int(m[0])
        return [tuple(p) for p in body[:n]], [tuple(p) for p in body[n:]]

    def summarise(chunks):
        length = np.diff(chunks.at)
        found = [[None, None] for _ in length]
        for n in set(length.tolist()):
            same = np.flatnonzero(length == n)
            cell = chunks.at[same] + np.arange(n)[:, None]  # a column for each chunk
            width = min(n, max(math.isqrt(n), _NARROW))
            for side, x in enumerate(steps(chunks)):
                parts = [_drift_pieces(x[cell[low : low + width]], h) for low in range(0, n, width)]
                for c, total, *rest in zip(same.tolist(), *parts):
                    for part in rest:
                        total = join(total, part)
                    found[c][side] = total
        for c in np.flatnonzero(chunks.is_first).tolist():
            found[c] = [[(0.0, 0.0, 0.0, end_of(m, 0.0))] for m in found[c]]
        return [pack(*maps) for maps in found]

    def end_of(pieces, s):
        # A state on a shared piece edge belongs to the lower piece, except that
        # a sum of exactly the limit has not been reset.
        for a, b, kind, v in pieces:
            if a <= s <= b:
                return v + s if kind else v
        a, b, kind, v = min(pieces, key=lambda p: min(abs(p[0] - s), abs(p[1] - s)))
        return v + s if kind else v

    def apply(m, state):
        up, down = unpack(m)
        s = (0.0, 0.0) if state is None else state
        return np.array([end_of(up, float(s[0])), end_of(down, float(s[1]))])

    def join(a, b):
        out = []
        for lo, hi, kind, v in a:
            if not kind:
                out.append((lo, hi, 0.0, end_of(b, v)))
                continue
            for blo, bhi, bkind, bv in b:
                left, right = max(lo, blo - v), min(hi, bhi - v)
                if left <= right:
                    out.append((left, right, bkind, bv + v if bkind else bv))
        merged = []
        for piece in sorted(out):
            if merged and merged[-1][2:] == piece[2:]:
                merged[-1] = (merged[-1][0], max(piece[1], merged[-1][1]), *piece[2:])
            else:
                merged.append(piece)
        return merged

    def compose(a, b):
        (au, ad), (bu, bd) = unpack(a), unpack(b)
        return pack(join(au, bu), join(ad, bd))

    return Scan(run, summarise, compose, apply, 2)


def drift_flags(
    records: DataFrame,
    value: str,
    k: float = 2.5,
    h: float = 20.0,
    baseline_percent: float = 10.0,
    out: str = "drift",
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """keys, idx, ``keep`` and +1 / -1 / 0: drift above or below the early mean of the log."""
    sized = _sized(records, keys)
    base = settle(baseline(sized, value, baseline_percent, keys).select(*keys, "baseline_mean"))

    def whole(x: np.ndarray, at: np.ndarray, side: dict) -> np.ndarray:
        mean = np.repeat(side["baseline_mean"], np.diff(at))
        return _drift_run((x - mean) - k, (mean - x) - k, at, np.zeros((2, len(at) - 1)), h)[0]

    side = ["baseline_mean"]
    return scan_logs(
        sized.join(base, list(keys)), value, out, whole, keys, rows,
        lambda long: chunk_scan(
            long, _drift_scan(k, h), value, out, side=side, keys=keys, rows=rows
        ).drop("n"),
        side, records if "n" in records.columns else sized, keep,
    )
