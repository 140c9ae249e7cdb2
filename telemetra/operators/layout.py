"""Work layout: how one long log is spread over many tasks.

Every ordered operator in this package works on *chunks* of a log, never on a
whole log, so a log that holds a third of all rows is still many tasks:

* ``order_buckets`` cuts each log into order-preserving buckets of a bounded
  number of rows, using two or three rounds of min/max/count aggregates;
* ``with_record_index`` turns those into the dense record number ``idx``;
* ``halo_windows`` runs row frames on chunks that carry copies of the few
  neighbour rows their frames reach into;
* ``hold_last`` / ``running_sum`` carry one summary row per chunk instead.

The per-log and per-chunk tables are computed first (``settle``) and joined
without a broadcast hint: Spark knows their size, broadcasts them while it is
below its threshold and otherwise runs a shuffled join that adaptive execution
splits on skew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as TYPES
from pyspark.sql.pandas.types import to_arrow_schema

from telemetra.frame import IDX, LOG
from telemetra.session import settle, ship_package

CHUNK_ROWS = 1 << 18
_LEVEL_BITS = 20  # bits of a bucket number per round after the first


def python_tasks(spark: SparkSession) -> int:
    """Partitions for Python stages, with this package sent to the workers.

    Their cost is CPU, not bytes, so they keep the session's full shuffle width
    instead of being merged by size.
    """
    ship_package(spark)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@dataclass(frozen=True)
class Buckets:
    """Order-preserving bucket edges of a frame, reusable for other frames.

    One table per round: keys, the slots of earlier rounds, and how the rows of
    that slot are cut (_lo, _hi, _parts, _by_tie).
    """

    rounds: tuple[DataFrame, ...]
    keys: tuple[str, ...]

    def assign(
        self, df: DataFrame, by: Column, name: str = "bucket", tie: Column | None = None
    ) -> DataFrame:
        """Add the bucket of ``by``; values outside the edges go to the end buckets.

        Rows of keys the edges do not know get bucket 0.
        """
        out = df.withColumns(
            {"_by": by.cast("double"), "_tie": (by if tie is None else tie).cast("double")}
        )
        slots: list[str] = []
        for level, edges in enumerate(self.rounds):
            out = out.join(edges, [*self.keys, *slots], "left")
            out = out.withColumn(f"_s{level}", _slot()).drop(*_EDGE)
            slots.append(f"_s{level}")
        return out.withColumn(name, _bucket(slots)).drop("_by", "_tie", *slots)

    def every(self, name: str = "bucket") -> DataFrame:
        """All buckets of each key, also those no row fell into: about n / rows."""
        zero = F.lit(0).cast("long")
        slots: list[str] = []
        out = None
        for level, edges in enumerate(self.rounds):
            on = [*self.keys, *slots]
            counts = edges.select(*on, "_parts")
            out = counts if out is None else out.join(counts, on, "left")
            last = F.coalesce(F.col("_parts"), F.lit(1).cast("long")) - 1
            out = out.withColumn(f"_s{level}", F.explode(F.sequence(zero, last))).drop("_parts")
            slots.append(f"_s{level}")
        return out.select(*self.keys, _bucket(slots).alias(name))


_EDGE = ("_lo", "_hi", "_parts", "_by_tie")


def _slot() -> Column:
    lo, hi, parts = F.col("_lo"), F.col("_hi"), F.col("_parts")
    at = F.when(F.col("_by_tie"), F.col("_tie")).otherwise(F.col("_by"))
    share = F.try_divide(F.least(F.greatest(at, lo), hi) - lo, hi - lo)
    cut = F.least(F.floor(share * parts).cast("long"), parts - 1)
    return F.when((parts > 1) & (hi > lo), cut).otherwise(F.lit(0).cast("long"))


def _bucket(slots: Sequence[str]) -> Column:
    number = F.col(slots[0])
    for s in slots[1:]:
        number = number * F.lit(1 << _LEVEL_BITS) + F.col(s)
    return number


def order_buckets(
    df: DataFrame,
    by: Column,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    tie: Column | None = None,
) -> Buckets:
    """Bucket edges that hold about ``rows`` rows each.

    Round one cuts every key's range evenly; the next cuts each slot that is
    still too full by the range actually seen inside it, which absorbs outlier
    order values and uneven sampling.  With a numeric ``tie`` column a slot
    whose order values are all equal is cut by the tie instead, and a third
    round follows.  Rounds are map-side combined aggregates over the keys and
    the order columns only.
    """
    keys = list(keys)
    tied = by if tie is None else tie
    thin = df.select(*keys, by.cast("double").alias("_by"), tied.cast("double").alias("_tie"))
    parts = F.ceil(F.count(F.lit(1)) / F.lit(float(rows))).cast("long")
    found: list[DataFrame] = []
    slots: list[str] = []
    levels = 2 if tie is None else 3
    for level in range(levels):
        on = [*keys, *slots]
        seen = thin.groupBy(*on).agg(
            F.least(parts, F.lit(1 << _LEVEL_BITS).cast("long")).alias("_parts"),
            F.min("_by").alias("_b0"), F.max("_by").alias("_b1"),
            F.min("_tie").alias("_t0"), F.max("_tie").alias("_t1"),
        )
        equal = F.col("_b0") == F.col("_b1")
        cuts = seen.select(
            *on,
            F.when(equal, F.col("_t0")).otherwise(F.col("_b0")).alias("_lo"),
            F.when(equal, F.col("_t1")).otherwise(F.col("_b1")).alias("_hi"),
            "_parts",
            equal.alias("_by_tie"),
        )
        edges = settle(cuts)
        found.append(edges)
        if level < levels - 1:
            thin = thin.join(edges, on).withColumn(f"_s{level}", _slot()).drop(*_EDGE)
        slots.append(f"_s{level}")
    return Buckets(tuple(found), tuple(keys))


def index_in_buckets(
    df: DataFrame,
    bucket: str,
    order: Sequence[Column],
    keys: Sequence[str] = (LOG,),
    name: str = IDX,
    total: str | None = None,
    hold: Sequence[str] = (),
) -> DataFrame:
    """Dense 0-based position per key: position in bucket + rows of earlier buckets.

    ``total`` also attaches the number of rows of the key.  ``hold`` fills the
    NULLs of columns with their last earlier value in the same pass.  Reads
    ``df`` twice: once for a row per bucket, once for the rows.
    """
    keys = list(keys)
    rank = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in hold:
        aggs.append(F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"_tail_{c}"))
    counts = df.groupBy(*keys, bucket).agg(*aggs)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    cols = [*keys, bucket, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_base")]
    if total:
        cols.append(F.sum("_rows").over(Window.partitionBy(*keys)).alias(total))
    for c in hold:
        cols.append(F.last(f"_tail_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}"))
    base = settle(counts.select(*cols))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumns(
        {
            "_pos": F.row_number().over(inside),
            **{f"_held_{c}": F.last(c, ignorenulls=True).over(so_far) for c in hold},
        }
    ).join(base, [*keys, bucket])
    return ranked.withColumns(
        {
            name: (F.col("_base") + F.col("_pos") - 1).cast("long"),
            **{c: F.coalesce(f"_held_{c}", f"_carry_{c}") for c in hold},
        }
    ).drop("_base", "_pos", *[f"_{k}_{c}" for k in ("held", "carry") for c in hold])


def with_record_index(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    total: str | None = None,
    hold: Sequence[str] = (),
) -> DataFrame:
    """Add the dense record number ``idx`` per log.

    ``order[0]`` must be numeric (a time or a counter); the rest break ties,
    and a numeric ``order[1]`` also lets many equal ``order[0]`` be cut.  If no log has over
    ``rows`` records, each is one sorted window; else ``df`` is read up to five times, all but
    one for a column or two.  So ``df`` should be a table scan or a materialised frame.
    """
    if fits_chunk(df, keys, rows):
        return _indexed_whole(df, order, list(keys), total, hold)
    types = dict(df.dtypes)
    numeric = len(order) > 1 and types[order[1]] in ("int", "bigint", "double", "float")
    tie = F.col(order[1]) if numeric else None
    edges = order_buckets(df, F.col(order[0]), keys, rows, tie)
    bucketed = edges.assign(df, F.col(order[0]), "_bucket", tie)
    out = index_in_buckets(
        bucketed, "_bucket", [F.col(c) for c in order], keys, IDX, total, hold
    )
    return out.drop("_bucket")


def fits_chunk(df: DataFrame, keys: Sequence[str] = (LOG,), rows: int = CHUNK_ROWS) -> bool:
    """Whether no key has over ``rows`` rows, by one map-side combined count."""
    return (log_sizes(df, keys, "_n").agg(F.max("_n")).first()[0] or 0) <= rows


def _indexed_whole(
    df: DataFrame, order: Sequence[str], keys: list[str], total: str | None, hold: Sequence[str]
) -> DataFrame:
    log = Window.partitionBy(*keys)
    inside = log.orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    columns = {IDX: (F.row_number().over(inside) - 1).cast("long")}
    columns |= {c: F.last(c, ignorenulls=True).over(so_far) for c in hold}
    if total:
        columns[total] = F.count(F.lit(1)).over(log)
    return df.withColumns(columns)


def log_sizes(df: DataFrame, keys: Sequence[str] = (LOG,), name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def halo_chunks(df: DataFrame, before: int, after: int, rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with ``_home`` and ``_chunk``: one copy for each chunk whose frames reach them.

    Chunks grow with the reach so that the copied share stays small.
    """
    size = max(rows, 8 * (before + after), 1)
    idx = F.col(IDX)
    return df.withColumn("_home", F.floor(idx / size)).withColumn(
        "_chunk",
        F.explode(
            F.sequence(
                F.greatest(F.floor((idx - after) / size), F.lit(0).cast("long")),
                F.floor((idx + before) / size),
            )
        ),
    )


def halo_windows(
    df: DataFrame,
    columns: Mapping[str, Callable[[WindowSpec], Column]],
    before: int = 0,
    after: int = 0,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Evaluate row-frame window expressions on halo chunks.

    Each callable receives a window partitioned by (keys, chunk) and ordered by
    ``idx``; its frame may reach ``before`` rows back and ``after`` rows ahead.
    A row near a chunk edge is copied to the neighbour chunk that needs it and
    the copies are dropped at the end.
    """
    chunked = halo_chunks(df, before, after, rows)
    w = Window.partitionBy(*keys, "_chunk").orderBy(IDX)
    for name, build in columns.items():
        chunked = chunked.withColumn(name, build(w))
    return chunked.filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def hold_last(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    start: float | None = None,
) -> DataFrame:
    """Replace NULLs by the last earlier value; ``start`` fills what precedes the first."""
    keys = list(keys)
    chunked = df.withColumn("_chunk", F.floor(F.col(IDX) / rows))
    tails = chunked.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(IDX))).alias(f"_tail_{c}")
            for c in columns
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = settle(
        tails.select(
            *keys,
            "_chunk",
            *[
                F.last(f"_tail_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}")
                for c in columns
            ],
        )
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(IDX).rowsBetween(
        Window.unboundedPreceding, 0
    )
    held = {c: F.last(c, ignorenulls=True).over(inside) for c in columns}
    out = chunked.withColumns({f"_held_{c}": e for c, e in held.items()}).join(
        carry, [*keys, "_chunk"]
    )
    final = {}
    for c in columns:
        options = [F.col(f"_held_{c}"), F.col(f"_carry_{c}")]
        if start is not None:
            options.append(F.lit(start))
        final[c] = F.coalesce(*options)
    out = out.withColumns(final)
    return out.drop("_chunk", *[f"_held_{c}" for c in columns], *[f"_carry_{c}" for c in columns])


def hold_vectors(
    df: DataFrame, bucket: str, order: str, cells: str, keys: Sequence[str] = (LOG,), start: float = 0.0
) -> DataFrame:
    """Numbers the rows of each key and replaces NULL cells by the last earlier one of their place.

    ``df`` is a written table of rows (keys, bucket, order, cells ...) with as many cells in all
    rows of a key; buckets grow with ``order``.  What precedes a place's first cell is
    ``start``.  A batch gives, for each bucket in it, its number of rows and the last cell of
    each place; these are summed and held on per key and come back as a row before each
    bucket's rows.  So cells stay vectors, and the rows are shuffled once.
    """
    keys = list(keys)
    tasks = python_tasks(df.sparkSession)
    long, double = TYPES.LongType(), TYPES.DoubleType()
    fields = [df.schema[k] for k in keys]
    tail_schema = TYPES.StructType([
        *fields, TYPES.StructField(bucket, long), TYPES.StructField("_rows", long),
        TYPES.StructField(cells, TYPES.ArrayType(double)), TYPES.StructField("_at", TYPES.ArrayType(long)),
    ])
    tail_fields = to_arrow_schema(tail_schema)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by([(c, "ascending") for c in (*keys, bucket, order)])
            at = np.r_[0, 1 + np.flatnonzero(_changes(table, [*keys, bucket])), table.num_rows]
            line = table.column(order).to_numpy()
            last, where = [], []
            for low, high in zip(at[:-1], at[1:]):
                value, known = _vectors(table.column(cells), low, high)
                row = np.where(known, np.arange(high - low)[:, None], -1).max(0)
                place = np.arange(len(row))
                last.append(pa.array(value[np.maximum(row, 0), place], mask=row < 0))
                where.append(pa.array(line[low + np.maximum(row, 0)], mask=row < 0))
            first = table.take(pa.array(at[:-1]))
            columns = [first.column(c).combine_chunks() for c in (*keys, bucket)]
            columns += [pa.array(np.diff(at)), _lists(last, pa.float64()), _lists(where, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, tail_fields)], schema=tail_fields
            )

    def walk(table):
        """The rows before each bucket of one key, and the cells held until then."""
        table = table.sort_by(bucket)
        at = np.r_[0, 1 + np.flatnonzero(_changes(table, [bucket])), table.num_rows]
        count = table.column("_rows").to_numpy()
        base, state, bases, states = 0, None, [], []
        for low, high in zip(at[:-1], at[1:]):
            bases.append(base)
            states.append(state if state is None else list(state))
            base += int(count[low:high].sum())
            value, known = _vectors(table.column(cells), low, high)
            line, _ = _vectors(table.column("_at"), low, high)
            row = np.where(known, line, -1).argmax(0)
            place = np.arange(value.shape[1])
            here = value[row, place].astype(object)
            here[~known.any(0)] = None
            state = here if state is None else np.where(known.any(0), here, state)
        first = table.take(pa.array(at[:-1]))
        columns = {c: first.column(c) for c in (*keys, bucket)}
        columns |= {"_rows": bases, cells: states, "_at": [None] * len(bases)}
        return pa.Table.from_arrays(
            [pa.chunked_array(columns[f.name].chunks, f.type) if f.name in (*keys, bucket) else pa.array(columns[f.name], f.type)
             for f in tail_fields], schema=tail_fields,
        )

    ends = df.select(*keys, bucket, order, cells).mapInArrow(tails, tail_schema)
    carry = settle(ends.groupBy(*keys).applyInArrow(walk, tail_schema)).drop("_at")
    every = df.withColumn("_rows", F.lit(None).cast("long")).unionByName(carry, allowMissingColumns=True)
    rest = [c for c in df.columns if c not in (bucket, order, cells)]
    schema = TYPES.StructType(
        [*[df.schema[c] for c in rest], TYPES.StructField(IDX, long), TYPES.StructField(cells, TYPES.ArrayType(double))]
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, [*keys, bucket]):
            parts, number = [], []
            base = table.column("_rows").to_numpy()
            for low, high in zip(at[:-1], at[1:]):  # the carried row stands first
                value, known = _vectors(table.column(cells), low + 1, high)
                row = np.maximum.accumulate(np.where(known, np.arange(len(value))[:, None], -1), axis=0)
                held = table.column(cells)[int(low)].as_py() or [None] * value.shape[1]
                before = np.array([start if v is None else v for v in held])
                parts.append(np.where(row < 0, before, value[np.maximum(row, 0), np.arange(value.shape[1])]))
                number.append(int(base[low]) + np.arange(high - low - 1))
            body = np.ones(table.num_rows, bool)
            body[at[:-1]] = False
            kept = table.filter(pa.array(body)).select(rest)
            size = np.concatenate([np.full(len(p), p.shape[1]) for p in parts])
            flat = pa.array(np.concatenate([p.reshape(-1) for p in parts]), pa.float64())
            lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), flat)
            kept = kept.append_column(IDX, pa.array(np.concatenate(number)))
            yield from kept.append_column(cells, lists).to_batches()

    dealt = every.repartition(tasks, *keys, bucket).sortWithinPartitions(
        *keys, bucket, F.col("_rows").isNull(), order
    )
    return dealt.mapInArrow(fill, schema)


def _vectors(column: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of one length as rows of an array, and which cells are there."""
    part = column.slice(int(low), int(high - low))
    if isinstance(part, pa.ChunkedArray):
        part = part.combine_chunks()
    flat = pc.list_flatten(part)
    width = len(flat) // max(int(high - low), 1)
    known = ~flat.is_null().to_numpy(zero_copy_only=False)
    shape = (int(high - low), width)
    return flat.to_numpy(zero_copy_only=False).reshape(shape), known.reshape(shape)


def _lists(rows: list[pa.Array], kind: pa.DataType) -> pa.Array:
    size = [len(r) for r in rows]
    flat = pa.concat_arrays([r.cast(kind) for r in rows])
    return pa.ListArray.from_arrays(np.r_[0, np.cumsum(size)].astype(np.int32), flat)


def running_sum(
    df: DataFrame,
    value: str,
    out: str,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Inclusive running total by ``idx``, carried over chunks by their totals."""
    keys = list(keys)
    chunked = df.withColumn("_chunk", F.floor(F.col(IDX) / rows))
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = settle(
        totals.select(
            *keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")
        )
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(IDX).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        chunked.withColumn("_part", F.sum(value).over(inside))
        .join(base, [*keys, "_chunk"])
        .withColumn(out, F.col("_base") + F.col("_part"))
        .drop("_chunk", "_part", "_base")
    )


def whole_groups(
    batches: Iterator[pa.RecordBatch], columns: Sequence[str]
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows cut where a group ends: (rows of complete groups, their n + 1 offsets).

    A group is a run of rows equal in ``columns``; what is held is the last, incomplete one.
    """
    held: list[pa.RecordBatch] = []

    def closed(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.combine_chunks()
        return table, np.r_[0, 1 + np.flatnonzero(_changes(table, columns)), table.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        here = pa.Table.from_batches([batch])
        cuts = 1 + np.flatnonzero(_changes(here, columns))
        if held:
            ends = pa.concat_tables([pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1)]), here.slice(0, 1)])
            if _changes(ends, columns)[0]:
                cuts = np.r_[0, cuts]
        if len(cuts):
            cut = int(cuts[-1])
            done = [*held, batch.slice(0, cut)] if cut else held
            yield closed(pa.Table.from_batches(done))
            held = []
            batch = batch.slice(cut)
        held.append(batch)
    if held:
        yield closed(pa.Table.from_batches(held))


def _changes(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Whether each row but the first differs from the row before."""
    differs = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in columns:
        column = table.column(c)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        a, b = column[1:], column[:-1]
        unlike = pc.fill_null(pc.not_equal(a, b), False)
        unlike = pc.or_(unlike, pc.xor(pc.is_null(a), pc.is_null(b)))
        differs |= unlike.to_numpy(zero_copy_only=False)
    return differs
