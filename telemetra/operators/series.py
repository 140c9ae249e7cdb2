"""Ordered-series operators on records: smoothing, derivatives, shifts, scaling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TYPES

from telemetra.frame import EPSILON, IDX, LOG, T, not_nan
from telemetra.operators import stats
from telemetra.operators.layout import (
    CHUNK_ROWS, halo_chunks, halo_windows, log_sizes, python_tasks, running_sum, whole_groups,
)
from telemetra.session import settle

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def moving_average(
    records: DataFrame,
    value: str,
    window: int = 5,
    out: str = "moving_average",
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Trailing mean of up to ``window`` records; a zero window copies the input.

    Windows over an eighth of a chunk are summed from whole chunks and parts of the two
    at their ends, so a task holds a chunk whatever the window.
    """
    if window == 0:
        return records.withColumn(out, F.col(value))
    if window - 1 > rows // 8:
        return _long_average(records, value, window, out, list(keys), min(rows, window))
    return halo_windows(
        records,
        {out: lambda w: F.avg(value).over(w.rowsBetween(-(window - 1), 0))},
        before=window - 1,
        keys=keys,
        rows=rows,
    )


def _long_average(
    records: DataFrame, value: str, window: int, out: str, keys: list[str], rows: int
) -> DataFrame:
    """Trailing mean over ``window`` records, at least a chunk of ``rows``.

    The sum is that of the end of the window's first chunk, of the chunks between, and
    of the beginning of its last.  Nothing is subtracted, so nothing cancels and what is
    no number stays within its windows.
    """
    chunked = records.withColumn("_chunk", F.floor(F.col(IDX) / rows))
    inside = Window.partitionBy(*keys, "_chunk")
    up = inside.orderBy(IDX).rowsBetween(Window.unboundedPreceding, 0)
    down = inside.orderBy(F.col(IDX).desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = chunked.withColumns(
        {
            f"_{name}{kind}": (F.sum(value) if kind == "s" else F.count(value)).over(frame)
            for name, frame in (("head", up), ("tail", down))
            for kind in "sn"
        }
    )
    # the chunks between: one fewer if the window begins late in its first chunk
    between = (window - 1) // rows
    totals = chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_chunk")
    middles = {}
    for k in {between - 1, between}:
        for kind in "sn":
            whole = F.sum(f"_{kind}").over(order.rowsBetween(-k, -1)) if k > 0 else F.lit(None)
            middles[f"_mid{k}{kind}"] = whole.cast("double" if kind == "s" else "long")
    middle = settle(totals.withColumns(middles).drop("_s", "_n"))
    begins = F.col(IDX) - (window - 1)
    first = F.when(begins < 0, F.lit(-1)).otherwise(F.floor(begins / rows))
    tails = summed.select(*keys, (F.col(IDX) + (window - 1)).alias(IDX), "_tails", "_tailn")
    met = summed.drop("_tails", "_tailn").join(middle, [*keys, "_chunk"]).join(tails, [*keys, IDX], "left")
    parts = {}
    for kind in "sn":
        late = F.col("_chunk") - first - 1 == between
        mid = F.when(late | (begins < 0), F.col(f"_mid{between}{kind}")).otherwise(F.col(f"_mid{between - 1}{kind}"))
        own = F.when(first < F.col("_chunk"), F.col(f"_tail{kind}"))  # else the chunk is the window
        pieces = [F.col(f"_head{kind}"), F.when(first < F.col("_chunk"), mid), own]
        parts[kind] = sum((F.coalesce(p, F.lit(0)) for p in pieces[1:]), F.coalesce(pieces[0], F.lit(0)))
    mean = F.when(parts["n"] > 0, parts["s"] / parts["n"])
    return met.withColumn(out, mean).select(*records.columns, out)


#: Median windows that are gathered as an array of each record.
SMALL_WINDOW = 63


def median_filter(
    records: DataFrame,
    value: str,
    window: int = 5,
    out: str = "median_filter",
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Centred median, cut at the log ends; an even window is widened by one.

    Small windows are arrays sorted inside the JVM.  Beyond ``SMALL_WINDOW`` the records of
    a chunk are ranked once, and the middle ranks of all windows are found together bit by
    bit, so neither time nor memory of a record grows with the window.
    """
    if window == 0:
        return records.withColumn(out, F.col(value))
    half = (window + 1 - window % 2) // 2
    if 2 * half + 1 > SMALL_WINDOW:
        return _long_median(records, value, half, out, list(keys), rows)
    gathered = halo_windows(
        records,
        {"_near": lambda w: F.sort_array(F.collect_list(value).over(w.rowsBetween(-half, half)))},
        before=half,
        after=half,
        keys=keys,
        rows=rows,
    )
    size = F.size("_near")
    low = F.get("_near", F.floor((size - 1) / 2).cast("int"))
    high = F.get("_near", F.floor(size / 2).cast("int"))
    return gathered.withColumn(out, (low + high) / 2.0).drop("_near")


def _long_median(
    records: DataFrame, value: str, half: int, out: str, keys: list[str], rows: int
) -> DataFrame:
    columns = [c for c in records.columns if c != out]
    schema = TYPES.StructType([*[records.schema[c] for c in columns], TYPES.StructField(out, TYPES.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, [*keys, "_chunk"]):
            home = table.column("_home").to_numpy() == table.column("_chunk").to_numpy()
            cells = table.column(value).cast(pa.float64())
            known = ~cells.is_null().to_numpy()
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            place = np.arange(len(owner))
            low = np.maximum(place - half, at[owner])[home]
            high = np.minimum(place + half + 1, at[owner + 1])[home]
            seen = np.r_[0, np.cumsum(known)]  # windows over the cells that are there
            middle = window_medians(cells.to_numpy()[known], seen[low], seen[high])
            kept = table.filter(pa.array(home)).select(columns)
            column = pa.array(middle, mask=seen[low] == seen[high])
            yield from kept.append_column(out, column).to_batches()

    tasks = python_tasks(records.sparkSession)
    chunked = halo_chunks(records.select(*columns), half, half, rows)
    dealt = chunked.repartition(tasks, *keys, "_chunk").sortWithinPartitions(*keys, "_chunk", IDX)
    return dealt.mapInArrow(run, schema)


def window_medians(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Medians of the ranges low .. high of x, the mean of both middles for an even number.

    The ranks of x are split by their bits, highest first, zeros before ones in stable
    order; how many zeros stand before a place tells where a range goes and on which side
    of it the k-th smallest lies.  All ranges move on together.  What is no number ranks last.
    """
    if not len(x):
        return np.full(len(low), np.nan)
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    size = high - low
    asked = np.r_[np.maximum(size - 1, 0) // 2, size // 2]
    a, b = np.r_[low, low], np.r_[high, high]
    found = np.zeros(len(asked), np.int64)
    for bit in range(int(len(x) - 1).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1 == 1
        zeros = np.r_[0, np.cumsum(~one)]
        left, right = zeros[a], zeros[b]
        up = asked >= right - left
        found |= up.astype(np.int64) << bit
        asked = np.where(up, asked - (right - left), asked)
        a = np.where(up, zeros[-1] + a - left, left)
        b = np.where(up, zeros[-1] + b - right, right)
        rank = np.concatenate([rank[~one], rank[one]])
    middle = x[order[np.minimum(found, len(x) - 1)]]
    return (middle[: len(low)] + middle[len(low) :]) / 2.0


def time_derivative(
    records: DataFrame,
    value: str,
    out: str = "derivative",
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Central difference per second, one-sided at the ends; equal times give 0."""
    near = halo_windows(
        records,
        {
            "_v1": lambda w: F.coalesce(F.lead(value).over(w), F.col(value)),
            "_v0": lambda w: F.coalesce(F.lag(value).over(w), F.col(value)),
            "_t1": lambda w: F.coalesce(F.lead(T).over(w), F.col(T)),
            "_t0": lambda w: F.coalesce(F.lag(T).over(w), F.col(T)),
        },
        before=1,
        after=1,
        keys=keys,
        rows=rows,
    )
    dt = F.col("_t1") - F.col("_t0")
    slope = F.when(
        F.abs(dt) > EPSILON, F.try_divide(F.col("_v1") - F.col("_v0"), dt)
    ).otherwise(F.lit(0.0))
    return near.withColumn(out, slope).drop("_v1", "_v0", "_t1", "_t0")


def sample_derivative(
    records: DataFrame,
    value: str,
    out: str = "derivative",
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Difference per record: halved between neighbours, one-sided at the ends."""
    near = halo_windows(
        records,
        {"_v1": lambda w: F.lead(value).over(w), "_v0": lambda w: F.lag(value).over(w)},
        before=1,
        after=1,
        keys=keys,
        rows=rows,
    )
    ends = F.col("_v1").isNull() | F.col("_v0").isNull()
    rise = F.coalesce("_v1", value) - F.coalesce("_v0", value)
    return near.withColumn(out, F.when(ends, rise).otherwise(rise / 2.0)).drop("_v1", "_v0")


def index_shift(
    records: DataFrame,
    columns: dict[str, tuple[str, int]],
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``{new: (channel, k)}``: the channel k records on, clamped to the log.

    Shifts up to an eighth of a chunk use halo windows.  Longer ones look the
    target record up by its number, so chunks never grow with the shift.
    """
    short = {n: s for n, s in columns.items() if abs(s[1]) <= rows // 8}
    far = {n: s for n, s in columns.items() if n not in short}
    out = records
    if short:
        def build(channel: str, k: int):
            def expr(w):
                cell = F.struct(F.col(channel).alias("v"))
                moved = F.lead(cell, k).over(w) if k >= 0 else F.lag(cell, -k).over(w)
                frame = w.rowsBetween(*WHOLE)
                edge = F.last(cell).over(frame) if k >= 0 else F.first(cell).over(frame)
                return F.coalesce(moved, edge)["v"]

            return expr

        shifts = [k for _, k in short.values()]
        out = halo_windows(
            out,
            {n: build(c, k) for n, (c, k) in short.items()},
            before=max(0, -min(shifts)),
            after=max(0, max(shifts)),
            keys=keys,
            rows=rows,
        )
    if far:
        sizes = settle(log_sizes(records, keys, "_n"))
        for new, (channel, k) in far.items():
            target = F.least(F.greatest(F.col(IDX) + F.lit(k), F.lit(0)), F.col("_n") - 1)
            cells = records.select(
                *keys, F.col(IDX).alias("_target"), F.col(channel).alias(new)
            )
            out = (
                out.join(sizes, list(keys))
                .withColumn("_target", target.cast("long"))
                .join(cells, [*keys, "_target"], "left")
                .drop("_target", "_n")
            )
    return out


def z_score(
    records: DataFrame, value: str, out: str = "z", keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """(x - mean) / max(sample stdev, 0.001) per log."""
    s = stats.describe(records, value, keys, median=False).select(
        *keys, F.col("mean").alias("_mean"), F.greatest("stdev", F.lit(0.001)).alias("_sd")
    )
    return (
        records.join(settle(s), list(keys))
        .withColumn(out, (F.col(value) - F.col("_mean")) / F.col("_sd"))
        .drop("_mean", "_sd")
    )


def normalise(
    points: DataFrame, value: str, out: str = "normal", keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """Scale each series to 0..1; a constant series becomes 0.5."""
    v = not_nan(F.col(value))
    limits = points.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return scale_to_unit(points.join(settle(limits), list(keys)), value, out)


def scale_to_unit(points: DataFrame, value: str, out: str) -> DataFrame:
    """(value - _lo) / (_hi - _lo), or 0.5 without a spread; drops the limits."""
    spread = F.col("_hi") - F.col("_lo")
    scaled = F.when(F.abs(spread) < EPSILON, F.lit(0.5)).otherwise(
        F.try_divide(F.col(value) - F.col("_lo"), spread)
    )
    return points.withColumn(out, scaled).drop("_lo", "_hi")


def unwrap_clock(
    blocks: DataFrame,
    raw: str = "raw_ts",
    out: str = T,
    threshold: int = 30000,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Seconds of a 16-bit millisecond clock that starts over at 65536.

    A drop of more than ``threshold`` counts is one turn.  Every block, of any
    type, moves the clock, so pass all of them and keep the data blocks after.
    """
    drop = F.coalesce(F.col("_prev"), F.lit(0)) - F.col(raw)
    turned = halo_windows(
        blocks, {"_prev": lambda w: F.lag(raw).over(w)}, before=1, keys=keys, rows=rows
    ).withColumn("_turn", F.when(drop > threshold, F.lit(1)).otherwise(F.lit(0)))
    counted = running_sum(turned, "_turn", "_turns", keys, rows)
    seconds = F.col(raw) / F.lit(1000.0) + F.col("_turns") * F.lit(65.536)
    return counted.withColumn(out, seconds).drop("_prev", "_turn", "_turns")


def monotonic_audit(
    records: DataFrame, keys: Sequence[str] = (LOG,), rows: int = CHUNK_ROWS
) -> DataFrame:
    """Per log: how many records run backwards in time."""
    near = halo_windows(
        records, {"_prev": lambda w: F.lag(T).over(w)}, before=1, keys=keys, rows=rows
    )
    back = F.coalesce(F.sum(F.when(F.col(T) < F.col("_prev"), 1)), F.lit(0))
    return near.groupBy(*keys).agg(back.alias("backward_steps"))


def slice_bounds(
    ranges: DataFrame,
    mode: str,
    width: float,
    centre: Column | float | None = None,
) -> DataFrame:
    """View window per log from its t_first and t_last.

    ``cursor`` cuts the window at the data range, ``jump`` slides it back inside
    with its full width, ``start`` shows the first ``width`` seconds.
    """
    first, last = F.col("t_first"), F.col("t_last")
    if mode == "start":
        low = first
        high = F.when(last - first > width, first + F.lit(width)).otherwise(last)
    else:
        mid = F.lit(centre) if isinstance(centre, (int, float)) else centre
        half = F.lit(width / 2.0)
        low, high = F.greatest(mid - half, first), F.least(mid + half, last)
        if mode == "jump":
            short = high - low < width
            at_start = short & (low == first)
            low, high = (
                F.when(short & (low != first), F.greatest(last - F.lit(width), first)).otherwise(low),
                F.when(at_start, F.least(first + F.lit(width), last)).otherwise(high),
            )
        elif mode != "cursor":
            raise ValueError(f"unknown view mode {mode!r}")
    return ranges.withColumns({"t_low": low, "t_high": high})


def time_slice(records: DataFrame, bounds: DataFrame, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """The records inside each log's window."""
    b = bounds.select(*keys, "t_low", "t_high")
    return (
        records.join(settle(b), list(keys))
        .filter(F.col(T).between(F.col("t_low"), F.col("t_high")))
        .drop("t_low", "t_high")
    )
