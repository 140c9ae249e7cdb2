"""Largest-triangle-three-buckets downsampling of very long series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TYPES
from pyspark.sql.pandas.types import to_arrow_schema

from telemetra.frame import IDX, LOG, T, not_nan
from telemetra.operators.layout import CHUNK_ROWS, log_sizes, python_tasks
from telemetra.operators.series import scale_to_unit
from telemetra.session import materialise, settle

CHART_POINTS = 2000
_SLOTS_PER_TASK = 64
_SMALL_SLOT = 64  # points that are cheaper to compare than to hull
_PAIRS = 1 << 22  # areas computed at once; beyond that the hull is searched
_BESIDE = 8  # corners compared on each side of the one found by slope


def _start(slot: Column, width: Column) -> Column:
    return F.floor(slot * width) + 1


def _slot_of(idx: Column, width: Column) -> Column:
    """Slot s holds the records start(s) <= idx < start(s + 1).

    The quotient may miss by one in the last bit, so both starts are compared.
    """
    guess = F.floor((idx - 1) / width)
    return F.when(_start(guess, width) > idx, guess - 1).when(
        _start(guess + 1, width) <= idx, guess + 1
    ).otherwise(guess)


def _corners(t: np.ndarray, v: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Positions of the convex-hull corners, each tie settled by the lowest record.

    For a fixed previous point and next mean, the triangle area is the absolute
    value of a linear function of (t, v), so its largest value in a bucket sits
    on a corner.
    """
    if len(t) <= 3:
        return np.arange(len(t))
    usable = ~np.isnan(v)
    if not usable.all():  # they never win, but the first record stands where no area is a number
        inner = np.flatnonzero(usable)
        corners = inner[_corners(t[inner], v[inner], i[inner])] if len(inner) else inner
        return np.union1d(corners, [int(np.argmin(i))])
    order = np.lexsort((i, v, t))
    # Equal points count once, as their earliest record.
    ts, vs = t[order], v[order]
    fresh = np.r_[True, (ts[1:] != ts[:-1]) | (vs[1:] != vs[:-1])]
    order = order[fresh]
    ts, vs = ts[fresh].tolist(), vs[fresh].tolist()
    keep: set[int] = set()
    for walk in (range(len(ts)), range(len(ts) - 1, -1, -1)):
        chain: list[int] = []
        for p in walk:
            while len(chain) >= 2:
                a, b = chain[-2], chain[-1]
                if (ts[b] - ts[a]) * (vs[p] - vs[a]) > (vs[b] - vs[a]) * (ts[p] - ts[a]):
                    break
                chain.pop()
            chain.append(p)
        keep.update(chain)
    kept = {int(order[p]) for p in keep}
    # Where several records share an end time, the earliest one may win a tie.
    for end in (ts[0], ts[-1]):
        same = np.flatnonzero(t == end)
        kept.add(int(same[np.argmin(i[same])]))
    kept.add(int(np.argmin(i)))  # the choice where no area is a number
    return np.array(sorted(kept))


def _best(
    p: tuple[np.ndarray, np.ndarray], centre: tuple[float, float], t: np.ndarray, v: np.ndarray
) -> np.ndarray:
    """For each earlier point the position of the record of largest triangle, the first of equals.

    Records are in order; where no area is a number the first is taken.
    """
    pt, pv = p
    ct, cv = centre
    if len(pt) * len(t) > _PAIRS:
        return _best_on_hull(p, centre, t, v)
    a, b = (pt - ct)[:, None], (cv - pv)[:, None]
    area = np.abs(a * (v - pv[:, None]) - (pt[:, None] - t) * b)
    return np.where(np.isnan(area), -1.0, area).argmax(1)


def _hull(t: np.ndarray, v: np.ndarray, sign: int) -> np.ndarray:
    """Positions of the upper (sign 1) or lower (sign -1) hull by growing time."""
    order = np.lexsort((-sign * v, t))
    chain: list[int] = []
    ts, vs = t[order].tolist(), (sign * v[order]).tolist()
    for k in range(len(ts)):
        if chain and ts[k] == ts[chain[-1]]:
            continue
        while len(chain) >= 2:
            x, y = chain[-2], chain[-1]
            if (ts[y] - ts[x]) * (vs[k] - vs[x]) < (vs[y] - vs[x]) * (ts[k] - ts[x]):
                break
            chain.pop()
        chain.append(k)
    return order[chain]


def _best_on_hull(
    p: tuple[np.ndarray, np.ndarray], centre: tuple[float, float], t: np.ndarray, v: np.ndarray
) -> np.ndarray:
    """The same for many points and records: the area is linear in (t, v), so its extremes lie
    where the hull's slope passes that of the line from the earlier point to the centre."""
    pt, pv = p
    ct, cv = centre
    usable = np.flatnonzero(~np.isnan(v))
    best = np.zeros(len(pt), np.int64)
    top = np.full(len(pt), -1.0)
    if not len(usable):
        return best
    with np.errstate(divide="ignore", invalid="ignore"):
        line = (cv - pv) / (ct - pt)
    for sign in (1, -1):
        hull = usable[_hull(t[usable], v[usable], sign)]
        slope = np.diff(sign * v[hull]) / np.diff(t[hull])
        # slopes fall along the hull; the vertex after all that are steeper than the line
        at = np.searchsorted(-slope, -sign * line) if len(slope) else np.zeros(len(pt), np.int64)
        near = [np.clip(at + d, 0, len(hull) - 1) for d in range(-_BESIDE, _BESIDE + 1)]
        for k in [*near, np.zeros_like(at), np.full_like(at, len(hull) - 1)]:
            c = hull[k]
            area = np.abs((pt - ct) * (v[c] - pv) - (pt - t[c]) * (cv - pv))
            better = (area > top) | ((area == top) & (c < best))
            best, top = np.where(better, c, best), np.where(better, area, top)
    # the record that stands first where no area is a number or all are nought
    area = np.abs((pt - ct) * (v[0] - pv) - (pt - t[0]) * (cv - pv))
    return np.where(area >= top, 0, best)


def lttb(
    records: DataFrame,
    value: str,
    target: int = CHART_POINTS,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    canonical: bool = False,
) -> DataFrame:
    """keys, pos, idx, t, value: at most ``target`` points that keep the shape.

    A log with no more than ``target`` records is returned whole.  By default
    the candidate buckets start one bucket late, as in the established results,
    so the last bucket is usually empty and the last record appears twice;
    ``canonical`` uses the published bucketing.

    A log of up to ``rows`` records is one task.  In longer logs the bucket means are
    aggregates and each bucket is cut down to its hull corners, block by block.  The
    point taken from a bucket depends on the point before only through a finite map, from the
    corners of one bucket to those of the next; all maps are found at once, each kept
    for the corners that the map before can give, which are few.  Where a log's maps
    are still over ``rows`` rows, they are joined pairwise into maps over 2, 4, 8 ... buckets
    and followed from the top.  What a task holds is two neighbouring buckets.
    """
    keys = list(keys)
    if "n" not in records.columns:
        sizes = settle(log_sizes(records, keys))
        longer = not sizes.filter(F.col("n") > rows).isEmpty()
        records = records.join(sizes, keys)
    else:
        longer = not records.filter(F.col("n") > rows).isEmpty()
    points = records.select(*keys, IDX, T, F.col(value).alias("v"), "n")
    whole = F.lit(target < 3) | (F.col("n") <= target)
    as_is = points.filter(whole).select(*keys, F.col(IDX).alias("pos"), IDX, T, "v")
    if target < 3:
        return as_is.withColumnRenamed("v", value)
    width = (F.col("n") - 2).cast("double") / F.lit(float(target - 2))
    slotted = (
        points.filter(~whole)
        .withColumn("_w", width)
        .withColumn("_slot", _slot_of(F.col(IDX), F.col("_w")).cast("long"))
    )
    first_slot = 0 if canonical else 1
    long = F.col("n") > rows
    short = slotted.filter(~long) if longer else slotted
    out = as_is.unionByName(_walked(short, keys, target, first_slot))
    if longer:
        out = out.unionByName(_followed(slotted.filter(long), keys, target, first_slot, rows))
    return out.withColumnRenamed("v", value)


def _points_schema(df: DataFrame, keys: Sequence[str]) -> TYPES.StructType:
    longs = [TYPES.StructField(c, TYPES.LongType()) for c in ("pos", IDX)]
    doubles = [TYPES.StructField(c, TYPES.DoubleType()) for c in (T, "v")]
    return TYPES.StructType([*[df.schema[k] for k in keys], *longs, *doubles])


def _walked(slotted: DataFrame, keys: list[str], target: int, first_slot: int) -> DataFrame:
    """The chains of logs that fit a task, whole logs at a time."""
    schema = _points_schema(slotted, keys)
    fields = to_arrow_schema(schema)
    tail = first_slot + target - 3

    def walk(key, table):
        i = table.column(IDX).to_numpy()
        order = np.argsort(i, kind="stable")
        slots = table.column("_slot").to_numpy()[order]
        t = table.column(T).to_numpy()[order]
        v = table.column("v").to_numpy()[order]
        known = ~table.column("v").is_null().to_numpy()[order]
        last = len(i) - 1
        # bucket s holds begin[s] .. begin[s + 1]; the first record is in none
        begin = 1 + np.searchsorted(slots[1:], np.arange(first_slot, tail + 3))
        chosen = [0]
        for s in range(target - 2):
            lo, hi = begin[s], min(begin[s + 1], last)
            if lo >= hi:  # only the last bucket can be empty
                chosen.append(last)
                continue
            a, b = hi, begin[s + 2] if s < target - 3 else last + 1
            centre = (t[last], v[last])
            if s < target - 3:
                with np.errstate(invalid="ignore"):
                    centre = (t[a:b].mean(), _mean(v[a:b], known[a:b]))
            p = chosen[-1]
            chosen.append(lo + int(_best((t[p : p + 1], v[p : p + 1]), centre, t[lo:hi], v[lo:hi])[0]))
        chosen.append(last)
        columns = {"pos": np.arange(target), IDX: i[order][chosen], T: t[chosen], "v": v[chosen]}
        named = dict(zip(keys, key))
        return pa.Table.from_arrays(
            [
                pa.array(columns[f.name], type=f.type)
                if f.name in columns
                else pa.repeat(named[f.name].cast(f.type), target)
                for f in fields
            ],
            schema=fields,
        )

    tasks = python_tasks(slotted.sparkSession)
    chosen = slotted.select(*keys, IDX, T, "v", "_slot").repartition(tasks, *keys)
    return chosen.groupBy(*keys).applyInArrow(walk, schema)


def _mean(v: np.ndarray, known: np.ndarray) -> float:
    """Mean of the values that are there; NaN if one of them is, or none is there."""
    count = int(known.sum())
    return float(v[known].sum()) / count if count else float("nan")


def _corner_rows(mine: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, _slot, idx, t, v): the hull corners of each bucket, cut in blocks first."""
    tasks = python_tasks(mine.sparkSession)
    fields = [mine.schema[k] for k in keys]
    long, double = TYPES.LongType(), TYPES.DoubleType()
    kinds = [("_slot", long), (IDX, long), (T, double), ("v", double)]
    schema = TYPES.StructType([*fields, *[TYPES.StructField(c, kind) for c, kind in kinds]])
    grouped = TYPES.StructType([*schema.fields, TYPES.StructField("_group", long)])

    def cut(table: pa.Table, columns: list[str]) -> pa.Table:
        slots, i = table.column("_slot").to_numpy(), table.column(IDX).to_numpy()
        order = np.lexsort((i, slots))
        slots, i = slots[order], i[order]
        t, v = (table.column(c).to_numpy()[order] for c in (T, "v"))
        begin = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
        end = np.r_[begin[1:], len(slots)]
        kept = [
            np.arange(a, b) if b - a <= _SMALL_SLOT else a + _corners(t[a:b], v[a:b], i[a:b])
            for a, b in zip(begin, end)
        ]
        return table.select(columns).take(pa.array(order[np.concatenate(kept)]))

    def reduce_block(table: pa.Table) -> pa.Table:
        return cut(table, grouped.names)

    def reduce_slots(table: pa.Table) -> pa.Table:
        return cut(table, schema.names)

    # slots to a task, so that their records are about ``rows`` even if all are corners
    per_task = F.greatest(F.lit(1), F.least(F.lit(_SLOTS_PER_TASK), F.floor(rows / F.col("_w"))))
    return (
        mine.withColumn("_group", F.floor(F.col("_slot") / per_task))
        .select(*grouped.names)
        .withColumn("_block", F.floor(F.col(IDX) / rows))
        .repartition(tasks, *keys, "_block")
        .groupBy(*keys, "_block")
        .applyInArrow(reduce_block, grouped)
        .repartition(tasks, *keys, "_group")
        .groupBy(*keys, "_group")
        .applyInArrow(reduce_slots, schema)
    )


def _followed(slotted: DataFrame, keys: list[str], target: int, first_slot: int, rows: int) -> DataFrame:
    """The chains of logs over ``rows`` records, by maps from bucket to bucket."""
    tail = first_slot + target - 3
    final = F.col(IDX) == F.col("n") - 1
    inner = slotted.filter((F.col(IDX) > 0) & ~final)
    corners = _corner_rows(inner.filter(F.col("_slot").between(first_slot, tail)), keys, rows)
    names = [*keys, "_slot", IDX, T, "v"]
    begin = slotted.filter(F.col(IDX) == 0).select(
        *keys, F.lit(first_slot - 1).cast("long").alias("_slot"), IDX, T, "v"
    )
    corners = materialise(corners.unionByName(begin).select(*names), "corners")
    ends = settle(slotted.filter(final).select(*keys, IDX, T, "v"))
    # bucket s looks at the mean of bucket s + 1, the last one at the last record
    means = (
        slotted.filter(F.col("_slot").between(first_slot + 1, tail) & (F.col(IDX) > 0))
        .groupBy(*keys, "_slot")
        .agg(F.avg(T).alias("_ct"), F.avg("v").alias("_cv"))
        .withColumn("_slot", F.col("_slot") - 1)
    )
    means = settle(means.unionByName(
        ends.select(*keys, F.lit(tail).cast("long").alias("_slot"), F.col(T).alias("_ct"), F.col("v").alias("_cv"))
    ))
    maps = _maps(corners.join(means, [*keys, "_slot"], "left"), keys, tail)
    start = begin.select(*keys, "_slot", IDX)
    taken = _chased(_reachable(maps, keys), start, keys, rows).unionByName(start)
    place = (F.col("_slot") - (first_slot - 1)).alias("pos")
    found = corners.join(taken, [*keys, "_slot", IDX], "left_semi").select(*keys, place, IDX, T, "v")
    # only the last bucket can be empty; the last record stands for it
    filled = found.groupBy(*keys).agg(F.max("pos").alias("_top"))
    last = ends.join(filled, keys).select(
        *keys, F.explode(F.sequence(F.col("_top") + 1, F.lit(target - 1).cast("long"))).alias("pos"), IDX, T, "v"
    )
    return found.unionByName(last)


def _maps(corners: DataFrame, keys: list[str], tail: int) -> DataFrame:
    """(keys, _slot, a, b): from corner a of a bucket the chain goes on to corner b of the next."""
    tasks = python_tasks(corners.sparkSession)
    rows = corners.withColumn(
        "_to", F.explode(F.array("_slot", F.when(F.col("_slot") < tail, F.col("_slot") + 1)))
    ).filter(F.col("_to").isNotNull())
    long = TYPES.LongType()
    schema = TYPES.StructType(
        [*[corners.schema[k] for k in keys], *[TYPES.StructField(c, long) for c in ("_slot", "a", "b")]]
    )
    fields = to_arrow_schema(schema)

    def step(key, table):
        table = table.sort_by(IDX)
        slots, i = table.column("_slot").to_numpy(), table.column(IDX).to_numpy()
        t, v = table.column(T).to_numpy(), table.column("v").to_numpy()
        to = key[-1].as_py()
        here, from_ = np.flatnonzero(slots == to), np.flatnonzero(slots < to)
        if not len(here) or not len(from_):
            return pa.Table.from_pylist([], schema=fields)
        centre = tuple(table.column(c).to_numpy()[here[0]] for c in ("_ct", "_cv"))
        best = _best((t[from_], v[from_]), centre, t[here], v[here])
        found = {"_slot": slots[from_], "a": i[from_], "b": i[here[best]]}
        named = dict(zip([*keys, "_to"], key))
        return pa.Table.from_arrays(
            [
                pa.array(found[f.name], type=f.type)
                if f.name in found
                else pa.repeat(named[f.name].cast(f.type), len(from_))
                for f in fields
            ],
            schema=fields,
        )

    dealt = rows.repartition(tasks, *keys, "_to").groupBy(*keys, "_to")
    return materialise(dealt.applyInArrow(step, schema), "maps")


def _reachable(maps: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose corner the map before can give; those of the first record stay."""
    image = maps.select(*keys, (F.col("_slot") + 1).alias("_slot"), F.col("b").alias("a")).distinct()
    first = maps.filter(F.col("a") == 0)
    return materialise(
        maps.filter(F.col("a") > 0).join(image, [*keys, "_slot", "a"], "left_semi").unionByName(first), "maps"
    )


def _chased(maps: DataFrame, begin: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """(keys, _slot, idx) of the chain from the first record through the maps."""
    sizes = settle(maps.groupBy(*keys).agg(F.count("*").alias("_maps")))
    few = sizes.filter(F.col("_maps") <= rows).drop("_maps")
    long = TYPES.LongType()
    schema = TYPES.StructType(
        [*[maps.schema[k] for k in keys], *[TYPES.StructField(c, long) for c in ("_slot", IDX)]]
    )
    fields = to_arrow_schema(schema)

    def follow(key, table):
        columns = (table.column(c).to_pylist() for c in ("_slot", "a", "b"))
        step = {(s, a): b for s, a, b in zip(*columns)}
        slot = min(s for s, _ in step)
        chain = [(slot, 0)]
        while chain[-1] in step:
            chain.append((chain[-1][0] + 1, step[chain[-1]]))
        found = dict(zip(("_slot", IDX), zip(*chain)))
        named = dict(zip(keys, key))
        return pa.Table.from_arrays(
            [
                pa.array(found[f.name], type=f.type)
                if f.name in found
                else pa.repeat(named[f.name].cast(f.type), len(chain))
                for f in fields
            ],
            schema=fields,
        )

    out = maps.join(few, keys, "left_semi").groupBy(*keys).applyInArrow(follow, schema)
    many = sizes.filter(F.col("_maps") > rows).select(*keys)
    if many.isEmpty():
        return out
    # maps over twice as many buckets, from buckets that are so far apart
    first = begin.agg(F.min("_slot")).first()[0]
    levels = [materialise(maps.join(many, keys, "left_semi"), "maps")]
    while not levels[-1].filter(F.col("_slot") > first).isEmpty():
        reach = 1 << (len(levels) - 1)
        even = F.pmod(F.col("_slot") - first, F.lit(2 * reach)) == 0
        next_ = levels[-1].select(
            *keys, (F.col("_slot") - reach).alias("_slot"), F.col("a").alias("b"), F.col("b").alias("_c")
        )
        joined = levels[-1].filter(even).join(next_, [*keys, "_slot", "b"])
        levels.append(materialise(joined.select(*keys, "_slot", "a", F.col("_c").alias("b")), "maps"))
    known = begin.join(many, keys, "left_semi")
    for level in range(len(levels) - 1, -1, -1):
        hop = levels[level].withColumnRenamed("a", IDX)
        more = known.join(hop, [*keys, "_slot", IDX]).select(
            *keys, (F.col("_slot") + (1 << level)).alias("_slot"), F.col("b").alias(IDX)
        )
        known = materialise(known.unionByName(more), "chain")
    return out.unionByName(known)


def chart_series(
    records: DataFrame,
    value: str,
    target: int = CHART_POINTS,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Overlay data of one channel: downsampled, then scaled to 0..1.

    At most ``target`` points per series are left, so a whole-series window is
    small.
    """
    points = lttb(records, value, target, keys, rows)
    w = Window.partitionBy(*keys)
    v = not_nan(F.col(value))
    low, high = F.min(v).over(w), F.max(v).over(w)
    return scale_to_unit(
        points.withColumns({"_lo": low, "_hi": high}), value, "normal"
    )


def chart_series_raw(records: DataFrame, value: str, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """Image-export data: all points; spreads under 1e-4 divide by 1."""
    limits = records.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = F.col("_hi") - F.col("_lo")
    span = F.when(F.abs(spread) < 1e-4, F.lit(1.0)).otherwise(spread)
    return (
        records.join(limits, list(keys))
        .withColumn("normal", (F.col(value) - F.col("_lo")) / span)
        .drop("_lo", "_hi")
    )
