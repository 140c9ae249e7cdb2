"""Nearest-in-time lookup and rate merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T
from telemetra.operators.layout import CHUNK_ROWS, fits_chunk, order_buckets, with_record_index
from telemetra.session import materialise, settle


def nearest_record(
    questions: DataFrame,
    records: DataFrame,
    at: str,
    columns: Sequence[str],
    tie: str = "earlier",
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    prefix: str = "near_",
) -> DataFrame:
    """Attach to each question the record of its log whose time is nearest to ``at``.

    Questions before the first or after the last record get that end record, questions
    without a time the first; of records that share a time the first answers for that time
    and those before it, the last for those after it.  ``tie`` says which side wins at equal
    distance.

    Records and questions are laid out as one ordered series, which is shuffled and sorted
    once; the record before and the one after a question are read off it in one pass.
    Logs of up to ``rows`` of both are one piece.  Longer ones are cut into buckets of
    bounded size by what both hold, so neither a long log nor many questions at one time
    end up in one task; each bucket gets copies of the records next to its edges.
    """
    if tie not in ("earlier", "later"):
        raise ValueError(f"unknown tie rule {tie!r}")
    keys = list(keys)
    payload = [c for c in questions.columns if c not in keys]
    cell = F.struct(F.col(T).alias("t"), F.col(IDX).alias("i"), *[F.col(c) for c in columns])
    facts = records.filter(F.col(T).isNotNull()).select(
        *keys, F.col(T).cast("double").alias("_x"), F.lit(1).alias("_kind"), F.col(IDX).alias("_i"), cell.alias("_d")
    )
    asked = questions.select(
        *keys, F.col(at).cast("double").alias("_x"), F.lit(0).alias("_kind"), F.struct(*payload).alias("_q")
    )
    series = facts.unionByName(asked, allowMissingColumns=True)
    parts = list(keys)
    sizes = settle(
        series.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum("_kind").alias("_facts"))
    )
    if (sizes.agg(F.max("_rows")).first()[0] or 0) > rows:
        series = _bucketed(series, sizes, keys, rows)
        parts.append("_b")
    quoted = ", ".join(f"`{k}`" for k in parts)
    order = "_x, _kind, _i"
    so_far = Window.partitionBy(*parts).orderBy(*order.split(", ")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    met = series.withColumns(
        {
            "_p": F.last("_d", ignorenulls=True).over(so_far),
            "_n": F.expr(f"lead(_d) IGNORE NULLS OVER (PARTITION BY {quoted} ORDER BY {order})"),
        }
    ).filter(F.col("_q").isNotNull())
    back, ahead = F.abs(F.col("_x") - F.col("_p.t")), F.abs(F.col("_n.t") - F.col("_x"))
    earlier_wins = back <= ahead if tie == "earlier" else back < ahead
    before = F.col("_n").isNull() | (F.col("_p").isNotNull() & earlier_wins)
    return met.withColumn("_hit", F.when(before, F.col("_p")).otherwise(F.col("_n"))).select(
        *keys,
        *[F.col(f"_q.{c}").alias(c) for c in payload],
        F.col("_hit.i").alias(f"{prefix}idx"),
        F.col("_hit.t").alias(f"{prefix}t"),
        *[F.col(f"_hit.{c}").alias(f"{prefix}{c}") for c in columns],
    )


def _bucketed(series: DataFrame, sizes: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The series with buckets ``_b``, and in each the records next to its edges.

    Rows of one time are cut by a number that puts its questions before its records, as
    their order does: questions are dealt by hash, records by ``idx``.
    """
    dealt = F.pmod(F.xxhash64("_q"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.when(F.col("_kind") == 1, F.col("_i").cast("double")).otherwise(
        -1.0 - dealt * F.coalesce("_facts", F.lit(0))
    )
    tied = series.join(sizes.drop("_rows"), keys, "left").withColumn("_place", place)
    edges = order_buckets(tied, F.col("_x"), keys, rows, F.col("_place"))
    cut = edges.assign(tied, F.col("_x"), "_b", F.col("_place")).drop("_place", "_facts")
    rank = F.when(F.col("_kind") == 1, F.struct("_x", "_i"))
    ends = cut.groupBy(*keys, "_b").agg(
        F.min_by("_d", rank).alias("_first"), F.max_by("_d", rank).alias("_last")
    )
    over = Window.partitionBy(*keys)
    before = over.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    after = over.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = ends.select(
        *keys, "_b",
        F.last("_last", ignorenulls=True).over(before).alias("_left"),
        F.last("_first", ignorenulls=True).over(after).alias("_right"),
    )
    near = near.select(*keys, "_b", F.explode(F.array("_left", "_right")).alias("_d"))
    near = near.filter(F.col("_d").isNotNull())
    copies = settle(near).select(
        *keys, "_b", F.col("_d.t").cast("double").alias("_x"), F.lit(1).alias("_kind"), F.col("_d.i").alias("_i"), "_d"
    )
    return cut.unionByName(copies, allowMissingColumns=True)


def time_shift(
    records: DataFrame,
    columns: dict[str, str],
    seconds: float,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    onto: DataFrame | None = None,
) -> DataFrame:
    """Add ``{new: channel}``: the channel at the record nearest to t + seconds.

    ``onto`` is a frame derived from the records that gets the columns instead.
    """
    source = list(dict.fromkeys(columns.values()))
    target = records if onto is None else onto
    asked = target.withColumn("_at", F.col(T) + F.lit(float(seconds)))
    out = nearest_record(asked, records, "_at", source, "earlier", keys, rows, "_near_")
    out = out.withColumns({new: F.col(f"_near_{c}") for new, c in columns.items()})
    return out.drop("_at", "_near_idx", "_near_t", *[f"_near_{c}" for c in source])


def merge_rates(
    points: DataFrame,
    channels: Sequence[str],
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
    max_records: int | None = None,
) -> DataFrame:
    """One timeline from channels sampled at their own rates.

    ``points`` holds log, channel, t, value (and ``seq`` to settle equal times).
    Each distinct time of a log becomes a record; every channel shows its value
    at or before that time, before its first sample that first value, and 0.0
    if it has no samples.  The row cap is off unless asked for.
    """
    keys = list(keys)
    tie = "seq" if "seq" in points.columns else "value"
    wide = points.groupBy(*keys, T).agg(
        *[
            F.min_by("value", F.when(F.col("channel") == c, F.col(tie))).alias(c)
            for c in channels
        ]
    )
    wide = materialise(wide, "timeline")  # counted first, then read once or four times
    if fits_chunk(wide, keys, rows):
        log = Window.partitionBy(*keys)
        inside = log.orderBy(T)
        so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
        whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        last = {c: F.last(c, ignorenulls=True).over(so_far) for c in channels}
        first = {c: F.first(c, ignorenulls=True).over(whole) for c in channels}
        filled = wide.withColumns(
            {
                IDX: (F.row_number().over(inside) - 1).cast("long"),
                "_t0": F.min(T).over(log),
                **{c: F.coalesce(last[c], first[c], F.lit(0.0)) for c in channels},
            }
        )
        if max_records is not None:
            filled = filled.filter(F.col(IDX) < max_records)
        return filled.withColumn(T, (F.col(T) - F.col("_t0")).cast("double")).drop("_t0")
    held = with_record_index(wide, [T], keys, rows, hold=channels)
    if max_records is not None:
        held = held.filter(F.col(IDX) < max_records)
    # The first sample overall also stands in for earlier times.
    firsts = wide.groupBy(*keys).agg(
        F.min(T).alias("_t0"),
        *[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.col(T))).alias(f"_first_{c}")
            for c in channels
        ],
    )
    filled = held.join(settle(firsts), keys).withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_first_{c}"), F.lit(0.0)) for c in channels}
    )
    return filled.withColumn(T, (F.col(T) - F.col("_t0")).cast("double")).drop(
        "_t0", *[f"_first_{c}" for c in channels]
    )


def plausible_points(points: DataFrame) -> DataFrame:
    """Drop points with a time outside 0..1e5 s or a value that is no sane number."""
    v = F.col("value")
    return points.filter(
        (F.col(T) >= 0) & (F.col(T) < 100000.0) & ~F.isnan(v) & (F.abs(v) < 1e10)
    )
