"""Per-log and per-channel aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemetra.frame import CHANNEL, EPSILON, IDX, LOG, T, VALUE, is_finite, not_nan
from telemetra.operators.layout import CHUNK_ROWS, order_buckets
from telemetra.session import materialise, settle


def exact_median(
    df: DataFrame, value: str, keys: Sequence[str] = (LOG,), rows: int = CHUNK_ROWS
) -> DataFrame:
    """Mean of the one or two middle values per key; NULL if a key has none.

    Values of a key with at most ``rows`` of them are sorted where they meet.  The few
    larger keys, whose values must not meet in one task, are ranked in buckets.
    """
    keys = list(keys)
    counts = settle(df.groupBy(*keys).agg(F.count(value).alias("_n")))
    found = _medians(df.filter(F.col(value).isNotNull()), counts, value, keys, rows)
    return counts.select(*keys).join(found, keys, "left")


def _medians(
    df: DataFrame, counts: DataFrame, value: str, keys: list[str], rows: int
) -> DataFrame:
    """Medians of values whose numbers ``_n`` by key are known and read back."""
    large = counts.filter(F.col("_n") > rows).select(*keys)
    if large.isEmpty():
        return _sorted_median(df, counts, value, keys)
    small = _sorted_median(df.join(large, keys, "left_anti"), counts, value, keys)
    return small.unionByName(_ranked_median(df.join(large, keys, "left_semi"), value, keys, rows))


def _sorted_median(df: DataFrame, counts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    placed = df.select(*keys, F.col(value).cast("double").alias("_v")).withColumn(
        "_p", F.row_number().over(Window.partitionBy(*keys).orderBy("_v"))
    )
    middle = (2 * F.col("_p")).between(F.col("_n"), F.col("_n") + 2)
    return placed.join(counts, keys).filter(middle).groupBy(*keys).agg(F.avg("_v").alias("median"))


def _ranked_median(df: DataFrame, value: str, keys: list[str], rows: int) -> DataFrame:
    """Median by rank: values are counted once (map-side combined), the distinct ones
    put into order-preserving buckets, and only buckets with a middle rank sorted.
    """
    counts = materialise(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m")),
        "counted",
    )
    edges = order_buckets(counts, F.col(value), keys, rows)
    bucketed = edges.assign(counts, F.col(value), "_b")
    per_bucket = bucketed.groupBy(*keys, "_b").agg(F.sum("_m").alias("_rows"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    ranks = (
        per_bucket.withColumn("_n", F.sum("_rows").over(w))
        .withColumn("_end", F.sum("_rows").over(upto))
        .withColumn("_base", F.col("_end") - F.col("_rows"))
        .withColumn("_lo_rank", F.floor((F.col("_n") - 1) / 2))
        .withColumn("_hi_rank", F.floor(F.col("_n") / 2))
        .filter((F.col("_base") <= F.col("_hi_rank")) & (F.col("_end") > F.col("_lo_rank")))
        .select(*keys, "_b", "_base", "_lo_rank", "_hi_rank")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = (
        bucketed.join(ranks, [*keys, "_b"])
        .withColumn("_to", F.col("_base") + F.sum("_m").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_m"))
    )

    def at(rank: str) -> Column:
        hit = (F.col("_from") <= F.col(rank)) & (F.col("_to") > F.col(rank))
        return F.max(F.when(hit, F.col(value)))

    return ranked.groupBy(*keys).agg(((at("_lo_rank") + at("_hi_rank")) / 2.0).alias("median"))


def _moments(value: str) -> list[Column]:
    return [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"),
        F.min(not_nan(F.col(value))).alias("min"),
        F.max(not_nan(F.col(value))).alias("max"),
    ]


def describe(
    df: DataFrame,
    value: str = VALUE,
    keys: Sequence[str] = (LOG,),
    median: bool = True,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """count, mean, median, sample stdev, min, max, range and cv percent per key."""
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    out = present.groupBy(*keys).agg(*_moments(value))
    if median:  # the moments say how many values there are, and so which are in the middle
        out = settle(out)
        counts = out.select(*keys, F.col("count").alias("_n"))
        out = out.join(_medians(present, counts, value, keys, rows), keys)
    out = out.withColumn("range", F.col("max") - F.col("min"))
    return out.withColumn(
        "cv",
        F.when(
            F.abs("mean") > EPSILON, F.col("stdev") / F.abs("mean") * 100.0
        ).otherwise(F.lit(0.0)),
    )


def channel_statistics(
    samples: DataFrame, keys: Sequence[str] = (LOG, CHANNEL), value: str = VALUE
) -> DataFrame:
    """mean, population stdev, min, max, range of the finite values; none gives zeros."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    out = samples.groupBy(*keys).agg(
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("stdev"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )
    out = out.withColumn("range", F.col("max") - F.col("min"))
    return out.fillna(0.0, ["mean", "stdev", "min", "max", "range"])


def min_max(samples: DataFrame, keys: Sequence[str] = (LOG, CHANNEL), value: str = VALUE) -> DataFrame:
    """Smallest and largest value per channel, NaN ignored."""
    v = not_nan(F.col(value))
    return samples.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"))


def has_data(samples: DataFrame, keys: Sequence[str] = (LOG, CHANNEL), value: str = VALUE) -> DataFrame:
    """True for a channel with any magnitude above 1e-4."""
    live = F.abs(not_nan(F.col(value))) > 1e-4
    return samples.groupBy(*keys).agg(F.coalesce(F.max(live), F.lit(False)).alias("has_data"))


def time_range(records: DataFrame, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """Time of the first and of the last record per log (by position)."""
    return records.groupBy(*keys).agg(
        F.min_by(T, IDX).alias("t_first"), F.max_by(T, IDX).alias("t_last")
    )


def overall_time_range(records: DataFrame) -> DataFrame:
    return time_range(records).agg(
        F.min("t_first").alias("t_first"), F.max("t_last").alias("t_last")
    )


def linear_fit(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """n, Pearson r and r2, regression slope and intercept of y on x per log.

    A zero spread gives r = 0 and slope = 0 instead of a division error.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        (F.covar_pop(x, y) * F.count(F.lit(1))).alias("_sxy"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("_sxx"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_syy"),
    )
    scale = F.sqrt(F.col("_sxx") * F.col("_syy"))
    slope = F.when(F.abs("_sxx") > EPSILON, F.try_divide("_sxy", "_sxx")).otherwise(F.lit(0.0))
    return (
        sums.withColumn(
            "r",
            F.when(
                (F.col("n") >= 2) & (scale > EPSILON), F.try_divide(F.col("_sxy"), scale)
            ).otherwise(F.lit(0.0)),
        )
        .withColumn("r2", F.col("r") * F.col("r"))
        .withColumn("slope", slope)
        .withColumn("intercept", F.col("_my") - F.col("slope") * F.col("_mx"))
        .drop("_mx", "_my", "_sxy", "_sxx", "_syy")
    )


def correlation_labels(fit: DataFrame) -> DataFrame:
    """Strength and direction words for r."""
    size = F.abs("r")
    strength = (
        F.when(size > 0.9, "very strong")
        .when(size > 0.7, "strong")
        .when(size > 0.5, "moderate")
        .when(size > 0.3, "weak")
        .otherwise("very weak/none")
    )
    return fit.withColumn("strength", strength).withColumn(
        "direction", F.when(F.col("r") > 0, "positive").otherwise("negative")
    )


def residuals(
    df: DataFrame, x: str, y: str, out: str = "residual", keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """y minus its regression on x, per record; logs under two records have none."""
    fit = linear_fit(df, x, y, keys).filter(F.col("n") >= 2)
    line = settle(
        fit.select(*keys, F.col("slope").alias("_slope"), F.col("intercept").alias("_icpt"))
    )
    return (
        df.join(line, list(keys))
        .withColumn(out, F.col(y) - (F.col("_slope") * F.col(x) + F.col("_icpt")))
        .drop("_slope", "_icpt")
    )


def baseline(
    records: DataFrame,
    value: str,
    percent: float = 10.0,
    keys: Sequence[str] = (LOG,),
    size: str = "n",
) -> DataFrame:
    """Mean and sample stdev of the first ``percent`` of each log, ten records at least.

    Needs ``idx`` and the log size column; one pass, map-side combined.
    """
    length = F.greatest(
        F.floor(F.col(size).cast("double") * F.lit(percent) / 100.0), F.lit(10).cast("long")
    )
    return (
        records.filter(F.col(IDX) < length)
        .groupBy(*keys)
        .agg(
            F.count(value).alias("baseline_n"),
            F.avg(value).alias("baseline_mean"),
            F.greatest(
                F.coalesce(F.stddev_samp(value), F.lit(0.0)), F.lit(0.001)
            ).alias("baseline_stdev"),
        )
    )


def preview_stats(
    records: DataFrame, value: str, count: int = 100, keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """min, max, mean over the finite ones of the first ``count`` values of each log."""
    v = F.when(is_finite(F.col(value)), F.col(value))
    return (
        records.filter(F.col(IDX) < count)
        .groupBy(*keys)
        .agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    )


def extreme_records(records: DataFrame, value: str, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """Record and time of the first minimum and of the last maximum, finite values only."""
    finite = records.filter(is_finite(F.col(value)))
    at = F.struct(F.col(value), F.col(IDX), F.col(T))
    return (
        finite.groupBy(*keys)
        .agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        .select(
            *keys,
            F.col(f"_lo.{value}").alias("min_value"),
            F.col(f"_lo.{IDX}").alias("min_idx"),
            F.col(f"_lo.{T}").alias("min_t"),
            F.col(f"_hi.{value}").alias("max_value"),
            F.col(f"_hi.{IDX}").alias("max_idx"),
            F.col(f"_hi.{T}").alias("max_t"),
        )
    )


def log_summary(
    records: DataFrame, channels: Sequence[str], keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """Channel count, record count, duration and mean sample rate per log."""
    present = [F.max(F.col(c).isNotNull().cast("int")) for c in channels]
    total = present[0]
    for p in present[1:]:
        total = total + p
    duration = F.max_by(T, IDX) - F.min_by(T, IDX)
    out = records.groupBy(*keys).agg(
        total.alias("n_channels"), F.count(F.lit(1)).alias("n_records"), duration.alias("duration")
    )
    rate = F.when(
        F.col("duration") > 0, F.try_divide(F.col("n_records"), F.col("duration"))
    ).otherwise(F.lit(0.0))
    return out.withColumn("sample_rate", rate)
