"""The shared sample model.

``records``  log_id, idx, t, <one double column per channel>      (wide)
``samples``  log_id, idx, t, channel, value                       (long)

``idx`` is the dense zero-based record number inside a log.  A missing cell is
NULL; the zero fills of individual operators are applied by those operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "log_id"
IDX = "idx"
T = "t"
CHANNEL = "channel"
VALUE = "value"
EPSILON = 2.220446049250313e-16


def is_finite(c: Column) -> Column:
    """True for an ordinary number; false for NaN and infinities, NULL for NULL."""
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def not_nan(c: Column) -> Column:
    """NULL in place of NaN, because Spark ranks NaN above every number."""
    return F.when(~F.isnan(c), c)


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and infinities become 0.0."""
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def rounded(c: Column, places: int = 6) -> Column:
    """Rounded for reports.

    Means of short decimals often lie exactly half way, where the order of
    summation decides; the nudge of 0.003 units takes that chance away.  Adding
    0.0 turns a negative zero into zero.
    """
    return F.round(c + F.lit(0.003 * 10.0**-places), places) + F.lit(0.0)


def channel_columns(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c not in (LOG, IDX, T)]


def to_samples(records: DataFrame, channels: Sequence[str] | None = None) -> DataFrame:
    """Wide to long; one output row per record and channel, no shuffle."""
    names = list(channels or channel_columns(records))
    return records.unpivot([LOG, IDX, T], names, CHANNEL, VALUE)


def to_records(samples: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Long to wide for an explicit channel list (one partially aggregated groupBy)."""
    picks = [
        F.max(F.when(F.col(CHANNEL) == name, F.col(VALUE))).alias(name) for name in channels
    ]
    return samples.groupBy(LOG, IDX, T).agg(*picks)


def append_channel(samples: DataFrame, derived: DataFrame, name: str, value: str) -> DataFrame:
    """Add a derived series to a long frame under a new channel name."""
    extra = derived.select(LOG, IDX, T, F.lit(name).alias(CHANNEL), F.col(value).alias(VALUE))
    return samples.unionByName(extra)


def union_logs(*frames: DataFrame) -> DataFrame:
    """Records of several formats in one frame; absent channels become NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
