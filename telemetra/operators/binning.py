"""2-D binned tables over logs: hits, cell statistics, density grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemetra.frame import EPSILON, LOG, not_nan
from telemetra.session import settle

GRID_SIZES = (16, 32, 64)
DENSITY_BINS = 512
DENSITY_BINS_PRINT = 64


@dataclass(frozen=True)
class RangeFilter:
    """Keep samples whose channel lies in [low, high]; an open side is None."""

    channel: str
    low: float | None = None
    high: float | None = None
    enabled: bool = True

    def condition(self) -> Column:
        """NaN passes, as it fails neither comparison; a missing cell does not."""
        c = F.col(self.channel)
        keep = c.isNotNull()
        if self.low is not None:
            keep = keep & (F.isnan(c) | (c >= F.lit(float(self.low))))
        if self.high is not None:
            keep = keep & (F.isnan(c) | (c <= F.lit(float(self.high))))
        return keep


def apply_filters(df: DataFrame, filters: Sequence[RangeFilter]) -> DataFrame:
    """AND of all enabled filters."""
    for f in filters:
        if f.enabled:
            df = df.filter(f.condition())
    return df


def grid_shape(size: int = 32, columns: int = 0, rows: int = 0) -> tuple[int, int]:
    """(columns, rows): the custom sizes clamped to 4..256 if both are given."""
    if columns > 0 and rows > 0:
        return min(max(columns, 4), 256), min(max(rows, 4), 256)
    if size not in GRID_SIZES:
        raise ValueError(f"grid size must be one of {GRID_SIZES}")
    return size, size


def _usable(limits: tuple[float, float] | None) -> bool:
    return limits is not None and limits[1] > limits[0]


def axis_bounds(
    df: DataFrame,
    x: str,
    y: str,
    x_limits: tuple[float, float] | None = None,
    y_limits: tuple[float, float] | None = None,
    keys: Sequence[str] = (LOG,),
) -> DataFrame:
    """Per log: x_min, x_max, x_range, y_min, y_max, y_range (a zero range becomes 1)."""
    bounds = df.groupBy(*keys).agg(
        *[
            agg(not_nan(F.col(c))).alias(f"{axis}_{side}")
            for axis, c in (("x", x), ("y", y))
            for side, agg in (("min", F.min), ("max", F.max))
        ]
    )
    for axis, limits in (("x", x_limits), ("y", y_limits)):
        if _usable(limits):
            bounds = bounds.withColumns(
                {f"{axis}_min": F.lit(float(limits[0])), f"{axis}_max": F.lit(float(limits[1]))}
            )
        spread = F.col(f"{axis}_max") - F.col(f"{axis}_min")
        bounds = bounds.withColumn(
            f"{axis}_range", F.when(F.abs(spread) < EPSILON, F.lit(1.0)).otherwise(spread)
        )
    return bounds


def bin_of(value: Column, low: Column, span: Column, bins: int, rule: str) -> Column:
    """Cell number of a value.

    ``floor``: single-precision share of the axis, clamped to the edge cells.
    ``round``: nearest of ``bins`` grid lines, halves away from zero.
    A value that is not a number falls into cell 0; a missing one has no cell.
    """
    share = (value - low) / span
    if rule == "floor":
        unit = F.least(
            F.greatest(share.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float")
        )
        cell = F.floor(unit * F.lit(float(bins)).cast("float"))
    elif rule == "round":
        cell = F.greatest(F.round(share * F.lit(float(bins - 1))), F.lit(0.0))
    else:
        raise ValueError(f"unknown bin rule {rule!r}")
    inside = F.least(cell.cast("double"), F.lit(float(bins - 1))).cast("int")
    return F.when(F.isnan(share), F.lit(0)).when(share.isNotNull(), inside)


def hist2d(
    df: DataFrame,
    x: str,
    y: str,
    z: str | None = None,
    columns: int = 32,
    rows: int = 32,
    x_limits: tuple[float, float] | None = None,
    y_limits: tuple[float, float] | None = None,
    filters: Sequence[RangeFilter] = (),
    rule: str = "floor",
    clamp_outside: bool = False,
    cell_stats: bool = False,
    keys: Sequence[str] = (LOG,),
) -> DataFrame:
    """Non-empty cells per log: hits, value, and with ``cell_stats`` the z spread.

    Bounds come from all samples, before any filter.  Samples outside custom
    limits are left out unless ``clamp_outside`` puts them into the edge cells.
    Samples that lack x or y are in no cell; ``hits`` counts samples that lack z too.
    ``value`` is the mean of z, or the hits when no z is given.  The grouping is
    map-side combined, so a hot log costs one partial row per cell and task.
    """
    keys = list(keys)
    bounds = settle(axis_bounds(df, x, y, x_limits, y_limits, keys))
    narrow = list(dict.fromkeys([*keys, x, y, *([z] if z else [])]))
    placed = F.col(x).isNotNull() & F.col(y).isNotNull()
    data = apply_filters(df, filters).filter(placed).select(*narrow).join(bounds, keys)
    if not clamp_outside:
        for axis, c, limits in (("x", x, x_limits), ("y", y, y_limits)):
            if limits is not None:
                v = F.col(c)
                data = data.filter(
                    F.isnan(v) | v.between(F.col(f"{axis}_min"), F.col(f"{axis}_max"))
                )
    data = data.withColumns(
        {
            "x_bin": bin_of(F.col(x), F.col("x_min"), F.col("x_range"), columns, rule),
            "y_bin": bin_of(F.col(y), F.col("y_min"), F.col("y_range"), rows, rule),
        }
    )
    aggs = [F.count(F.lit(1)).alias("hits")]
    if z:
        aggs.append(F.avg(z).alias("value"))
        if cell_stats:
            aggs += [
                F.sum(z).alias("weight"),
                F.coalesce(F.var_samp(z), F.lit(0.0)).alias("variance"),
                F.coalesce(F.stddev_samp(z), F.lit(0.0)).alias("stdev"),
                F.min(not_nan(F.col(z))).alias("minimum"),
                F.max(not_nan(F.col(z))).alias("maximum"),
            ]
    cells = data.groupBy(*keys, "y_bin", "x_bin").agg(*aggs)
    if not z:
        cells = cells.withColumn("value", F.col("hits").cast("double"))
    return cells


def with_cell_edges(
    cells: DataFrame, bounds: DataFrame, columns: int, rows: int, keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """Add the axis ranges x_low, x_high, y_low, y_high of each cell."""
    out = cells.join(bounds, list(keys))
    for axis, bins in (("x", columns), ("y", rows)):
        width = F.col(f"{axis}_range") / F.lit(float(bins))
        low = F.col(f"{axis}_min") + F.col(f"{axis}_bin") * width
        out = out.withColumns({f"{axis}_low": low, f"{axis}_high": low + width})
    return out.drop(*[f"{a}_{s}" for a in "xy" for s in ("min", "max", "range")])


def grid_bounds(cells: DataFrame, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """Smallest and largest cell value per log, masked cells included."""
    return cells.groupBy(*keys).agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


def with_mask(cells: DataFrame, min_hits: int) -> DataFrame:
    """Flag cells with too few hits; zero keeps all."""
    return cells.withColumn("masked", F.col("hits") < F.lit(min_hits))


def with_intensity(cells: DataFrame, by_hits: bool, keys: Sequence[str] = (LOG,)) -> DataFrame:
    """0..1 shade: logarithmic for hit counts, linear for means."""
    out = cells.join(grid_bounds(cells, keys), list(keys))
    spread = F.col("max_value") - F.col("min_value")
    linear = (F.col("value") - F.col("min_value")) / F.when(
        F.abs(spread) < EPSILON, F.lit(1.0)
    ).otherwise(spread)
    shade = linear
    if by_hits:
        shade = F.when(
            F.col("max_value") > 1, F.try_divide(F.ln("value"), F.ln("max_value"))
        ).otherwise(linear)
    return out.withColumn(
        "intensity", F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0))
    ).drop("min_value", "max_value")


def density_grid(
    df: DataFrame, x: str, y: str, bins: int = DENSITY_BINS, keys: Sequence[str] = (LOG,)
) -> DataFrame:
    """Scatter density: hits per grid point, max hits of the log, log-scaled heat."""
    cells = hist2d(df, x, y, columns=bins, rows=bins, rule="round", keys=keys).drop("value")
    peak = cells.groupBy(*keys).agg(F.max("hits").alias("max_hits"))
    heat = F.when(
        F.col("max_hits") > 1, F.ln(F.col("hits")) / F.ln(F.col("max_hits"))
    ).otherwise(F.lit(1.0))
    return cells.join(peak, list(keys)).withColumn("heat", heat)


def cells_at_points(
    points: DataFrame,
    cells: DataFrame,
    bounds: DataFrame,
    x: str,
    y: str,
    columns: int,
    rows: int,
    rule: str = "floor",
    keys: Sequence[str] = (LOG,),
) -> DataFrame:
    """Look up the cell under each point; points off the axes are dropped.

    An empty cell gives hits 0 and a NULL value.
    """
    keys = list(keys)
    located = points.join(bounds, keys)
    for axis, c, bins in (("x", x, columns), ("y", y, rows)):
        share = (F.col(c) - F.col(f"{axis}_min")) / F.col(f"{axis}_range")
        located = located.filter(share.cast("float").between(0.0, 1.0)).withColumn(
            f"{axis}_bin",
            bin_of(F.col(c), F.col(f"{axis}_min"), F.col(f"{axis}_range"), bins, rule),
        )
    located = located.drop(*[f"{a}_{s}" for a in "xy" for s in ("min", "max", "range")])
    picked = cells.select(*keys, "y_bin", "x_bin", "hits", "value")
    return located.join(picked, [*keys, "y_bin", "x_bin"], "left").withColumn(
        "hits", F.coalesce("hits", F.lit(0).cast("long"))
    )
