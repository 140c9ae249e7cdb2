"""Aggregate and binning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.frame import CHANNEL, IDX, LOG, T, VALUE, rounded, to_samples
from telemetra.operators import binning, stats
from telemetra.plans.catalog import EVENTS_CTE, LINES_CTE, ORDERS_CTE, STREAM_CTE, query, r6
from telemetra.sources import tables

LINE = list(tables.LINE_CHANNELS)


def _event_values(spark, sf):
    """Events as unordered records: the aggregates need no record order."""
    ev = tables.read_table(spark, sf, "events")
    return ev.select(
        F.col("user_id").alias(LOG),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def _line_samples(spark, sf):
    return tables.line_values(spark, sf).unpivot([LOG], LINE, CHANNEL, VALUE)


_LINE_LONG = """s AS (
  SELECT l_suppkey AS log_id, c.channel, c.value FROM lineitem,
    LATERAL (VALUES ('quantity', l_quantity), ('extendedprice', l_extendedprice),
                    ('discount', l_discount), ('tax', l_tax)) c(channel, value))"""


@query(
    "describe_channels",
    f"""WITH {_LINE_LONG},
a AS (SELECT log_id, channel, count(value) AS n, avg(value) AS mean, median(value) AS median,
       coalesce(stddev_samp(value), 0) AS stdev, min(value) AS min, max(value) AS max
      FROM s GROUP BY ALL)
SELECT log_id, channel, n AS count, {r6('mean')} AS mean, {r6('median')} AS median,
  {r6('stdev')} AS stdev, min, max, {r6('max - min')} AS range,
  {r6('CASE WHEN abs(mean) > 2.220446049250313e-16 THEN stdev / abs(mean) * 100 ELSE 0 END')} AS cv
FROM a""",
)
def describe_channels(spark, sf):
    out = stats.describe(_line_samples(spark, sf), keys=(LOG, CHANNEL))
    return out.select(
        LOG, CHANNEL, "count",
        *[rounded(F.col(c)).alias(c) for c in ("mean", "median", "stdev")],
        "min", "max", rounded(F.col("range")).alias("range"), rounded(F.col("cv")).alias("cv"),
    )


@query(
    "channel_statistics",
    f"""WITH {_LINE_LONG}
SELECT log_id, channel, {r6('avg(value)')} AS mean, {r6('stddev_pop(value)')} AS stdev,
  min(value) AS min, max(value) AS max, {r6('max(value) - min(value)')} AS range
FROM s GROUP BY log_id, channel""",
)
def channel_statistics(spark, sf):
    out = stats.channel_statistics(_line_samples(spark, sf))
    return out.select(
        LOG, CHANNEL, *[rounded(F.col(c)).alias(c) for c in ("mean", "stdev")], "min", "max",
        rounded(F.col("range")).alias("range"),
    )


@query(
    "channel_min_max",
    f"WITH {_LINE_LONG} SELECT log_id, channel, min(value) AS min, max(value) AS max "
    "FROM s GROUP BY log_id, channel",
)
def channel_min_max(spark, sf):
    return stats.min_max(_line_samples(spark, sf))


@query(
    "channel_has_data",
    f"WITH {_LINE_LONG} SELECT log_id, channel, bool_or(abs(value) > 1e-4) AS has_data "
    "FROM s GROUP BY log_id, channel",
)
def channel_has_data(spark, sf):
    return stats.has_data(_line_samples(spark, sf))


@query(
    "median_large_logs",
    f"WITH {_LINE_LONG} SELECT log_id, channel, {r6('median(value)')} AS median FROM s GROUP BY log_id, channel",
)
def median_large_logs(spark, sf):
    """The rank path of the exact median: logs of over 100 values count as too large for a task."""
    out = stats.exact_median(_line_samples(spark, sf), VALUE, (LOG, CHANNEL), rows=100)
    return out.select(LOG, CHANNEL, rounded(F.col("median")).alias("median"))


_FIT = """f AS (
  SELECT log_id, count(*) AS n, avg(extendedprice) AS my, avg(quantity) AS mx,
    covar_pop(extendedprice, quantity) * count(*) AS sxy,
    var_pop(quantity) * count(*) AS sxx, var_pop(extendedprice) * count(*) AS syy
  FROM l GROUP BY log_id),
g AS (SELECT *, CASE WHEN sqrt(sxx * syy) > 2.220446049250313e-16
                     THEN sxy / sqrt(sxx * syy) ELSE 0 END AS r,
             CASE WHEN abs(sxx) > 2.220446049250313e-16 THEN sxy / sxx ELSE 0 END AS slope FROM f)"""


@query(
    "correlation",
    f"""WITH {LINES_CTE}, {_FIT}
SELECT log_id, n, {r6('r')} AS r, {r6('r * r')} AS r2, {r6('slope')} AS slope,
  {r6('my - slope * mx')} AS intercept,
  CASE WHEN abs(r) > 0.9 THEN 'very strong' WHEN abs(r) > 0.7 THEN 'strong'
       WHEN abs(r) > 0.5 THEN 'moderate' WHEN abs(r) > 0.3 THEN 'weak'
       ELSE 'very weak/none' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction FROM g""",
)
def correlation(spark, sf):
    fit = stats.linear_fit(tables.line_values(spark, sf), "quantity", "extendedprice")
    out = stats.correlation_labels(fit)
    return out.select(
        LOG, "n", *[rounded(F.col(c)).alias(c) for c in ("r", "r2", "slope", "intercept")],
        "strength", "direction",
    )


@query(
    "regression_residuals",
    f"""WITH {LINES_CTE}, {_FIT}
SELECT l.log_id, quantity, extendedprice,
  {r6('extendedprice - (slope * quantity + (my - slope * mx))')} AS residual
FROM l JOIN g USING (log_id)""",
)
def regression_residuals(spark, sf):
    out = stats.residuals(tables.line_values(spark, sf), "quantity", "extendedprice")
    return out.select(LOG, "quantity", "extendedprice", rounded(F.col("residual")).alias("residual"))


@query(
    "time_range",
    f"WITH {ORDERS_CTE} SELECT log_id, arg_min(t, idx) AS t_first, arg_max(t, idx) AS t_last "
    "FROM o GROUP BY log_id",
)
def time_range(spark, sf):
    return stats.time_range(tables.order_records(spark, sf))


@query(
    "overall_time_range",
    f"WITH {EVENTS_CTE}, b AS (SELECT arg_min(t, idx) AS f, arg_max(t, idx) AS l FROM e GROUP BY log_id) "
    "SELECT min(f) AS t_first, max(l) AS t_last FROM b",
)
def overall_time_range(spark, sf):
    return stats.overall_time_range(tables.event_records(spark, sf))


@query(
    "log_summary",
    f"""WITH {EVENTS_CTE},
a AS (SELECT log_id, 2 AS n_channels, count(*) AS n_records, max(t) AS d FROM e GROUP BY log_id)
SELECT log_id, n_channels, n_records, {r6('d')} AS duration,
  {r6('CASE WHEN d > 0 THEN n_records / d ELSE 0 END')} AS sample_rate FROM a""",
)
def log_summary(spark, sf):
    out = stats.log_summary(tables.event_records(spark, sf), ["value", "k"])
    return out.select(
        LOG, "n_channels", "n_records", rounded(F.col("duration")).alias("duration"),
        rounded(F.col("sample_rate")).alias("sample_rate"),
    )


@query(
    "jump_to_extremes",
    f"""WITH {EVENTS_CTE}
SELECT log_id, min(value) AS min_value, arg_min(idx, struct_pack(v := value, i := idx)) AS min_idx,
  {r6('arg_min(t, struct_pack(v := value, i := idx))')} AS min_t, max(value) AS max_value,
  arg_max(idx, struct_pack(v := value, i := idx)) AS max_idx,
  {r6('arg_max(t, struct_pack(v := value, i := idx))')} AS max_t
FROM e GROUP BY log_id""",
)
def jump_to_extremes(spark, sf):
    out = stats.extreme_records(tables.event_records(spark, sf), "value")
    return out.withColumns({c: rounded(F.col(c)) for c in ("min_t", "max_t")})


@query(
    "drift_baseline",
    f"""WITH {LINES_CTE},
b AS (SELECT log_id, quantity FROM l WHERE idx < greatest(floor(n * 10.0 / 100), 10))
SELECT log_id, count(*) AS baseline_n, {r6('avg(quantity)')} AS baseline_mean,
  {r6('greatest(coalesce(stddev_samp(quantity), 0), 0.001)')} AS baseline_stdev
FROM b GROUP BY log_id""",
)
def drift_baseline(spark, sf):
    out = stats.baseline(tables.line_records(spark, sf), "quantity")
    return out.withColumns(
        {c: rounded(F.col(c)) for c in ("baseline_mean", "baseline_stdev")}
    )


def _hist_sql(cte, src, x, y, cols, rows, extra="", where="", z=None, rule="floor"):
    if rule == "floor":
        def cell(v, a, n):
            return (
                f"least(CAST(floor(least(greatest(CAST(({v} - {a}_min) / {a}_range AS REAL), "
                f"CAST(0 AS REAL)), CAST(1 AS REAL)) * CAST({n} AS REAL)) AS INTEGER), {n - 1})"
            )
    else:
        def cell(v, a, n):
            return (
                f"least(CAST(round(({v} - {a}_min) / {a}_range * {n - 1}.0) AS INTEGER), {n - 1})"
            )
    zcol = f", {z} AS z" if z else ""
    return f"""WITH {cte},
b AS (SELECT log_id, min({x}) AS x_min, max({x}) AS x_max, min({y}) AS y_min, max({y}) AS y_max
      FROM {src} GROUP BY log_id),
r AS (SELECT *, CASE WHEN abs(x_max - x_min) < 2.220446049250313e-16 THEN 1.0 ELSE x_max - x_min END AS x_range,
             CASE WHEN abs(y_max - y_min) < 2.220446049250313e-16 THEN 1.0 ELSE y_max - y_min END AS y_range FROM b),
d AS (SELECT log_id, {cell(x, 'x', cols)} AS x_bin, {cell(y, 'y', rows)} AS y_bin{zcol}
      FROM {src} JOIN r USING (log_id) {where})
{extra}"""


_STREAM_VALUES = """e AS (SELECT CAST(0 AS BIGINT) AS log_id, value,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events)"""


@query(
    "hist2d_hits",
    _hist_sql(
        _STREAM_VALUES, "e", "value", "k", 32, 32,
        "SELECT log_id, y_bin, x_bin, count(*) AS hits, CAST(count(*) AS DOUBLE) AS value "
        "FROM d GROUP BY log_id, y_bin, x_bin",
    ),
)
def hist2d_hits(spark, sf):
    """All events as one log: hits per cell of value by k."""
    ev = _event_values(spark, sf).withColumn(LOG, F.lit(0).cast("long"))
    return binning.hist2d(ev, "value", "k")


@query(
    "hist2d_cell_statistics",
    _hist_sql(
        LINES_CTE, "l", "quantity", "discount", 16, 16, z="extendedprice",
        extra=f""", c AS (SELECT log_id, y_bin, x_bin, count(*) AS hits, avg(z) AS mean, sum(z) AS w,
  coalesce(var_samp(z), 0) AS vr, coalesce(stddev_samp(z), 0) AS sd, min(z) AS mn, max(z) AS mx
  FROM d GROUP BY log_id, y_bin, x_bin)
SELECT log_id, y_bin, x_bin, hits, {r6('mean')} AS value, {r6('w', 4)} AS weight, {r6('vr', -2)} AS variance,
  {r6('sd', 4)} AS stdev, mn AS minimum, mx AS maximum, hits < 3 AS masked,
  {r6('x_min + x_bin * (x_range / 16.0)')} AS x_low, {r6('x_min + x_bin * (x_range / 16.0) + x_range / 16.0')} AS x_high,
  {r6('y_min + y_bin * (y_range / 16.0)')} AS y_low, {r6('y_min + y_bin * (y_range / 16.0) + y_range / 16.0')} AS y_high
FROM c JOIN r USING (log_id)""",
    ),
)
def hist2d_cell_statistics(spark, sf):
    lines = tables.line_values(spark, sf)
    cells = binning.hist2d(
        lines, "quantity", "discount", "extendedprice", 16, 16, cell_stats=True
    )
    bounds = binning.axis_bounds(lines, "quantity", "discount")
    out = binning.with_mask(binning.with_cell_edges(cells, bounds, 16, 16), 3)
    places = {"value": 6, "weight": 4, "variance": -2, "stdev": 4,
              "x_low": 6, "x_high": 6, "y_low": 6, "y_high": 6}
    return out.withColumns({c: rounded(F.col(c), p) for c, p in places.items()})


@query(
    "hist2d_filtered",
    f"""WITH {LINES_CTE},
d AS (SELECT log_id, extendedprice AS z,
  least(CAST(floor(least(greatest(CAST((quantity - 5.0) / 40.0 AS REAL), CAST(0 AS REAL)), CAST(1 AS REAL)) * CAST(20 AS REAL)) AS INTEGER), 19) AS x_bin,
  least(CAST(floor(least(greatest(CAST((discount - y_min) / (y_max - y_min) AS REAL), CAST(0 AS REAL)), CAST(1 AS REAL)) * CAST(10 AS REAL)) AS INTEGER), 9) AS y_bin
  FROM l JOIN (SELECT log_id, min(discount) AS y_min, max(discount) AS y_max FROM l GROUP BY log_id) USING (log_id)
  WHERE quantity BETWEEN 5 AND 45 AND tax >= 0.02 AND extendedprice <= 80000)
SELECT log_id, y_bin, x_bin, count(*) AS hits, {r6('avg(z)')} AS value FROM d GROUP BY log_id, y_bin, x_bin""",
)
def hist2d_filtered(spark, sf):
    """Custom x limits, two active sample filters and one disabled."""
    filters = [
        binning.RangeFilter("tax", low=0.02),
        binning.RangeFilter("extendedprice", high=80000.0),
        binning.RangeFilter("quantity", low=30.0, enabled=False),
    ]
    cells = binning.hist2d(
        tables.line_values(spark, sf), "quantity", "discount", "extendedprice", 20, 10,
        x_limits=(5.0, 45.0), filters=filters,
    )
    return cells.withColumn("value", rounded(F.col("value")))


@query(
    "hist2d_rounded_bins",
    _hist_sql(
        LINES_CTE, "l", "quantity", "tax", 32, 16, z="extendedprice", rule="round",
        extra=f"SELECT log_id, y_bin, x_bin, count(*) AS hits, {r6('avg(z)')} AS value "
        "FROM d GROUP BY log_id, y_bin, x_bin",
    ),
)
def hist2d_rounded_bins(spark, sf):
    """The image-export rule: nearest grid line."""
    cells = binning.hist2d(
        tables.line_values(spark, sf), "quantity", "tax", "extendedprice", 32, 16, rule="round"
    )
    return cells.withColumn("value", rounded(F.col("value")))


@query(
    "density_grid",
    _hist_sql(
        _STREAM_VALUES, "e", "value", "k", 512, 512, rule="round",
        extra=f""", c AS (SELECT log_id, y_bin, x_bin, count(*) AS hits FROM d GROUP BY log_id, y_bin, x_bin),
m AS (SELECT *, max(hits) OVER (PARTITION BY log_id) AS max_hits FROM c)
SELECT log_id, y_bin, x_bin, hits, max_hits,
  {r6('CASE WHEN max_hits > 1 THEN ln(hits) / ln(max_hits) ELSE 1 END')} AS heat FROM m""",
    ),
)
def density_grid(spark, sf):
    ev = _event_values(spark, sf).withColumn(LOG, F.lit(0).cast("long"))
    return binning.density_grid(ev, "value", "k").withColumn("heat", rounded(F.col("heat")))


def _gaps_sql(columns, rows, rule, extra):
    """Cells of order lines where x or y is now and then missing or not a number."""

    def place(axis, bins):
        share = f"(({axis} - {axis}_min) / {axis}_range)"
        if rule == "floor":
            unit = f"least(greatest(CAST({share} AS REAL), CAST(0 AS REAL)), CAST(1 AS REAL))"
            cell = f"floor({unit} * CAST({bins} AS REAL))"
        else:
            cell = f"greatest(round({share} * {bins - 1}), 0)"
        return f"CASE WHEN isnan({axis}) THEN 0 ELSE least(CAST({cell} AS INTEGER), {bins - 1}) END AS {axis}_bin"

    return f"""WITH {LINES_CTE},
g AS (SELECT log_id, CASE WHEN idx % 7 = 3 THEN NULL WHEN idx % 11 = 5 THEN 'nan'::DOUBLE ELSE quantity END AS x,
  CASE WHEN idx % 13 = 4 THEN NULL WHEN idx % 17 = 6 THEN 'nan'::DOUBLE ELSE discount END AS y,
  CASE WHEN idx % 5 = 2 THEN NULL ELSE extendedprice END AS z FROM l),
r AS (SELECT log_id, min(x) FILTER (NOT isnan(x)) AS x_min, min(y) FILTER (NOT isnan(y)) AS y_min,
  max(x) FILTER (NOT isnan(x)) - min(x) FILTER (NOT isnan(x)) AS x_range,
  max(y) FILTER (NOT isnan(y)) - min(y) FILTER (NOT isnan(y)) AS y_range FROM g GROUP BY log_id),
d AS (SELECT log_id, z, {place('x', columns)}, {place('y', rows)} FROM g JOIN r USING (log_id)
  WHERE x IS NOT NULL AND y IS NOT NULL) {extra}"""


def _gaps(spark, sf):
    nan, none, idx = F.lit(float("nan")), F.lit(None), F.col(IDX)
    return tables.line_records(spark, sf).select(
        LOG, IDX, T,
        F.when(idx % 7 == 3, none).when(idx % 11 == 5, nan).otherwise(F.col("quantity")).alias("x"),
        F.when(idx % 13 == 4, none).when(idx % 17 == 6, nan).otherwise(F.col("discount")).alias("y"),
        F.when(idx % 5 == 2, none).otherwise(F.col("extendedprice")).alias("z"),
    )


_MEAN_CELLS = f"SELECT log_id, y_bin, x_bin, count(*) AS hits, {r6('avg(z)')} AS value FROM d GROUP BY log_id, y_bin, x_bin"


@query("hist2d_gaps", _gaps_sql(16, 12, "floor", _MEAN_CELLS))
def hist2d_gaps(spark, sf):
    """A sample without x or y is in no cell; one that is not a number falls into cell 0."""
    cells = binning.hist2d(_gaps(spark, sf), "x", "y", "z", 16, 12)
    return cells.withColumn("value", rounded(F.col("value")))


@query("hist2d_rounded_gaps", _gaps_sql(32, 16, "round", _MEAN_CELLS))
def hist2d_rounded_gaps(spark, sf):
    """The same by nearest grid line."""
    cells = binning.hist2d(_gaps(spark, sf), "x", "y", "z", 32, 16, rule="round")
    return cells.withColumn("value", rounded(F.col("value")))


@query(
    "density_grid_gaps",
    _gaps_sql(
        64, 64, "round",
        f""", c AS (SELECT log_id, y_bin, x_bin, count(*) AS hits FROM d GROUP BY log_id, y_bin, x_bin),
m AS (SELECT *, max(hits) OVER (PARTITION BY log_id) AS max_hits FROM c)
SELECT log_id, y_bin, x_bin, hits, max_hits,
  {r6('CASE WHEN max_hits > 1 THEN ln(hits) / ln(max_hits) ELSE 1 END')} AS heat FROM m""",
    ),
)
def density_grid_gaps(spark, sf):
    out = binning.density_grid(_gaps(spark, sf), "x", "y", binning.DENSITY_BINS_PRINT)
    return out.withColumn("heat", rounded(F.col("heat")))


@query(
    "density_grid_print",
    _hist_sql(
        LINES_CTE, "l", "quantity", "extendedprice", 64, 64, rule="round",
        extra=f""", c AS (SELECT log_id, y_bin, x_bin, count(*) AS hits FROM d GROUP BY log_id, y_bin, x_bin),
m AS (SELECT *, max(hits) OVER (PARTITION BY log_id) AS max_hits FROM c)
SELECT log_id, y_bin, x_bin, hits, max_hits,
  {r6('CASE WHEN max_hits > 1 THEN ln(hits) / ln(max_hits) ELSE 1 END')} AS heat FROM m""",
    ),
)
def density_grid_print(spark, sf):
    out = binning.density_grid(
        tables.line_values(spark, sf), "quantity", "extendedprice", binning.DENSITY_BINS_PRINT
    )
    return out.withColumn("heat", rounded(F.col("heat")))


@query(
    "grid_bounds_intensity",
    _hist_sql(
        LINES_CTE, "l", "quantity", "discount", 16, 16,
        extra=f""", c AS (SELECT log_id, y_bin, x_bin, count(*) AS hits FROM d GROUP BY log_id, y_bin, x_bin),
m AS (SELECT *, min(hits) OVER (PARTITION BY log_id) AS lo, max(hits) OVER (PARTITION BY log_id) AS hi FROM c)
SELECT log_id, y_bin, x_bin, hits, CAST(hits AS DOUBLE) AS value, CAST(lo AS DOUBLE) AS min_value,
  CAST(hi AS DOUBLE) AS max_value,
  {r6('CASE WHEN hi > 1 THEN ln(hits) / ln(hi) ELSE (hits - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END END')} AS intensity
FROM m""",
    ),
)
def grid_bounds_intensity(spark, sf):
    cells = binning.hist2d(tables.line_values(spark, sf), "quantity", "discount", columns=16, rows=16)
    shaded = binning.with_intensity(cells, by_hits=True)
    return shaded.join(binning.grid_bounds(cells), LOG).withColumn(
        "intensity", rounded(F.col("intensity"))
    )


@query(
    "cell_at_cursor",
    _hist_sql(
        EVENTS_CTE, "e", "value", "k", 16, 16,
        extra="""SELECT p.log_id, p.idx, p.x_bin, p.y_bin, h.hits FROM
 (SELECT e.log_id, e.idx, """
        + "least(CAST(floor(least(greatest(CAST((value - x_min) / x_range AS REAL), CAST(0 AS REAL)), CAST(1 AS REAL)) * CAST(16 AS REAL)) AS INTEGER), 15) AS x_bin, "
        + "least(CAST(floor(least(greatest(CAST((k - y_min) / y_range AS REAL), CAST(0 AS REAL)), CAST(1 AS REAL)) * CAST(16 AS REAL)) AS INTEGER), 15) AS y_bin "
        + """FROM e JOIN r USING (log_id)) p
 JOIN (SELECT log_id, x_bin, y_bin, count(*) AS hits FROM d GROUP BY ALL) h
 ON h.log_id = p.log_id AND h.x_bin = p.x_bin AND h.y_bin = p.y_bin""",
    ),
)
def cell_at_cursor(spark, sf):
    """The histogram cell under every record taken as the cursor."""
    rec = tables.event_records(spark, sf)
    cells = binning.hist2d(rec, "value", "k", columns=16, rows=16)
    bounds = binning.axis_bounds(rec, "value", "k")
    at = binning.cells_at_points(
        rec.select(LOG, IDX, F.col("value").alias("px"), F.col("k").alias("py")),
        cells, bounds, "px", "py", 16, 16,
    )
    return at.select(LOG, IDX, "x_bin", "y_bin", "hits")


@query(
    "scatter_cell_at_point",
    _hist_sql(
        LINES_CTE, "l", "quantity", "tax", 64, 64, rule="round",
        extra="""SELECT p.log_id, p.idx, p.x_bin, p.y_bin, h.hits FROM
 (SELECT l.log_id, l.idx, CAST(round((quantity - x_min) / x_range * 63.0) AS INTEGER) AS x_bin,
    CAST(round((tax - y_min) / y_range * 63.0) AS INTEGER) AS y_bin FROM l JOIN r USING (log_id)) p
 JOIN (SELECT log_id, x_bin, y_bin, count(*) AS hits FROM d GROUP BY ALL) h
 ON h.log_id = p.log_id AND h.x_bin = p.x_bin AND h.y_bin = p.y_bin""",
    ),
)
def scatter_cell_at_point(spark, sf):
    """The scatter cell (nearest grid line) under every record."""
    rec = tables.line_records(spark, sf)
    cells = binning.hist2d(rec, "quantity", "tax", columns=64, rows=64, rule="round")
    bounds = binning.axis_bounds(rec, "quantity", "tax")
    at = binning.cells_at_points(
        rec.select(LOG, IDX, F.col("quantity").alias("px"), F.col("tax").alias("py")),
        cells, bounds, "px", "py", 64, 64, "round",
    )
    return at.select(LOG, IDX, "x_bin", "y_bin", "hits")
