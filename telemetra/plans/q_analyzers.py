"""Every registered analysis over table logs, with its summary and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T, rounded
from telemetra.operators.names import channel_list
from telemetra.plans.analyzers import Registry
from telemetra.plans.catalog import EVENTS_CTE, LINES_CTE, query, r6
from telemetra.plans.q_formula import _MIX, mixture_records
from telemetra.plans.q_series import _DRIFT
from telemetra.sources import tables

EPS = "2.220446049250313e-16"


def _round(df, *names, places=6):
    return df.withColumns({n: rounded(F.col(n), places) for n in names})


def _report(outcome, *names):
    """Summary with the finding codes of each log as one sorted text."""
    codes = outcome.findings.groupBy(LOG).agg(
        F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes")
    )
    both = outcome.summary.join(codes, LOG, "full")
    return _round(both, *names).withColumn("codes", F.coalesce("codes", F.lit("")))


@query(
    "analyze_descriptive_stats",
    f"""WITH {LINES_CTE}, s AS (SELECT log_id, count(*) AS count, avg(discount) AS mean, median(discount) AS median,
  stddev_samp(discount) AS stdev, min(discount) AS min, max(discount) AS max FROM l GROUP BY log_id)
SELECT log_id, count, {r6('mean')} AS mean, {r6('median')} AS median, {r6('stdev')} AS stdev, min, max,
  {r6('max - min')} AS range, {r6('stdev / mean * 100')} AS cv,
  CASE WHEN stdev / mean * 100 > 50 THEN 'high_variability' ELSE '' END AS codes FROM s""",
)
def analyze_descriptive_stats(spark, sf):
    got = Registry().run("descriptive_stats", tables.line_records(spark, sf), channel="discount")
    return _report(got, "mean", "median", "stdev", "range", "cv")


@query(
    "analyze_correlation",
    f"""WITH {LINES_CTE}, s AS (SELECT log_id, count(*) AS n, covar_pop(extendedprice, quantity) * count(*) AS sxy,
  var_pop(quantity) * count(*) AS sxx, var_pop(extendedprice) * count(*) AS syy FROM l GROUP BY log_id)
SELECT log_id, n, {r6('sxy / sqrt(sxx * syy)')} AS r, CASE WHEN abs(sxy / sqrt(sxx * syy)) > 0.9 THEN 'very strong'
  WHEN abs(sxy / sqrt(sxx * syy)) > 0.7 THEN 'strong' WHEN abs(sxy / sqrt(sxx * syy)) > 0.5 THEN 'moderate'
  WHEN abs(sxy / sqrt(sxx * syy)) > 0.3 THEN 'weak' ELSE 'very weak/none' END AS strength, 'correlation' AS codes FROM s""",
)
def analyze_correlation(spark, sf):
    got = Registry().run(
        "correlation", tables.line_records(spark, sf), channel_x="quantity", channel_y="extendedprice"
    )
    return _report(got, "r").select(LOG, "n", "r", "strength", "codes")


@query(
    "analyze_fuel_trim_drift",
    f"""{_DRIFT}, y AS (SELECT log_id, count(*) AS n, CAST(sum((drift > 0.5)::INT) AS BIGINT) AS high, CAST(sum((drift < -0.5)::INT) AS BIGINT) AS low FROM f GROUP BY log_id)
SELECT log_id, n, high, low, array_to_string(list_filter([CASE WHEN low > n // 20 THEN 'negative_drift' END, CASE WHEN high > n // 20 THEN 'positive_drift' END], lambda x: x IS NOT NULL), ',') AS codes FROM y""",
)
def analyze_fuel_trim_drift(spark, sf):
    got = Registry().run("fuel_trim_drift", tables.line_records(spark, sf), channel="QUANTITY")
    return _report(got).select(LOG, "n", "high", "low", "codes")


@query(
    "analyze_short_logs",
    """SELECT user_id AS log_id, CASE WHEN count(*) < 70 THEN 'too_few_records:70' ELSE '' END AS codes,
  CASE WHEN count(*) < 70 THEN CAST(count(*) AS DOUBLE) ELSE 0 END AS amount, CASE WHEN count(*) < 70 THEN 0 ELSE count(*) END AS n_values
FROM events GROUP BY user_id""",
)
def analyze_short_logs(spark, sf):
    """Logs under the window length are findings; the others are smoothed."""
    rec = tables.event_records(spark, sf)
    got = Registry().run("moving_average", rec, channel="value", window_size=70)
    done = got.values.groupBy(LOG).agg(F.count("value").alias("n_values"))
    out = rec.select(LOG).distinct().join(done, LOG, "left").join(got.findings, LOG, "left")
    return out.select(
        LOG, F.coalesce("code", F.lit("")).alias("codes"), F.coalesce("amount", F.lit(0.0)).alias("amount"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"),
    )


@query(
    "analyze_rich_lean_zone",
    f"""{_MIX}, s AS (SELECT log_id, mixture, 100 * avg((zone < -0.5)::INT) AS rich_pct, 100 * avg((abs(zone) < 0.5)::INT) AS stoich_pct,
  100 * avg((zone > 0.5)::INT) AS lean_pct, any_value(target) AS target, any_value(target - w) AS rich_limit, any_value(target + w) AS lean_limit FROM z GROUP BY log_id, mixture)
SELECT log_id, mixture, {r6('rich_pct')} AS rich_pct, {r6('stoich_pct')} AS stoich_pct, {r6('lean_pct')} AS lean_pct,
  CAST(target AS DOUBLE) AS target, {r6('rich_limit')}::DOUBLE AS rich_limit, {r6('lean_limit')}::DOUBLE AS lean_limit,
  array_to_string(list_filter([CASE WHEN lean_pct > 30 THEN 'excessive_lean' END, CASE WHEN rich_pct > 30 THEN 'excessive_rich' END], lambda x: x IS NOT NULL), ',') AS codes FROM s""",
)
def analyze_rich_lean_zone(spark, sf):
    got = Registry().run("rich_lean_zone", mixture_records(spark, sf), channel="mix")
    return _report(got, "rich_pct", "stoich_pct", "lean_pct", "rich_limit", "lean_limit")


@query(
    "analyze_afr_deviation",
    f"""{_MIX}, s AS (SELECT log_id, mixture, count(*) AS count, avg(dev) AS mean, stddev_samp(dev) AS stdev, min(dev) AS min, max(dev) AS max FROM z GROUP BY log_id, mixture)
SELECT log_id, mixture, count, {r6('mean')} AS mean, {r6('stdev')} AS stdev, {r6('min')} AS min, {r6('max')} AS max,
  array_to_string(list_filter([CASE WHEN mean > 5 THEN 'lean_bias' END, CASE WHEN mean < -5 THEN 'rich_bias' END, CASE WHEN stdev > 10 THEN 'unsteady_mixture' END], lambda x: x IS NOT NULL), ',') AS codes FROM s""",
)
def analyze_afr_deviation(spark, sf):
    got = Registry().run("afr_deviation", mixture_records(spark, sf), channel="mix")
    return _report(got, "mean", "stdev", "min", "max").drop("range", "cv")


def _engine_records(spark, sf):
    rec = tables.line_records(spark, sf)
    q, p, d = F.col("quantity"), F.col("extendedprice"), F.col("discount")
    return rec.select(
        LOG, IDX, T, "n", ((q - 5) * 200).alias("RPM"), (p / 400).alias("MAP"), (q + 20).alias("IAT"),
        (d * 100 + 2).alias("IPW"), (p / 5000 + 4).alias("AFR"),
    )


_ENGINE = f"""WITH {LINES_CTE}, g AS (SELECT log_id, idx, (quantity - 5) * 200 AS rpm, extendedprice / 400 AS map, quantity + 20 AS iat,
  discount * 100 + 2 AS ipw, extendedprice / 5000 + 4 AS afr FROM l),
v AS (SELECT log_id, CASE WHEN rpm <= 0 THEN 0 ELSE greatest(map / 101.325 * (298.0 / (iat + 273.15)) * 100, 0) END AS ve,
  CASE WHEN rpm <= 0 THEN 0 ELSE greatest(least(ipw * rpm / 1200, 100), 0) END AS duty, afr / 14.7 AS lam FROM g)"""


@query(
    "analyze_volumetric_efficiency",
    f"""{_ENGINE}, s AS (SELECT log_id, count(*) AS count, avg(ve) AS mean, min(ve) AS min, max(ve) AS max FROM v GROUP BY log_id)
SELECT log_id, count, {r6('mean')} AS mean, {r6('min')} AS min, {r6('max')} AS max,
  array_to_string(list_filter([CASE WHEN max > 150 THEN 'very_high_efficiency' END, CASE WHEN min < 20 AND min > 0 THEN 'very_low_efficiency' END], lambda x: x IS NOT NULL), ',') AS codes FROM s""",
)
def analyze_volumetric_efficiency(spark, sf):
    got = Registry().run("volumetric_efficiency", _engine_records(spark, sf))
    return _report(got, "mean", "min", "max").drop("stdev", "range", "cv")


@query(
    "analyze_injector_duty_cycle",
    f"""{_ENGINE}, s AS (SELECT log_id, count(*) AS n, avg(duty) AS mean, max(duty) AS max, sum((duty > 80)::INT)::BIGINT AS above_80,
  sum((duty > 95)::INT)::BIGINT AS above_95, sum((duty >= 100)::INT)::BIGINT AS at_100 FROM v GROUP BY log_id)
SELECT log_id, n, {r6('mean')} AS mean, {r6('max')} AS max, above_80, above_95, at_100,
  CASE WHEN at_100 > 0 THEN 'duty_at_limit' WHEN above_95 > 0 THEN 'duty_above_95' WHEN above_80 > n // 10 THEN 'duty_above_80' ELSE '' END AS codes FROM s""",
)
def analyze_injector_duty_cycle(spark, sf):
    got = Registry().run("injector_duty_cycle", _engine_records(spark, sf))
    return _report(got, "mean", "max")


@query(
    "analyze_lambda",
    f"""{_ENGINE}, s AS (SELECT log_id, count(*) AS count, avg(lam) AS mean, min(lam) AS min, max(lam) AS max FROM v GROUP BY log_id)
SELECT log_id, count, {r6('mean')} AS mean, {r6('min')} AS min, {r6('max')} AS max,
  array_to_string(list_filter([CASE WHEN max > 1.3 THEN 'very_lean' END, CASE WHEN min < 0.7 THEN 'very_rich' END], lambda x: x IS NOT NULL), ',') AS codes FROM s""",
)
def analyze_lambda(spark, sf):
    got = Registry().run("lambda_calculator", _engine_records(spark, sf))
    return _report(got, "mean", "min", "max").drop("stdev", "range", "cv")


@query(
    "analyze_rate_of_change",
    f"""WITH {EVENTS_CTE}, x AS (SELECT log_id, coalesce(lead(value) OVER w, value) - coalesce(lag(value) OVER w, value) AS d,
  lead(value) OVER w IS NULL OR lag(value) OVER w IS NULL AS edge FROM e WINDOW w AS (PARTITION BY log_id ORDER BY idx)),
y AS (SELECT log_id, CASE WHEN edge THEN d ELSE d / 2 END AS v FROM x),
s AS (SELECT log_id, count(*) AS count, avg(v) AS mean, stddev_samp(v) AS stdev, greatest(abs(max(v)), abs(min(v))) AS peak FROM y GROUP BY log_id)
SELECT log_id, count, {r6('mean')} AS mean, {r6('stdev')} AS stdev, {r6('peak')} AS max_abs_rate, CASE WHEN peak > 5 * stdev THEN 'extreme_rate' ELSE '' END AS codes FROM s""",
)
def analyze_rate_of_change(spark, sf):
    got = Registry().run(
        "rate_of_change", tables.event_records(spark, sf), channel="value", time_based=False
    )
    return _report(got, "mean", "stdev", "max_abs_rate").select(
        LOG, "count", "mean", "stdev", "max_abs_rate", "codes"
    )


@query(
    "analyze_filters",
    f"""WITH {EVENTS_CTE}
SELECT log_id, idx, {r6('median(value) OVER (PARTITION BY log_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS median,
  {r6('avg(value) OVER (PARTITION BY log_id ORDER BY idx ROWS 2 PRECEDING)')} AS average, 'window_widened' AS codes FROM e""",
)
def analyze_filters(spark, sf):
    rec = tables.event_records(spark, sf)
    registry = Registry()
    median = registry.run("median_filter", rec, channel="value", window_size=4)
    average = registry.run("moving_average", rec, channel="value", window_size=3)
    out = (
        median.values.select(LOG, IDX, F.col("value").alias("median"))
        .join(average.values.select(LOG, IDX, F.col("value").alias("average")), [LOG, IDX])
        .join(median.findings.select(LOG, F.col("code").alias("codes")), LOG, "left")
    )
    return _round(out, "median", "average")


@query(
    "analyze_missing_channel",
    "SELECT DISTINCT user_id AS log_id, 'missing_channel:Boost' AS code, 0.0::DOUBLE AS amount FROM events",
)
def analyze_missing_channel(spark, sf):
    rec = tables.event_records(spark, sf)
    return Registry().run("exponential_moving_average", rec, channel="Boost").findings


@query(
    "available_analyzers",
    """WITH c AS (SELECT DISTINCT o_custkey AS log_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'rpm' WHEN '2' THEN 'Map'
  WHEN '3' THEN 'AFR' WHEN '4' THEN 'iat' ELSE 'IPW' END AS name FROM orders),
n AS (SELECT * FROM (VALUES ('moving_average', ['rpm']), ('exponential_moving_average', ['rpm']), ('median_filter', ['rpm']), ('butterworth_lowpass', ['rpm']),
  ('butterworth_highpass', ['rpm']), ('descriptive_stats', ['rpm']), ('correlation', ['rpm', 'map']), ('rate_of_change', ['rpm']), ('fuel_trim_drift', ['ltft']),
  ('rich_lean_zone', ['afr']), ('afr_deviation', ['afr']), ('volumetric_efficiency', ['rpm', 'map', 'iat']), ('injector_duty_cycle', ['ipw', 'rpm']), ('lambda_calculator', ['afr'])) t(analyzer, needs)),
h AS (SELECT log_id, list(DISTINCT lower(name)) AS have FROM c GROUP BY log_id)
SELECT log_id, analyzer FROM h, n WHERE list_has_all(have, needs)""",
)
def available_analyzers(spark, sf):
    """Order priorities stand for channels, so customers have different sets."""
    number = F.substring("o_orderpriority", 1, 1)
    name = (
        F.when(number == "1", "rpm").when(number == "2", "Map").when(number == "3", "AFR")
        .when(number == "4", "iat").otherwise("IPW")
    )
    samples = tables.read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias(LOG), name.alias("channel")
    )
    return Registry().available(channel_list(samples))
