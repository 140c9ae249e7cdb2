"""Formula, unit and engine-arithmetic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T, rounded
from telemetra.functions import engine, formula, units
from telemetra.operators import nearest, stats
from telemetra.plans.catalog import EVENTS_CTE, LINES_CTE, query, r6
from telemetra.sources import tables


@query(
    "formula_arithmetic",
    f"""WITH {LINES_CTE}, f AS (SELECT log_id, idx,
  CASE WHEN quantity = 25 THEN 0 ELSE extendedprice * (1 - discount) / (quantity - 25)
    - power(discount, 2) * 3 - quantity % 7 END AS a,
  CASE WHEN quantity = 25 THEN 5.0::DOUBLE ELSE 5 + 1 / (1 / (quantity - 25)) END AS b FROM l)
SELECT log_id, idx, {r6('a', 8)} AS value, {r6('b')} AS reciprocal FROM f""",
)
def formula_arithmetic(spark, sf):
    """Precedence of minus and ^, remainder, and division by zero inside and outside."""
    rec = tables.line_records(spark, sf)
    out = formula.evaluate(
        rec, "extendedprice * (1 - discount) / (quantity - 25) + -discount ^ 2 * 3 - quantity % 7",
        "value", channels=list(tables.LINE_CHANNELS),
    )
    out = formula.evaluate(
        out, "5 + 1 / (1 / (Quantity - 25))", "reciprocal", channels=list(tables.LINE_CHANNELS)
    )
    return out.select(
        LOG, IDX, rounded(F.col("value"), 8).alias("value"),
        rounded(F.col("reciprocal")).alias("reciprocal"),
    )


@query(
    "formula_functions",
    f"""WITH {EVENTS_CTE}, f AS (SELECT log_id, idx,
   sin(value) + cos(k) * tan(0.1) + atan2(value, k + 1) + sinh(k / 100) + cosh(0.5) + tanh(k) AS trig,
   CASE WHEN k / 50 - 1 > 1 THEN 0 ELSE asin(k / 50 - 1) + acos(k / 100) + atan(value) END AS arcs,
   asinh(value) + acosh(k + 1) + atanh(k / 200) AS hyper,
   CASE WHEN k <= 50 THEN 0 ELSE ln(k - 50) + log10(k - 50) + log2(k - 50) END AS logs,
   floor(value) + ceil(value) + round(k / 7) + trunc(value - 40) + (value - trunc(value)) + CASE WHEN k - 50 < 0 THEN -1 ELSE 1 END AS steps,
   greatest(value, k, 20) - least(value, k) + sqrt(abs(k - 50)) + exp(k / 100) AS picks FROM e)
SELECT log_id, idx, {r6('trig')} AS trig, {r6('arcs')} AS arcs, {r6('hyper')} AS hyper,
  {r6('logs')} AS logs, {r6('steps')} AS steps, {r6('picks')} AS picks FROM f""",
)
def formula_functions(spark, sf):
    rec = tables.event_records(spark, sf)
    texts = {
        "trig": "sin(value) + cos(k) * tan(0.1) + atan2(value, k + 1) + sinh(k / 100) + cosh(0.5) + tanh(k)",
        "arcs": "asin(k / 50 - 1) + acos(k / 100) + atan(value)",
        "hyper": "asinh(value) + acosh(k + 1) + atanh(k / 200)",
        "logs": "ln(k - 50) + log10(k - 50) + log2(k - 50)",
        "steps": "floor(value) + ceil(value) + round(k / 7) + trunc(value - 40) + fract(value) + signum(k - 50)",
        "picks": "max(value, k, 20) - min(value, k) + sqrt(abs(k - 50)) + exp(k / 100)",
    }
    out = rec
    for name, text in texts.items():
        out = formula.evaluate(out, text, name, channels=["value", "k"])
    return out.select(LOG, IDX, *[rounded(F.col(c)).alias(c) for c in texts])


@query(
    "formula_shifts",
    f"""WITH {EVENTS_CTE}, c AS (SELECT q.log_id, q.idx AS qid, r.value AS v,
   row_number() OVER (PARTITION BY q.log_id, q.idx ORDER BY abs(r.t - (q.t - 3600.0)), r.t) AS pick
   FROM e q JOIN e r ON r.log_id = q.log_id)
SELECT e.log_id, e.idx, {r6('e.value - p.value + (x.value - c.v) * 0.5')} AS value
FROM e JOIN e p ON p.log_id = e.log_id AND p.idx = greatest(e.idx - 1, 0)
  JOIN e x ON x.log_id = e.log_id AND x.idx = least(e.idx + 2, e.n - 1)
  JOIN c ON c.log_id = e.log_id AND c.qid = e.idx AND c.pick = 1""",
)
def formula_shifts(spark, sf):
    """Opposite record shifts and a time shift in one formula."""
    rec = tables.event_records(spark, sf).withColumnRenamed("value", "Sensor Value")
    out = formula.evaluate(
        rec, '"sensor value" - "Sensor Value"[-1] + ("Sensor Value"[+2] - "Sensor Value"@-3600s) * 0.5',
        "value", channels=["Sensor Value", "k"],
    )
    return out.select(LOG, IDX, rounded(F.col("value")).alias("value"))


@query(
    "formula_statistics",
    f"""WITH {LINES_CTE}
SELECT log_id, idx, {r6('(quantity - avg(quantity) OVER w) / stddev_pop(quantity) OVER w')} AS z,
  {r6('(extendedprice - min(extendedprice) OVER w) / (max(extendedprice) OVER w - min(extendedprice) OVER w) * max(extendedprice) OVER w', 4)} AS scaled
FROM l WINDOW w AS (PARTITION BY log_id)""",
)
def formula_statistics(spark, sf):
    rec = tables.line_records(spark, sf)
    names = list(tables.LINE_CHANNELS)
    out = formula.evaluate(rec, "(quantity - _mean_quantity) / _stdev_quantity", "z", channels=names)
    out = formula.evaluate(
        out, "(extendedprice - _min_extendedprice) / _range_extendedprice * _max_extendedprice",
        "scaled", channels=names,
    )
    return out.select(LOG, IDX, rounded(F.col("z")).alias("z"), rounded(F.col("scaled"), 4).alias("scaled"))


@query(
    "formula_preview",
    f"""WITH {EVENTS_CTE}, f AS (SELECT log_id, idx, value / k AS v FROM e WHERE idx < 25),
g AS (SELECT log_id, CASE WHEN k = 0 THEN 0 ELSE value / k END AS v FROM e WHERE idx < 25)
SELECT log_id, {r6('min(v)')} AS min, {r6('max(v)')} AS max, {r6('avg(v)')} AS mean FROM g GROUP BY log_id""",
)
def formula_preview(spark, sf):
    rec = tables.event_records(spark, sf)
    shown = formula.preview(rec, "value / k", 25, "v", channels=["value", "k"])
    out = stats.preview_stats(shown, "v", 25)
    return out.withColumns({c: rounded(F.col(c)) for c in ("min", "max", "mean")})


@query(
    "formula_templates",
    f"""WITH {EVENTS_CTE}, g AS (SELECT *, value * 40 AS rpm, k / 10 + 8 AS afr, k * 2 AS map FROM e)
SELECT g.log_id, g.idx, {r6('(g.afr - 14.7) / 14.7 * 100')} AS deviation, {r6('g.afr / 14.7')} AS lambda,
  {r6('g.map / 101.325 * 100')} AS load, {r6('g.rpm - p.rpm')} AS delta,
  {r6('(g.rpm + p.rpm + q.rpm) / 3')} AS smooth
FROM g JOIN g p ON p.log_id = g.log_id AND p.idx = greatest(g.idx - 1, 0)
  JOIN g q ON q.log_id = g.log_id AND q.idx = greatest(g.idx - 2, 0)""",
)
def formula_templates(spark, sf):
    rec = tables.event_records(spark, sf).select(
        LOG, IDX, T, (F.col("value") * 40).alias("RPM"), (F.col("k") / 10 + 8).alias("AFR"),
        (F.col("k") * 2).alias("MAP"),
    )
    names = {"deviation": "AFR Deviation", "lambda": "Lambda", "load": "Load Estimate",
             "delta": "RPM Delta", "smooth": "RPM Smoothed"}
    out = rec
    for alias, name in names.items():
        out = formula.apply_template(out, name, alias, channels=["RPM", "AFR", "MAP"])
    return out.select(LOG, IDX, *[rounded(F.col(a)).alias(a) for a in names])


@query(
    "formula_template_rates",
    f"""WITH {EVENTS_CTE}, g AS (SELECT log_id, idx, t / 36000 AS t, value AS tps FROM e),
c AS (SELECT q.log_id, q.idx AS qid, r.tps AS v,
   row_number() OVER (PARTITION BY q.log_id, q.idx ORDER BY abs(r.t - (q.t + -0.1)), r.t) AS pick
   FROM g q JOIN g r ON r.log_id = q.log_id)
SELECT g.log_id, g.idx, {r6('(tps - v) * 10')} AS rate,
  {r6('(tps - avg(tps) OVER w) / stddev_pop(tps) OVER w')} AS z
FROM g JOIN c ON c.log_id = g.log_id AND c.qid = g.idx AND c.pick = 1 WINDOW w AS (PARTITION BY g.log_id)""",
)
def formula_template_rates(spark, sf):
    rec = tables.event_records(spark, sf).select(
        LOG, IDX, (F.col(T) / 36000).alias(T), F.col("value").alias("TPS"), F.col("value").alias("MAP")
    )
    out = formula.apply_template(rec, "TPS Rate", "rate", channels=["TPS", "MAP"])
    out = formula.apply_template(out, "MAP Z-Score", "z", channels=["TPS", "MAP"])
    return out.select(LOG, IDX, rounded(F.col("rate")).alias("rate"), rounded(F.col("z")).alias("z"))


@query(
    "formula_binding",
    """WITH c AS (SELECT DISTINCT user_id AS log_id, event_type AS name FROM events),
i AS (SELECT log_id, name, row_number() OVER (PARTITION BY log_id ORDER BY name) - 1 AS channel_idx FROM c),
r AS (SELECT DISTINCT log_id, reference FROM c, (VALUES ('VIEW'), ('error'), ('boost')) v(reference))
SELECT r.log_id, reference, channel_idx FROM r LEFT JOIN i ON i.log_id = r.log_id AND lower(i.name) = lower(reference)""",
)
def formula_binding(spark, sf):
    """Each log's channels are its event types; ``boost`` is nobody's."""
    from telemetra.operators.names import channel_list

    channels = channel_list(tables.event_rate_points(spark, sf))
    return formula.bind(channels, "VIEW - error[-1] * boost")


@query(
    "formula_findings",
    """WITH c AS (SELECT user_id AS log_id, bool_or(event_type = 'view') AS v, bool_or(event_type = 'error') AS e,
   bool_or(event_type = 'click') AND user_id % 2 = 0 AS c FROM events GROUP BY user_id),
f AS (SELECT log_id, 'blank' AS formula, 'empty' AS code, '' AS detail FROM c
UNION ALL SELECT log_id, 'names', 'unknown_channels', 'boost' || CASE WHEN v THEN '' ELSE ', VIEW' END || CASE WHEN e THEN '' ELSE ', Error' END FROM c
UNION ALL SELECT log_id, 'plain', 'unknown_channels', 'click' FROM c WHERE NOT c
UNION ALL SELECT log_id, 'power', CASE WHEN c THEN 'parse_error' ELSE 'unknown_channels' END,
   CASE WHEN c THEN 'Parse error: unknown operator **' ELSE 'click' END FROM c
UNION ALL SELECT log_id, 'mean', CASE WHEN c THEN 'unknown_statistic' ELSE 'unknown_channels' END,
   CASE WHEN c THEN '_mean_boost' ELSE 'click' END FROM c)
SELECT * FROM f""",
)
def formula_findings(spark, sf):
    """Which logs cannot evaluate which of five formulas, and why; odd logs call clicks taps."""
    from telemetra.operators.names import channel_list

    formulas = {
        "blank": "  ", "names": "boost * VIEW - Error[-1]", "plain": "click + 1",
        "power": "click ** 2", "mean": "click - _mean_boost",
    }
    channels = channel_list(tables.event_rate_points(spark, sf))
    tap = (F.col("name") == "click") & (F.col(LOG) % 2 == 1)
    channels = channels.withColumn("name", F.when(tap, "tap").otherwise(F.col("name")))
    return formula.findings(channels, formulas)


@query(
    "unit_conversion",
    f"""WITH s AS (SELECT event_id, value, CASE CAST(event_id % 9 AS INTEGER) WHEN 0 THEN 'K' WHEN 1 THEN 'kPa' WHEN 2 THEN 'km/h'
  WHEN 3 THEN 'km' WHEN 4 THEN 'L/100km' WHEN 5 THEN 'L' WHEN 6 THEN 'cc/min' WHEN 7 THEN 'm/s²' ELSE 'V' END AS unit FROM events)
SELECT event_id, unit, CASE unit WHEN 'K' THEN '°F' WHEN 'kPa' THEN 'PSI' WHEN 'km/h' THEN 'mph' WHEN 'km' THEN 'mi'
  WHEN 'L/100km' THEN 'mpg' WHEN 'L' THEN 'gal' WHEN 'cc/min' THEN 'lb/hr' WHEN 'm/s²' THEN 'g' ELSE unit END AS display_unit,
 {r6("CASE unit WHEN 'K' THEN (value - 273.15) * 9 / 5 + 32 WHEN 'kPa' THEN value * 0.145038 WHEN 'km/h' THEN value * 0.621371 WHEN 'km' THEN value * 0.621371 WHEN 'L/100km' THEN CASE WHEN value > 0 THEN 235.215 / value ELSE 0 END WHEN 'L' THEN value * 0.264172 WHEN 'cc/min' THEN value * 0.75 * 60 / 453.592 WHEN 'm/s²' THEN value / 9.80665 ELSE value END")} AS display_value
FROM s""",
)
def unit_conversion(spark, sf):
    """Every event carries one of nine units; imperial display is chosen."""
    kinds = ["K", "kPa", "km/h", "km", "L/100km", "L", "cc/min", "m/s²", "V"]
    ev = tables.read_table(spark, sf, "events").select(
        "event_id", "value",
        F.element_at(
            F.array(*[F.lit(u) for u in kinds]), (F.col("event_id") % 9 + 1).cast("int")
        ).alias("unit"),
    )
    choice = {"temperature": "°F", "pressure": "PSI", "speed": "mph", "distance": "mi",
              "fuel_economy": "mpg", "volume": "gal", "flow": "lb/hr", "acceleration": "g"}
    out = units.convert(ev, choice=choice)
    return out.select(
        "event_id", "unit", "display_unit", rounded(F.col("display_value")).alias("display_value")
    )


@query(
    "legend_at_cursor",
    f"""WITH {EVENTS_CTE}, c AS (SELECT log_id, value, row_number() OVER (PARTITION BY log_id
   ORDER BY abs(t - 1000000.0), t DESC, idx) AS pick FROM e)
SELECT log_id, 'Temp: ' || printf('%.2f', value - 273.15) || ' °C' AS legend FROM c WHERE pick = 1""",
)
def legend_at_cursor(spark, sf):
    """Each log's value at t = 1,000,000 s in display units."""
    rec = tables.event_records(spark, sf)
    asked = rec.select(LOG).distinct().withColumn("ask", F.lit(1000000.0))
    hit = nearest.nearest_record(asked, rec, "ask", ["value"], tie="later")
    shown = units.convert(
        hit.select(
            LOG, F.lit("Temp").alias("name"), F.col("near_value").alias("value"),
            F.lit("K").alias("unit"),
        )
    )
    return units.legend(shown).select(LOG, "legend")


@query(
    "format_time",
    f"""WITH {EVENTS_CTE}, s AS (SELECT log_id, idx, (t - 3000.0) / 50 AS x FROM e),
p AS (SELECT *, abs(x) AS a, CASE WHEN x < 0 THEN '-' ELSE '' END AS sg FROM s)
SELECT log_id, idx, CASE WHEN a >= 3600 THEN sg || printf('%d:%02d:%06.3f', CAST(floor(a / 3600) AS BIGINT), CAST(floor((a % 3600) / 60) AS BIGINT), a % 60)
  WHEN (a % 3600) >= 60 THEN sg || printf('%d:%06.3f', CAST(floor((a % 3600) / 60) AS BIGINT), a % 60)
  ELSE sg || printf('%.3fs', a % 60) END AS text FROM p""",
)
def format_time(spark, sf):
    rec = tables.event_records(spark, sf)
    x = (F.col(T) - 3000.0) / 50
    return rec.select(LOG, IDX, units.format_time(x).alias("text"))


_MIX = f"""WITH {EVENTS_CTE}, g AS (SELECT log_id, idx,
   CASE WHEN log_id % 2 = 0 THEN 0.7 + k / 160 ELSE 10 + k / 10 END AS mix FROM e),
u AS (SELECT log_id, CASE WHEN median(mix) < 3 THEN 'lambda' ELSE 'afr' END AS mixture FROM g GROUP BY log_id),
h AS (SELECT g.*, mixture, CASE WHEN mixture = 'lambda' THEN 1.0 ELSE 14.7 END AS target,
   CASE WHEN mixture = 'lambda' THEN 0.03 ELSE 0.5 END AS w FROM g JOIN u USING (log_id)),
z AS (SELECT *, CASE WHEN mix < target - w THEN -1.0::DOUBLE WHEN mix > target + w THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS zone,
   (mix - target) / target * 100 AS dev FROM h)"""


def mixture_records(spark, sf):
    """Even logs carry lambda, odd logs AFR, both made from k."""
    mix = F.when(F.col(LOG) % 2 == 0, F.lit(0.7) + F.col("k") / 160).otherwise(
        F.lit(10.0) + F.col("k") / 10
    )
    return tables.event_records(spark, sf).select(LOG, IDX, T, mix.alias("mix"), "n")


@query(
    "mixture_zones",
    f"{_MIX} SELECT log_id, idx, mixture, zone, {r6('dev')} AS deviation, "
    f"{r6('CASE WHEN mixture = ' + chr(39) + 'lambda' + chr(39) + ' THEN mix * 14.7 ELSE mix END')} AS afr FROM z",
)
def mixture_zones(spark, sf):
    rec = mixture_records(spark, sf)
    both = rec.join(engine.mixture_units(rec, "mix"), LOG)
    rich, lean = engine.zone_limits(F.col("mixture"))
    return both.select(
        LOG, IDX, "mixture", engine.zone(F.col("mix"), rich, lean).alias("zone"),
        rounded(
            engine.deviation_percent(F.col("mix"), engine.target_of(F.col("mixture")))
        ).alias("deviation"),
        rounded(engine.to_afr(F.col("mix"), F.col("mixture"))).alias("afr"),
    )


@query(
    "engine_arithmetic",
    f"""WITH {LINES_CTE}
SELECT log_id, idx, {r6('greatest((extendedprice / 500) / 101.325 * (298.0 / (quantity + 273.15)) * 100, 0)')} AS ve,
  {r6('CASE WHEN (quantity - 10) * 100 <= 0 THEN 0 ELSE greatest(least(discount * 200 * ((quantity - 10) * 100) / 1200, 100), 0) END')} AS duty,
  {r6('extendedprice / 1000 / 14.7')} AS lambda FROM l""",
)
def engine_arithmetic(spark, sf):
    q, p, d = F.col("quantity"), F.col("extendedprice"), F.col("discount")
    rec = tables.line_records(spark, sf)
    return rec.select(
        LOG, IDX,
        rounded(engine.volumetric_efficiency(F.lit(3000.0), p / 500, q)).alias("ve"),
        rounded(engine.injector_duty(d * 200, (q - 10) * 100)).alias("duty"),
        rounded(engine.lambda_of(p / 1000)).alias("lambda"),
    )
