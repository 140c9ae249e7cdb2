"""Ordered-series queries: windows, shifts, recurrences, downsampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T, VALUE, rounded
from telemetra.operators import downsample, nearest, recurrence, series, stats
from telemetra.plans.catalog import (
    EVENTS_CTE,
    LINES_CTE,
    ORDERS_CTE,
    STREAM_CTE,
    query,
    r6,
)
from telemetra.sources import tables


def _r(df, *names, places=6):
    return df.withColumns({n: rounded(F.col(n), places) for n in names})


def _avg(src, part="PARTITION BY log_id "):
    return (
        f"SELECT log_id, idx, {r6(f'avg(value) OVER ({part}ORDER BY idx ROWS 4 PRECEDING)')} "
        f"AS moving_average FROM {src}"
    )


@query("moving_average", f"WITH {EVENTS_CTE} {_avg('e')}")
def moving_average(spark, sf):
    out = series.moving_average(tables.event_records(spark, sf), "value", 5)
    return _r(out.select(LOG, IDX, "moving_average"), "moving_average")


@query("moving_average_long_log", f"WITH {STREAM_CTE} {_avg('e', '')}")
def moving_average_long_log(spark, sf):
    rec = tables.event_stream_record(spark, sf)
    out = series.moving_average(rec, "value", 5)
    return _r(out.select(LOG, IDX, "moving_average"), "moving_average")


def _median(cte, part):
    return (
        f"WITH {cte} SELECT log_id, idx, "
        f"{r6(f'median(value) OVER ({part}ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} "
        "AS median_filter FROM e"
    )


@query("median_filter", _median(EVENTS_CTE, "PARTITION BY log_id "))
def median_filter(spark, sf):
    """Window 4 is widened to 5."""
    out = series.median_filter(tables.event_records(spark, sf), "value", 4)
    return _r(out.select(LOG, IDX, "median_filter"), "median_filter")


@query("median_filter_long_log", _median(STREAM_CTE, ""))
def median_filter_long_log(spark, sf):
    rec = tables.event_stream_record(spark, sf)
    out = series.median_filter(rec, "value", 5)
    return _r(out.select(LOG, IDX, "median_filter"), "median_filter")


_ODD = "CASE WHEN idx % 211 = 7 THEN 'nan'::DOUBLE WHEN idx % 307 = 9 THEN 'inf'::DOUBLE WHEN idx % 13 = 5 THEN NULL ELSE quantity END"


@query(
    "moving_average_long_window",
    f"""WITH {LINES_CTE}, s AS (SELECT log_id, idx, {_ODD} AS x FROM l),
m AS (SELECT log_id, idx, avg(x) OVER (PARTITION BY log_id ORDER BY idx ROWS 299 PRECEDING) AS a,
  avg(CASE WHEN isfinite(x) THEN x END) OVER (PARTITION BY log_id ORDER BY idx ROWS 299 PRECEDING) AS b FROM s)
SELECT log_id, idx, CASE WHEN isnan(a) THEN 'nan' WHEN isinf(a) THEN 'inf' ELSE 'number' END AS kind, {r6('b')} AS clean FROM m""",
)
def moving_average_long_window(spark, sf):
    """A window of 300 over chunks of 64 records, with cells that are missing or no numbers."""
    x = F.when(F.col(IDX) % 211 == 7, F.lit(float("nan"))).when(F.col(IDX) % 307 == 9, F.lit(float("inf")))
    x = x.when(F.col(IDX) % 13 == 5, F.lit(None)).otherwise(F.col("quantity"))
    rec = tables.line_records(spark, sf).select(LOG, IDX, "n", x.alias("x"))
    rec = rec.withColumn("clean_x", F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.col("x")))
    rec = series.moving_average(rec, "x", 300, "a", rows=64)
    rec = series.moving_average(rec, "clean_x", 300, "b", rows=64)
    kind = F.when(F.isnan("a"), "nan").when(F.col("a") == float("inf"), "inf").otherwise("number")
    return rec.select(LOG, IDX, kind.alias("kind"), rounded(F.col("b")).alias("clean"))


def _wide_median(cte, part, half, src="e", value="value"):
    frame = f"({part}ORDER BY idx ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    return f"WITH {cte} SELECT log_id, idx, {r6(f'median({value}) OVER {frame}')} AS median_filter FROM {src}"


@query("median_filter_wide", _wide_median(STREAM_CTE, "", 5000))
def median_filter_wide(spark, sf):
    """10,001 records on one log of all events."""
    out = series.median_filter(tables.event_stream_record(spark, sf), "value", 10001)
    return _r(out.select(LOG, IDX, "median_filter"), "median_filter")


@query("median_filter_wide_chunks", _wide_median(LINES_CTE, "PARTITION BY log_id ", 40, "l", "quantity"))
def median_filter_wide_chunks(spark, sf):
    """81 records over chunks of 640."""
    out = series.median_filter(tables.line_records(spark, sf), "quantity", 81, rows=128)
    return _r(out.select(LOG, IDX, "median_filter"), "median_filter")


_NEAR = """x AS (SELECT log_id, idx, t, value,
  coalesce(lead(value) OVER w, value) AS v1, coalesce(lag(value) OVER w, value) AS v0,
  coalesce(lead(t) OVER w, t) AS t1, coalesce(lag(t) OVER w, t) AS t0,
  lead(value) OVER w IS NULL OR lag(value) OVER w IS NULL AS edge
  FROM e WINDOW w AS (PARTITION BY log_id ORDER BY idx))"""
_TIME_D = "CASE WHEN abs(t1 - t0) > 2.220446049250313e-16 THEN (v1 - v0) / (t1 - t0) ELSE 0 END"


@query(
    "time_derivative",
    f"WITH {EVENTS_CTE}, {_NEAR} SELECT log_id, idx, {r6(_TIME_D)} AS derivative FROM x",
)
def time_derivative(spark, sf):
    out = series.time_derivative(tables.event_records(spark, sf), "value")
    return _r(out.select(LOG, IDX, "derivative"), "derivative")


@query(
    "time_derivative_long_log",
    f"WITH {STREAM_CTE}, {_NEAR} SELECT log_id, idx, {r6(_TIME_D)} AS derivative FROM x",
)
def time_derivative_long_log(spark, sf):
    rec = tables.event_stream_record(spark, sf)
    out = series.time_derivative(rec, "value")
    return _r(out.select(LOG, IDX, "derivative"), "derivative")


@query(
    "sample_derivative",
    f"WITH {EVENTS_CTE}, {_NEAR} SELECT log_id, idx, "
    f"{r6('CASE WHEN edge THEN v1 - v0 ELSE (v1 - v0) / 2 END')} AS derivative FROM x",
)
def sample_derivative(spark, sf):
    out = series.sample_derivative(tables.event_records(spark, sf), "value")
    return _r(out.select(LOG, IDX, "derivative"), "derivative")


@query(
    "derivative_summary",
    f"""WITH {EVENTS_CTE}, {_NEAR}, d AS (SELECT log_id, {_TIME_D} AS d FROM x),
s AS (SELECT log_id, count(*) AS n, avg(d) AS mean, median(d) AS med, stddev_samp(d) AS sd,
        min(d) AS mn, max(d) AS mx FROM d GROUP BY log_id)
SELECT log_id, n AS count, {r6('mean')} AS mean, {r6('med')} AS median, {r6('sd')} AS stdev,
  {r6('greatest(abs(mx), abs(mn))')} AS max_abs_rate, greatest(abs(mx), abs(mn)) > 5 * sd AS extreme FROM s""",
)
def derivative_summary(spark, sf):
    d = series.time_derivative(tables.event_records(spark, sf), "value")
    s = stats.describe(d, "derivative")
    peak = F.greatest(F.abs("max"), F.abs("min"))
    out = s.select(
        LOG, "count", "mean", "median", "stdev", peak.alias("max_abs_rate"),
        (peak > F.col("stdev") * 5.0).alias("extreme"),
    )
    return _r(out, "mean", "median", "stdev", "max_abs_rate")


@query(
    "index_shift",
    f"""WITH {EVENTS_CTE}
SELECT e.log_id, e.idx, a.value AS back3, b.k AS ahead2, c.value AS back100, d.value AS ahead1000
FROM e JOIN e a ON a.log_id = e.log_id AND a.idx = greatest(e.idx - 3, 0)
  JOIN e b ON b.log_id = e.log_id AND b.idx = least(e.idx + 2, e.n - 1)
  JOIN e c ON c.log_id = e.log_id AND c.idx = greatest(e.idx - 100, 0)
  JOIN e d ON d.log_id = e.log_id AND d.idx = least(e.idx + 1000, e.n - 1)""",
)
def index_shift(spark, sf):
    """Short shifts by halo windows, long ones by record-number lookup."""
    rec = tables.event_records(spark, sf)
    out = series.index_shift(
        rec,
        {"back3": ("value", -3), "ahead2": ("k", 2), "back100": ("value", -100),
         "ahead1000": ("value", 1000)},
    )
    return out.select(LOG, IDX, "back3", "ahead2", "back100", "ahead1000")


def _nearest_sql(cte, src, question, tie):
    """Reference answer by brute force: the closest record of the log, per question."""
    side = "r.idx" if tie == "earlier" else "-r.idx"
    return f"""WITH {cte}, q AS ({question}),
c AS (SELECT q.log_id, q.qid, q.ask, r.idx, r.t, r.v,
   row_number() OVER (PARTITION BY q.log_id, q.qid
     ORDER BY abs(r.t - q.ask), CASE WHEN r.t < q.ask THEN {0 if tie == 'earlier' else 1} ELSE {1 if tie == 'earlier' else 0} END,
     CASE WHEN r.t < q.ask THEN -r.idx ELSE r.idx END) AS pick
   FROM q JOIN {src} r ON r.log_id = q.log_id)"""


@query(
    "time_shift",
    _nearest_sql(
        EVENTS_CTE + ", s AS (SELECT log_id, idx, t, value AS v FROM e)", "s",
        "SELECT log_id, idx AS qid, t + -7200.0 AS ask FROM s", "earlier",
    )
    + " SELECT log_id, qid AS idx, v AS shifted FROM c WHERE pick = 1",
)
def time_shift(spark, sf):
    """The value two hours earlier, nearest record, ties to the earlier one."""
    rec = tables.event_records(spark, sf)
    return nearest.time_shift(rec, {"shifted": "value"}, -7200.0).select(LOG, IDX, "shifted")


_STREAM_ASOF = f"""WITH {STREAM_CTE},
q AS (SELECT idx, t + 600.0 AS ask FROM e),
p AS (SELECT q.idx, q.ask, r.t AS pt, r.value AS pv FROM q ASOF LEFT JOIN e r ON q.ask > r.t),
x AS (SELECT p.*, r.t AS nt, r.value AS nv FROM p ASOF LEFT JOIN e r ON p.ask <= r.t)
SELECT CAST(0 AS BIGINT) AS log_id, idx,
  CASE WHEN nt IS NULL OR (pt IS NOT NULL AND abs(ask - pt) <= abs(nt - ask)) THEN pv ELSE nv END AS shifted FROM x"""


@query("time_shift_long_log", _STREAM_ASOF)
def time_shift_long_log(spark, sf):
    rec = tables.event_stream_record(spark, sf)
    out = nearest.time_shift(rec, {"shifted": "value"}, 600.0)
    return out.select(LOG, IDX, "shifted")


@query("time_shift_in_buckets", _STREAM_ASOF)
def time_shift_in_buckets(spark, sf):
    """The way of long logs: buckets of about 700 records and questions."""
    rec = tables.event_stream_record(spark, sf)
    return nearest.time_shift(rec, {"shifted": "value"}, 600.0, rows=700).select(LOG, IDX, "shifted")


@query(
    "nearest_record_cursor",
    _nearest_sql(
        ORDERS_CTE + ", s AS (SELECT log_id, idx, t, totalprice AS v FROM o)", "s",
        "SELECT c_custkey AS log_id, qid, CAST(694224000 + qid * 15552000 AS DOUBLE) AS ask "
        "FROM customer, range(0, 17) t(qid)", "later",
    )
    + " SELECT log_id, qid, ask, idx AS near_idx, t AS near_t, v AS near_totalprice FROM c WHERE pick = 1",
)
def nearest_record_cursor(spark, sf):
    """Cursor lookup with tied times: half-yearly questions to every customer's log."""
    asked = (
        tables.read_table(spark, sf, "customer")
        .select(F.col("c_custkey").alias(LOG), F.explode(F.sequence(F.lit(0), F.lit(16))).alias("qid"))
        .withColumn("ask", F.lit(694224000.0) + F.col("qid") * F.lit(15552000.0))
    )
    rec = tables.order_records(spark, sf)
    out = nearest.nearest_record(asked, rec, "ask", ["totalprice"], tie="later")
    # Customers without orders have no record to be near to.
    return out.filter(F.col("near_idx").isNotNull())


_MERGED = """WITH p AS (SELECT user_id AS log_id, event_id AS seq, event_type AS channel, value,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t FROM events),
ty AS (SELECT DISTINCT event_type AS channel FROM events),
tl AS (SELECT DISTINCT log_id, t FROM p),
g AS (SELECT tl.log_id, tl.t, ty.channel FROM tl CROSS JOIN ty),
h AS (SELECT g.log_id, g.t, g.channel, p.value FROM g ASOF LEFT JOIN p
        ON p.log_id = g.log_id AND p.channel = g.channel AND g.t >= p.t),
f AS (SELECT log_id, channel, arg_min(value, t) AS fv FROM p GROUP BY log_id, channel),
m AS (SELECT h.log_id, h.t, h.channel, coalesce(h.value, f.fv, 0) AS v
      FROM h LEFT JOIN f ON f.log_id = h.log_id AND f.channel = h.channel)
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY t) - 1 AS idx, round(t, 6) + 0.0 AS t,
  max(v) FILTER (channel = 'click') AS click, max(v) FILTER (channel = 'error') AS error,
  max(v) FILTER (channel = 'purchase') AS purchase, max(v) FILTER (channel = 'view') AS view, max(v) FILTER (channel = 'signup') AS signup
FROM m GROUP BY log_id, t"""
_RATES = ["click", "error", "purchase", "view", "signup"]


@query("merge_rates", _MERGED)
def merge_rates(spark, sf):
    out = nearest.merge_rates(tables.event_rate_points(spark, sf), _RATES)
    return _r(out.select(LOG, IDX, T, *_RATES), T)


@query("merge_rates_capped", f"SELECT * FROM ({_MERGED}) WHERE idx < 20")
def merge_rates_capped(spark, sf):
    """The optional cap on the records of a timeline."""
    out = nearest.merge_rates(tables.event_rate_points(spark, sf), _RATES, max_records=20)
    return _r(out.select(LOG, IDX, T, *_RATES), T)


@query(
    "plausible_points",
    """WITH p AS (SELECT user_id AS log_id, event_id AS seq, event_type AS channel,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 - 5000 AS t,
    CASE event_id % 5 WHEN 0 THEN value * 5e8 WHEN 1 THEN 'nan'::DOUBLE ELSE value END AS value FROM events)
SELECT log_id, seq, channel, value FROM p WHERE t >= 0 AND t < 100000 AND NOT isnan(value) AND abs(value) < 1e10""",
)
def plausible_points(spark, sf):
    """Drops points before zero, past 1e5 s, not numbers, or of 1e10 and more."""
    odd = (
        F.when(F.col("seq") % 5 == 0, F.col(VALUE) * 5e8)
        .when(F.col("seq") % 5 == 1, F.lit(float("nan")))
        .otherwise(F.col(VALUE))
    )
    points = tables.event_rate_points(spark, sf).withColumns({VALUE: odd, T: F.col(T) - 5000})
    return nearest.plausible_points(points).select(LOG, "seq", "channel", VALUE)


@query(
    "z_score",
    f"""WITH {LINES_CTE}
SELECT log_id, idx, {r6('(quantity - avg(quantity) OVER w) / greatest(stddev_samp(quantity) OVER w, 0.001)')} AS z
FROM l WINDOW w AS (PARTITION BY log_id)""",
)
def z_score(spark, sf):
    return _r(series.z_score(tables.line_records(spark, sf), "quantity").select(LOG, IDX, "z"), "z")


@query(
    "normalise_series",
    f"""WITH {EVENTS_CTE}
SELECT log_id, idx, {r6('CASE WHEN max(value) OVER w - min(value) OVER w < 2.220446049250313e-16 THEN 0.5 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END')} AS normal
FROM e WINDOW w AS (PARTITION BY log_id)""",
)
def normalise_series(spark, sf):
    out = series.normalise(tables.event_records(spark, sf), "value")
    return _r(out.select(LOG, IDX, "normal"), "normal")


@query(
    "clock_unwrap",
    f"""WITH {EVENTS_CTE},
b AS (SELECT log_id, idx, CAST(floor(t / 40.0) % 65536 AS BIGINT) AS raw_ts FROM e),
w AS (SELECT *, CASE WHEN coalesce(lag(raw_ts) OVER (PARTITION BY log_id ORDER BY idx), 0) - raw_ts > 30000
                     THEN 1 ELSE 0 END AS turn FROM b)
SELECT log_id, idx, raw_ts, {r6('raw_ts / 1000.0 + 65.536 * sum(turn) OVER (PARTITION BY log_id ORDER BY idx)')} AS t
FROM w""",
)
def clock_unwrap(spark, sf):
    """A 16-bit clock made from the event times (one count is 40 s)."""
    rec = tables.event_records(spark, sf)
    blocks = rec.select(
        LOG, IDX, F.pmod(F.floor(F.col(T) / 40.0), F.lit(65536)).cast("long").alias("raw_ts")
    )
    return _r(series.unwrap_clock(blocks), T)


@query(
    "monotonic_audit",
    f"""WITH {LINES_CTE}, s AS (SELECT l_suppkey AS log_id, epoch_us(l_shipdate) / 1e6 AS t,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) AS i FROM lineitem),
p AS (SELECT log_id, t, lag(t) OVER (PARTITION BY log_id ORDER BY i) AS prev FROM s)
SELECT log_id, CAST(count(*) FILTER (t < prev) AS BIGINT) AS backward_steps FROM p GROUP BY log_id""",
)
def monotonic_audit(spark, sf):
    """Ship dates in order-key order are a clock that often runs backwards."""
    from telemetra.operators.layout import with_record_index

    lines = tables.read_table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias(LOG), "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
        (tables.micros("l_shipdate") / F.lit(1e6)).alias(T),
    )
    rec = with_record_index(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"])
    return series.monotonic_audit(rec)


@query(
    "time_slice",
    f"""WITH {EVENTS_CTE}, b AS (SELECT log_id, min(t) AS f, max(t) AS l FROM e GROUP BY log_id),
c AS (SELECT *, greatest(2500000.0 - 150000.0, f) AS lo0, least(2500000.0 + 150000.0, l) AS hi0 FROM b),
d AS (SELECT log_id, CASE WHEN hi0 - lo0 < 300000 AND lo0 <> f THEN greatest(l - 300000.0, f) ELSE lo0 END AS t_low,
             CASE WHEN hi0 - lo0 < 300000 AND lo0 = f THEN least(f + 300000.0, l) ELSE hi0 END AS t_high FROM c)
SELECT e.log_id, e.idx, value FROM e JOIN d USING (log_id) WHERE t BETWEEN t_low AND t_high""",
)
def time_slice(spark, sf):
    """Jump view: 300,000 s around t = 2,500,000 s, slid back inside each log."""
    rec = tables.event_records(spark, sf)
    bounds = series.slice_bounds(stats.time_range(rec), "jump", 300000.0, 2500000.0)
    return series.time_slice(rec, bounds).select(LOG, IDX, "value")


def _ema_sql(cte, src, value, alpha):
    return f"""WITH RECURSIVE {cte}, s AS MATERIALIZED (SELECT log_id, idx, {value} AS x FROM {src}),
r AS (SELECT log_id, idx, {alpha} * x + (1 - {alpha}) * x AS y FROM s WHERE idx = 0
      UNION ALL
      SELECT s.log_id, s.idx, {alpha} * s.x + (1 - {alpha}) * r.y FROM r JOIN s
        ON s.log_id = r.log_id AND s.idx = r.idx + 1)
SELECT log_id, idx, {r6('y')} AS ema FROM r"""


@query("exponential_moving_average", _ema_sql(EVENTS_CTE, "e", "value", "0.2::DOUBLE"))
def exponential_moving_average(spark, sf):
    return _r(recurrence.exponential_moving_average(tables.event_records(spark, sf), "value"), "ema")


@query("exponential_moving_average_chunked", _ema_sql(LINES_CTE, "l", "quantity", "0.05::DOUBLE"))
def exponential_moving_average_chunked(spark, sf):
    """Logs of order lines in chunks of 128 records."""
    rec = tables.line_records(spark, sf)
    return _r(recurrence.exponential_moving_average(rec, "quantity", 0.05, rows=128), "ema")


_DRIFT = f"""WITH RECURSIVE {LINES_CTE}, s AS MATERIALIZED (SELECT log_id, idx, n, quantity AS x FROM l),
m AS MATERIALIZED (SELECT log_id, avg(x) AS mu FROM s WHERE idx < greatest(floor(n * 10.0 / 100), 10) GROUP BY log_id),
z AS MATERIALIZED (SELECT s.log_id, s.idx, x - mu AS d FROM s JOIN m USING (log_id)),
r AS (SELECT log_id, idx, greatest(d - 2.5, 0.0) AS up, greatest(-d - 2.5, 0.0) AS down FROM z WHERE idx = 0
  UNION ALL
  SELECT z.log_id, z.idx, greatest(CASE WHEN up > 20 THEN 0.0 ELSE up END + d - 2.5, 0.0),
         greatest(CASE WHEN down > 20 THEN 0.0 ELSE down END - d - 2.5, 0.0)
  FROM r JOIN z ON z.log_id = r.log_id AND z.idx = r.idx + 1),
f AS (SELECT log_id, idx, CAST(CASE WHEN up > 20 THEN 1 WHEN down > 20 THEN -1 ELSE 0 END AS DOUBLE) AS drift FROM r)"""


@query("drift_flags", f"{_DRIFT} SELECT log_id, idx, drift FROM f")
def drift_flags(spark, sf):
    return recurrence.drift_flags(tables.line_records(spark, sf), "quantity")


@query("drift_flags_chunked", f"{_DRIFT} SELECT log_id, idx, drift FROM f")
def drift_flags_chunked(spark, sf):
    """The same flags by chunks of 128 records."""
    return recurrence.drift_flags(tables.line_records(spark, sf), "quantity", rows=128)


def _filter_sql(cte, src, value, sections):
    """Reflect, run the cascade forward and backward by recursion, trim."""
    pad = 6 * len(sections)
    def cascade(name, source, out):
        cols, first, nxt = [], [], []
        x0, xin0, xin = "x", "x", "p.x"
        for j, (b0, b1, b2, a1, a2) in enumerate(sections):
            zi2 = f"({b2 - a2!r} * x)"
            zi1 = f"({b1 - a1 + (b2 - a2)!r} * x)"
            y0 = f"({b0!r} * {xin0} + {zi1})"
            y = f"({b0!r} * {xin} + r.a{j})"
            first += [f"{b1!r} * {xin0} - {a1!r} * {y0} + {zi2} AS a{j}",
                      f"{b2!r} * {xin0} - {a2!r} * {y0} AS b{j}"]
            nxt += [f"{b1!r} * {xin} - {a1!r} * {y} + r.b{j}", f"{b2!r} * {xin} - {a2!r} * {y}"]
            xin0, xin = y0, y
        return f"""{name} AS (SELECT log_id, i, {xin0} AS {out}, {', '.join(first)} FROM {source} WHERE i = 0
  UNION ALL SELECT p.log_id, p.i, {xin}, {', '.join(nxt)}
  FROM {name} r JOIN {source} p ON p.log_id = r.log_id AND p.i = r.i + 1)"""
    return f"""WITH RECURSIVE {cte},
s AS MATERIALIZED (SELECT log_id, idx, n, {value} AS v FROM {src}),
h AS (SELECT log_id, max(n) AS n, arg_min(v, idx) AS head, arg_max(v, idx) AS tail FROM s GROUP BY log_id),
p0 AS MATERIALIZED (
  SELECT log_id, idx + {pad} AS i, v AS x FROM s
  UNION ALL SELECT s.log_id, {pad} - s.idx, 2 * head - v FROM s JOIN h USING (log_id) WHERE s.idx BETWEEN 1 AND {pad}
  UNION ALL SELECT s.log_id, {pad} + 2 * (s.n - 1) - s.idx, 2 * tail - v FROM s JOIN h USING (log_id)
    WHERE s.idx BETWEEN s.n - 1 - {pad} AND s.n - 2),
{cascade('fw', 'p0', 'y')},
p1 AS MATERIALIZED (SELECT fw.log_id, h.n + {2 * pad} - 1 - fw.i AS i, fw.y AS x FROM fw JOIN h USING (log_id)),
{cascade('bw', 'p1', 'y')}
SELECT bw.log_id, h.n + {pad} - 1 - bw.i AS idx, {r6('bw.y', 4)} AS filtered
FROM bw JOIN h USING (log_id) WHERE h.n + {pad} - 1 - bw.i BETWEEN 0 AND h.n - 1"""


@query(
    "butterworth_lowpass",
    _filter_sql(EVENTS_CTE, "e", "value", recurrence.butterworth_sections(0.1, 2)),
)
def butterworth_lowpass(spark, sf):
    rec = tables.event_records(spark, sf)
    return _r(recurrence.butterworth_filtfilt(rec, "value", 0.1, 2), "filtered", places=4)


@query(
    "butterworth_lowpass_chunked",
    _filter_sql(LINES_CTE, "l", "quantity", recurrence.butterworth_sections(0.05, 3)),
)
def butterworth_lowpass_chunked(spark, sf):
    """Order 3 on the logs of order lines, in chunks of 128 records."""
    rec = tables.line_records(spark, sf)
    return _r(
        recurrence.butterworth_filtfilt(rec, "quantity", 0.05, 3, rows=128), "filtered", places=4
    )


@query(
    "butterworth_highpass",
    _filter_sql(EVENTS_CTE, "e", "value", recurrence.butterworth_sections(0.2, 4, high=True)),
)
def butterworth_highpass(spark, sf):
    rec = tables.event_records(spark, sf)
    return _r(
        recurrence.butterworth_filtfilt(rec, "value", 0.2, 4, high=True), "filtered", places=4
    )


def _lttb_sql(cte, src, value, target):
    m = target - 2
    return f"""WITH RECURSIVE {cte},
s0 AS (SELECT log_id, idx, t, n, {value} AS v, (n - 2) / {float(m)} AS w FROM {src}),
s AS MATERIALIZED (SELECT *, (SELECT max(k) FROM range(0, {target + 1}) g(k) WHERE floor(k * w) + 1 <= idx) AS slot FROM s0 WHERE n > {target}),
a AS MATERIALIZED (SELECT log_id, slot, avg(t) AS mt, avg(v) AS mv FROM s WHERE idx > 0 GROUP BY log_id, slot),
z AS MATERIALIZED (SELECT log_id, idx, t, v FROM s WHERE idx = n - 1),
c AS MATERIALIZED (SELECT s.log_id, s.slot, s.idx, s.t, s.v,
   CASE WHEN s.slot = {m} THEN z.t ELSE a.mt END AS mt, CASE WHEN s.slot = {m} THEN z.v ELSE a.mv END AS mv
   FROM s JOIN z ON z.log_id = s.log_id LEFT JOIN a ON a.log_id = s.log_id AND a.slot = s.slot + 1
   WHERE s.slot BETWEEN 1 AND {m} AND s.idx BETWEEN 1 AND s.n - 2
   UNION ALL SELECT z.log_id, {m}, z.idx, z.t, z.v, z.t, z.v FROM z
   WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.log_id = z.log_id AND s.slot = {m} AND s.idx < z.idx)),
r AS (SELECT log_id, CAST(0 AS BIGINT) AS pos, idx, t, v FROM s WHERE idx = 0
  UNION ALL
  SELECT c.log_id, r.pos + 1, c.idx, c.t, c.v FROM r JOIN c ON c.log_id = r.log_id AND c.slot = r.pos + 1
  QUALIFY row_number() OVER (PARTITION BY c.log_id
    ORDER BY coalesce(CASE WHEN isnan((r.t - c.mt) * (c.v - r.v) - (r.t - c.t) * (c.mv - r.v)) THEN -1
      ELSE abs((r.t - c.mt) * (c.v - r.v) - (r.t - c.t) * (c.mv - r.v)) END, -1) DESC, c.idx) = 1),
o AS (SELECT log_id, pos, idx, t, v FROM r
  UNION ALL SELECT log_id, {target - 1}, idx, t, v FROM z
  UNION ALL SELECT log_id, idx, idx, t, v FROM s0 WHERE n <= {target})"""


@query(
    "lttb",
    _lttb_sql(EVENTS_CTE, "e", "value", 20)
    + f" SELECT log_id, pos, idx, {r6('t')} AS t, v AS value FROM o",
)
def lttb(spark, sf):
    return _r(downsample.lttb(tables.event_records(spark, sf), "value", 20), T)


@query(
    "lttb_long_log",
    _lttb_sql(STREAM_CTE, "e", "value", 40)
    + f" SELECT log_id, pos, idx, {r6('t')} AS t, v AS value FROM o",
)
def lttb_long_log(spark, sf):
    rec = tables.event_stream_record(spark, sf)
    return _r(downsample.lttb(rec, "value", 40), T)


@query(
    "lttb_by_maps",
    _lttb_sql(STREAM_CTE, "e", "value", 60)
    + f" SELECT log_id, pos, idx, {r6('t')} AS t, v AS value FROM o",
)
def lttb_by_maps(spark, sf):
    """The way of long logs: all events as one log over chunks of 512 records."""
    rec = tables.event_stream_record(spark, sf)
    return _r(downsample.lttb(rec, "value", 60, rows=512), T)


_GAPPED = "CASE WHEN idx % 9 = 4 THEN 'nan'::DOUBLE WHEN idx % 31 = 8 THEN NULL ELSE value END"


@query("lttb_gaps", _lttb_sql(EVENTS_CTE, "e", _GAPPED, 20) + " SELECT log_id, pos, idx FROM o")
def lttb_gaps(spark, sf):
    """Values that are missing or no numbers never win; where no area is one, the first record does."""
    idx = F.col(IDX)
    x = F.when(idx % 9 == 4, F.lit(float("nan"))).when(idx % 31 == 8, F.lit(None)).otherwise(F.col("value"))
    rec = tables.event_records(spark, sf).withColumn("x", x)
    return downsample.lttb(rec, "x", 20).select(LOG, "pos", IDX)


@query(
    "chart_series",
    _lttb_sql(LINES_CTE.replace("AS idx,", "AS idx, 0.01 * (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate) - 1) AS t,"), "l", "extendedprice", 50)
    + """, y AS (SELECT log_id, min(v) AS lo, max(v) AS hi FROM o GROUP BY log_id)
SELECT o.log_id, pos, idx, """ + r6("(v - lo) / (hi - lo)") + " AS normal FROM o JOIN y ON y.log_id = o.log_id",
)
def chart_series(spark, sf):
    out = downsample.chart_series(tables.line_records(spark, sf), "extendedprice", 50)
    return _r(out.select(LOG, "pos", IDX, "normal"), "normal")


@query(
    "chart_series_raw",
    f"""WITH {EVENTS_CTE}, b AS (SELECT log_id, min(value) AS lo, max(value) AS hi FROM e GROUP BY log_id)
SELECT e.log_id, idx, {r6('(value - lo) / CASE WHEN hi - lo < 1e-4 THEN 1 ELSE hi - lo END')} AS normal
FROM e JOIN b ON b.log_id = e.log_id""",
)
def chart_series_raw(spark, sf):
    out = downsample.chart_series_raw(tables.event_records(spark, sf), "value")
    return _r(out.select(LOG, IDX, "normal"), "normal")
