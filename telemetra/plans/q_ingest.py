"""Ingest queries: the tables rendered as logger files and parsed back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.frame import CHANNEL, IDX, LOG, T, VALUE, rounded
from telemetra.functions import decode
from telemetra.operators import quality
from telemetra.plans.catalog import EVENTS_CTE, LINES_CTE, ORDERS_CTE, query, r6
from telemetra.session import ingest_once
from telemetra.sources import files, tables, text

LINE_NO = "line_no"


def _rendered(body: DataFrame, header: list[str]) -> DataFrame:
    """Lines of one file per log: a fixed header, then the body rows (log_id, idx, line)."""
    head = body.select(LOG).distinct().select(
        LOG, F.posexplode(F.array(*[F.lit(h) for h in header])).alias(LINE_NO, "line")
    )
    rows = body.select(LOG, (F.col(IDX) + len(header)).alias(LINE_NO), "line")
    return rows.unionByName(head)


def _stamped(spark, sf):
    """Event records with the wall-clock microseconds as ``us``."""
    ev = tables.read_table(spark, sf, "events").withColumn("us", tables.micros("ts"))
    first = ev.groupBy("user_id").agg(F.min("us").alias("_first"))
    rec = tables.event_records(spark, sf)
    first = first.select(F.col("user_id").alias(LOG), F.col("_first").alias("us0"))
    return rec.join(first, LOG).withColumn(
        "us", F.col("us0") + F.round(F.col(T) * 1e6).cast("long")
    )


KEYVALUE_HEADER = [
    "%DataLog%", "DataLogVersion : 1.1", "Software : Bench: one", "Ignored : yes",
    "Channel : Engine Speed", "ID : 7", "Type : EngineSpeed", "DisplayMaxMin : 9000, 0",
    "", "Channel : Oil Pressure", "Type : Pressure", "DisplayMaxMin : 1000",
    "Channel : Mystery", "Type : NoSuchType", "DisplayMaxMin : 5.5 , -1",
]


def _clock(us):
    ms = F.floor(us / 1000)
    return F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(ms / 3600000) % 24, F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000,
    )


def keyvalue_lines(spark, sf):
    """The rendered files, written once like any folder of logger exports."""
    return ingest_once(spark, sf, "keyvalue-lines", lambda: _keyvalue_lines(spark, sf))


def _keyvalue_lines(spark, sf):
    rec = _stamped(spark, sf)
    first = F.when(F.col("k") % 10 == 0, F.lit("---")).otherwise(
        F.col("k").cast("int").cast("string")
    )
    cents = F.round(F.col("value") * 100).cast("long")
    line = F.concat(_clock(F.col("us")), F.lit(","), first, F.lit(", "), cents, F.lit(","), F.col(IDX))
    return _rendered(rec.select(LOG, IDX, line.alias("line")), KEYVALUE_HEADER)


_CLOCKED = EVENTS_CTE + """,
c AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
   ((epoch_us(ts) // 1000) % 86400000) / 1000.0 AS s FROM events),
j AS (SELECT e.*, c.s - first_value(c.s) OVER (PARTITION BY e.log_id ORDER BY e.idx) AS rel
      FROM e JOIN c ON c.log_id = e.log_id AND c.idx = e.idx)"""


@query(
    "ingest_keyvalue",
    f"""WITH {_CLOCKED}, g AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY idx) - 1 AS pos FROM j WHERE k % 10 <> 0)
SELECT log_id, pos AS idx, {r6('rel')} AS t, v.channel, {r6('v.value')} AS value FROM g,
  LATERAL (VALUES ('Engine Speed', k), ('Oil Pressure', round(g.value * 100) / 10 - 101.3), ('Mystery', CAST(idx AS DOUBLE))) v(channel, value)""",
)
def ingest_keyvalue(spark, sf):
    """Unreadable first cells shift their row left, so it is too short and dropped."""
    out = text.parse_keyvalue(keyvalue_lines(spark, sf)).samples()
    return out.withColumns({T: rounded(F.col(T)), VALUE: rounded(F.col(VALUE))})


@query(
    "ingest_keyvalue_nulls",
    f"""WITH {_CLOCKED}
SELECT log_id, idx, {r6('rel')} AS t, CASE WHEN k % 10 <> 0 THEN k END AS "Engine Speed",
  {r6('round(value * 100) / 10 - 101.3')} AS "Oil Pressure" FROM j""",
)
def ingest_keyvalue_nulls(spark, sf):
    """The same files with unreadable cells kept in place as NULL, wide form."""
    out = text.parse_keyvalue(keyvalue_lines(spark, sf), compat=False).wide(
        ["engine speed", "Oil Pressure"]
    )
    return out.select(
        LOG, IDX, rounded(F.col(T)).alias(T), F.col("engine speed").alias("Engine Speed"),
        rounded(F.col("Oil Pressure")).alias("Oil Pressure"),
    )


@query(
    "ingest_channel_table",
    """SELECT u.log_id, c.* FROM (SELECT DISTINCT user_id AS log_id FROM events) u,
 (VALUES (0, 'Engine Speed', 'EngineSpeed', 'RPM', '7', 0.0::DOUBLE, 9000.0::DOUBLE),
         (1, 'Oil Pressure', 'Pressure', 'kPa', NULL, NULL, NULL),
         (2, 'Mystery', 'NoSuchType', '', NULL, -1.0, 5.5))
 c(channel_idx, name, type_name, unit, id, display_min, display_max)""",
)
def ingest_channel_table(spark, sf):
    return text.parse_keyvalue(keyvalue_lines(spark, sf)).channels.select(
        LOG, "channel_idx", "name", "type_name", "unit", "id", "display_min", "display_max"
    )


@query(
    "ingest_log_metadata",
    "SELECT DISTINCT user_id AS log_id, 'keyvalue' AS format, '1.1' AS version, 'Bench: one' AS software, "
    "2 AS entries FROM events",
)
def ingest_log_metadata(spark, sf):
    logs = text.parse_keyvalue(keyvalue_lines(spark, sf)).logs
    return logs.select(
        LOG, "format", F.col("meta")["DataLogVersion"].alias("version"),
        F.col("meta")["Software"].alias("software"), F.size("meta").alias("entries"),
    )


def _seconds_text(us):
    return F.concat(F.floor(us / 1000000), F.lit("."), F.lpad((us % 1000000).cast("string"), 6, "0"))


def holdfill_lines(spark, sf):
    """The rendered files, written once like any folder of logger exports."""
    return ingest_once(spark, sf, "holdfill-lines", lambda: _holdfill_lines(spark, sf))


def _holdfill_lines(spark, sf):
    rec = tables.event_records(spark, sf)
    us = F.round(F.col(T) * 1e6).cast("long")
    odd = F.col("k") % 2 == 1
    rpm = F.when(F.col("k") % 3 == 0, F.lit("")).otherwise(F.col("value").cast("string"))
    tps = F.when(odd, F.lit("n/a")).otherwise(F.col("k").cast("string"))
    line = F.concat(
        _seconds_text(us), F.lit(";"), rpm,
        F.when(F.col("k") % 5 == 4, F.lit("")).otherwise(F.concat(F.lit(";"), tps)),
    )
    return _rendered(rec.select(LOG, IDX, line.alias("line")), ["TIME;engine/rpm;sensors/tps1"])


@query(
    "ingest_holdfill",
    f"""WITH {EVENTS_CTE}, s AS (SELECT *, CASE WHEN k % 3 <> 0 THEN value END AS a,
   CASE WHEN k % 5 <> 4 AND k % 2 = 0 THEN k END AS b FROM e),
h AS (SELECT log_id, idx, t, coalesce(last_value(a IGNORE NULLS) OVER w, 0) AS a, coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS b
  FROM s WINDOW w AS (PARTITION BY log_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT log_id, idx, {r6('t')} AS t, v.channel, v.value FROM h, LATERAL (VALUES ('rpm', a), ('tps1', b)) v(channel, value)""",
)
def ingest_holdfill(spark, sf):
    """Sparse cells repeat their channel's last value; chunks of 20 records."""
    out = text.parse_holdfill(holdfill_lines(spark, sf)).samples()
    return out.withColumn(T, rounded(F.col(T)))


def msclock_lines(spark, sf):
    """The rendered files, written once like any folder of logger exports."""
    return ingest_once(spark, sf, "msclock-lines", lambda: _msclock_lines(spark, sf))


def _msclock_lines(spark, sf):
    rec = tables.event_records(spark, sf)
    even = F.col(LOG) % 2 == 0
    ms = F.floor(F.round(F.col(T) * 1e6).cast("long") / 1000) + 500
    d = F.when(even, F.lit(";")).otherwise(F.lit(","))
    number = F.col("value").cast("string")
    number = F.when(even, F.replace(number, F.lit("."), F.lit(","))).otherwise(number)
    speed = F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(number)
    tail = F.when(F.col("k") % 11 == 0, F.lit("")).otherwise(F.concat(d, F.col("k").cast("int").cast("string")))
    row = rec.select(LOG, (F.col(IDX) + 1).alias(LINE_NO), F.concat(ms, d, speed, tail).alias("line"))
    head = rec.select(LOG).distinct().select(
        LOG, F.lit(0).cast("long").alias(LINE_NO),
        F.concat(F.lit("Time (msec)"), d, F.lit("Engine Speed (rpm)"), d, F.lit("Boost Pressure")).alias("line"),
    )
    return row.unionByName(head)


@query(
    "ingest_msclock",
    f"""WITH {EVENTS_CTE}, s AS (SELECT log_id, idx, floor(round(t * 1e6) / 1000) + 500 AS ms,
   CASE WHEN k % 7 = 0 THEN 0 ELSE value END AS a, CASE WHEN k % 11 = 0 THEN 0 ELSE k END AS b FROM e)
SELECT log_id, idx, {r6('ms / 1000.0 - 0.5')} AS t, v.channel, v.unit, v.value FROM s,
  LATERAL (VALUES ('Engine Speed', 'rpm', a), ('Boost Pressure', 'psi', b)) v(channel, unit, value)""",
)
def ingest_msclock(spark, sf):
    """Even logs are semicolon files with decimal commas, odd logs comma files."""
    got = text.parse_msclock(msclock_lines(spark, sf))
    names = got.channels.select(LOG, F.col("name").alias(CHANNEL), "unit")
    out = got.samples().join(names, [LOG, CHANNEL])
    return out.withColumn(T, rounded(F.col(T)))


CALENDAR_HEADER = [
    "TimeStamp: Sat Nov 15 19:00:03 2025", "Customer: Line: north", "UnitNumber: 12",
    "SoftwarePartNumber: 7", "SoftwareVersion: 2.1", "TimeStamp, Notch,, Speed",
]


def calendar_lines(spark, sf):
    """The rendered files, written once like any folder of logger exports."""
    return ingest_once(spark, sf, "calendar-lines", lambda: _calendar_lines(spark, sf))


def _calendar_lines(spark, sf):
    rec = _stamped(spark, sf)
    stamp = F.date_format(F.timestamp_micros("us"), "EEE MMM dd HH:mm:ss yyyy")
    notch = F.when(F.col("k") % 9 == 0, F.lit("bad")).otherwise(F.col("k").cast("int").cast("string"))
    line = F.concat(stamp, F.lit(", "), notch, F.lit(", "), F.col("value").cast("string"))
    return _rendered(rec.select(LOG, IDX, line.alias("line")), CALENDAR_HEADER)


@query(
    "ingest_calendar",
    f"""WITH {EVENTS_CTE}, c AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
   floor(epoch_us(ts) / 1e6) AS s FROM events),
j AS (SELECT e.*, c.s - first_value(c.s) OVER (PARTITION BY e.log_id ORDER BY e.idx) AS rel FROM e JOIN c ON c.log_id = e.log_id AND c.idx = e.idx),
g AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY idx) - 1 AS pos FROM j WHERE k % 9 <> 0)
SELECT log_id, pos AS idx, rel AS t, v.channel, v.value FROM g, LATERAL (VALUES ('Notch', k), ('Speed', value)) v(channel, value)""",
)
def ingest_calendar(spark, sf):
    return text.parse_calendar(calendar_lines(spark, sf)).samples()


@query(
    "ingest_calendar_metadata",
    "SELECT DISTINCT user_id AS log_id, 'Sat Nov 15 19:00:03 2025' AS stamp, 'Line: north' AS customer, "
    "5 AS entries FROM events",
)
def ingest_calendar_metadata(spark, sf):
    logs = text.parse_calendar(calendar_lines(spark, sf)).logs
    return logs.select(
        LOG, F.col("meta")["TimeStamp"].alias("stamp"), F.col("meta")["Customer"].alias("customer"),
        F.size("meta").alias("entries"),
    )


@query(
    "skip_loaded_files",
    "SELECT '/logs/' || event_id || '.csv' AS path FROM events WHERE event_type <> 'view'",
)
def skip_loaded_files(spark, sf):
    """Files of view events are in the manifest already."""
    ev = tables.read_table(spark, sf, "events").select(
        F.concat(F.lit("/logs/"), F.col("event_id"), F.lit(".csv")).alias("path"), "event_type"
    )
    return files.unseen(ev.select("path"), ev.filter(F.col("event_type") == "view"))


@query(
    "raw_type_decode",
    f"""WITH s AS (SELECT event_id, value * 100 AS raw, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 'Pressure' WHEN 1 THEN 'AFR'
  WHEN 2 THEN 'Temperature' WHEN 3 THEN 'Decibel' WHEN 4 THEN 'Raw' ELSE 'Unheard' END AS type_name FROM events)
SELECT event_id, type_name, CASE type_name WHEN 'Pressure' THEN 'kPa' WHEN 'AFR' THEN 'λ' WHEN 'Temperature' THEN 'K' WHEN 'Decibel' THEN 'dB' ELSE '' END AS unit,
 {r6("CASE type_name WHEN 'Pressure' THEN raw / 10 - 101.3 WHEN 'AFR' THEN raw / 1000 WHEN 'Temperature' THEN raw / 10 WHEN 'Decibel' THEN raw / 100 ELSE raw END")} AS value FROM s""",
)
def raw_type_decode(spark, sf):
    kinds = ["Pressure", "AFR", "Temperature", "Decibel", "Raw", "Unheard"]
    ev = tables.read_table(spark, sf, "events").select(
        "event_id", (F.col("value") * 100).alias("raw"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % 6 + 1).cast("int")).alias("type_name"),
    )
    out = decode.decode_types(ev, "raw", "type_name")
    return out.select("event_id", "type_name", "unit", rounded(F.col("value")).alias("value"))


@query(
    "raw_field_decode",
    f"""WITH {EVENTS_CTE}
SELECT log_id, idx, field_idx, {r6('CASE WHEN ft >= 10 THEN 0 ELSE (raw + tr) * sc END')} AS value FROM e,
  LATERAL (VALUES (0, k, 0.5, -40.0, 2), (1, value, 0.1, 3.0, 7), (2, k, 1.0, 0.0, 10)) f(field_idx, raw, sc, tr, ft)""",
)
def raw_field_decode(spark, sf):
    """Two scaled fields and a bit field per record."""
    rec = tables.event_records(spark, sf)
    raw = rec.select(
        LOG, IDX, F.posexplode(F.array("k", "value", "k")).alias("field_idx", "raw")
    )
    kinds = F.array(
        *[F.struct(F.lit(s).alias("scale"), F.lit(t).alias("transform"), F.lit(ft).alias("field_type"))
          for s, t, ft in ((0.5, -40.0, 2), (0.1, 3.0, 7), (1.0, 0.0, 10))]
    )
    fields = rec.select(LOG).distinct().select(LOG, F.posexplode(kinds).alias("field_idx", "f")).select(
        LOG, "field_idx", "f.*"
    )
    out = decode.decode_fields(raw, fields)
    return out.select(LOG, IDX, "field_idx", rounded(F.col("value")).alias("value"))


@query(
    "live_frames",
    f"""WITH {EVENTS_CTE}, s AS (SELECT log_id, idx, CASE WHEN k % 4 = 0 THEN 0.00005 ELSE value END AS a, CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN 0 ELSE k END AS b FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY idx) - 1 AS pos FROM s WHERE abs(a) > 1e-4 OR abs(b) > 1e-4)
SELECT log_id, pos AS idx, {r6('pos / 100.0')} AS t, a AS c0, b AS c1, 0.0::DOUBLE AS c2 FROM g""",
)
def live_frames(spark, sf):
    """Dead frames dropped, infinities zeroed, missing cells padded, 100 Hz clock."""
    rec = tables.event_records(spark, sf)
    dead = F.col("k") % 4 == 0
    values = F.array(
        F.when(dead, F.lit(0.00005)).otherwise(F.col("value")),
        F.when(dead, F.lit(float("nan"))).when(F.col("k") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("k")),
    )
    frames = rec.select(LOG, F.col(IDX).alias("seq"), values.alias("values"))
    out = decode.live_frames(frames, 3)
    return out.select(
        LOG, IDX, rounded(F.col(T)).alias(T), *[F.col("cells")[i].alias(f"c{i}") for i in range(3)]
    )


@query(
    "hold_last_value",
    f"""WITH {EVENTS_CTE}, s AS (SELECT *, CASE WHEN k % 13 = 5 THEN value END AS a FROM e)
SELECT log_id, idx, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS held FROM s""",
)
def hold_last_value(spark, sf):
    from telemetra.operators.layout import hold_last

    rec = tables.event_records(spark, sf).select(
        LOG, IDX, F.when(F.col("k") % 13 == 5, F.col("value")).alias("held")
    )
    return hold_last(rec, ["held"], start=0.0)


@query(
    "rebase_time",
    f"WITH {ORDERS_CTE} SELECT log_id, idx, t - first_value(t) OVER (PARTITION BY log_id ORDER BY idx) AS t FROM o",
)
def rebase_time(spark, sf):
    rec = tables.order_records(spark, sf).withColumnRenamed(T, "clock")
    return tables.rebase(rec, "clock").select(LOG, IDX, T)


@query(
    "structure_audit",
    f"""WITH {EVENTS_CTE}, s AS (SELECT log_id, idx, t, CASE WHEN k % 50 = 7 THEN NULL ELSE value END AS a,
  CASE WHEN k % 40 = 3 THEN 'nan'::DOUBLE ELSE k END AS b FROM e)
SELECT log_id, count(*) AS n_records, CAST(count(*) FILTER (a IS NULL) AS BIGINT) AS short_rows, CAST(count(*) FILTER (isnan(b)) AS BIGINT) AS non_finite_cells,
  0.0::DOUBLE AS t_first, 0 AS backward_steps, count(*) >= 50 AND count(*) FILTER (a IS NULL OR isnan(b)) = 0 AS sound FROM s GROUP BY log_id""",
)
def structure_audit(spark, sf):
    rec = tables.event_records(spark, sf).select(
        LOG, IDX, T, F.when(F.col("k") % 50 != 7, F.col("value")).alias("a"),
        F.when(F.col("k") % 40 == 3, F.lit(float("nan"))).otherwise(F.col("k")).alias("b"),
    )
    return quality.structure_audit(rec, ["a", "b"], min_records=50)


@query(
    "wide_to_long_to_wide",
    f"WITH {LINES_CTE} SELECT log_id, idx, quantity, tax FROM l",
)
def wide_to_long_to_wide(spark, sf):
    """Unpivot to samples and pivot back for a named channel list."""
    from telemetra.frame import to_records, to_samples

    rec = tables.line_records(spark, sf)
    names = list(tables.LINE_CHANNELS)
    return to_records(to_samples(rec.select(LOG, IDX, T, *names)), ["quantity", "tax"]).drop(T)


@query(
    "append_derived_channel",
    f"""WITH {EVENTS_CTE} SELECT log_id, idx, c.channel, {r6('c.value')} AS value FROM
 (SELECT *, avg(value) OVER (PARTITION BY log_id ORDER BY idx ROWS 4 PRECEDING) AS m FROM e),
 LATERAL (VALUES ('value', value), ('k', k), ('value (MA5)', m)) c(channel, value)""",
)
def append_derived_channel(spark, sf):
    from telemetra.frame import append_channel, to_samples
    from telemetra.operators.series import moving_average

    rec = tables.event_records(spark, sf)
    derived = moving_average(rec, "value", 5)
    out = append_channel(to_samples(rec, ["value", "k"]), derived, "value (MA5)", "moving_average")
    return out.select(LOG, IDX, CHANNEL, rounded(F.col(VALUE)).alias(VALUE))


@query(
    "union_of_logs",
    f"""WITH {EVENTS_CTE}, {LINES_CTE}
SELECT 'events' AS source, log_id, idx, value, k, NULL::DOUBLE AS quantity FROM e
UNION ALL SELECT 'lines', log_id, idx, NULL, NULL, quantity FROM l""",
)
def union_of_logs(spark, sf):
    """Logs with different channels in one frame; absent channels are NULL."""
    from telemetra.frame import union_logs

    events = tables.event_records(spark, sf).select(
        F.lit("events").alias("source"), LOG, IDX, "value", "k"
    )
    lines = tables.line_records(spark, sf).select(
        F.lit("lines").alias("source"), LOG, IDX, "quantity"
    )
    return union_logs(events, lines)
