"""Whole folders: logs rendered as one file each, in all formats, and loaded back."""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.frame import CHANNEL, IDX, LOG, T, VALUE, rounded
from telemetra.plans.catalog import EVENTS_CTE, query, r6
from telemetra.plans.q_ingest import CALENDAR_HEADER, _CLOCKED, _clock, _seconds_text, _stamped
from telemetra.session import ingest_once, scratch_dir, ship_package
from telemetra.sources import files, store, tables

FILE, LINE_NO, DATA = "file", "line_no", "data"


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (file, line_no, data) as files below ``folder``; (file, bytes) of each.

    A task streams its files in order and holds one batch.  A file appears under its
    name when it is complete, so a task that runs again does no harm.
    """
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, size = None, None, 0

        def done() -> pa.RecordBatch:
            stream.close()
            disk, path = store.resolve(os.path.join(folder, name))
            disk.move(f"{path}.partial", path)
            return pa.RecordBatch.from_pydict({FILE: [name], "bytes": [size]})

        for batch in batches:
            names = batch.column(FILE)
            edge = np.flatnonzero(np.r_[True, pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)])
            for low, high in zip(edge, np.r_[edge[1:], len(names)], strict=True):
                if names[low].as_py() != name:
                    if stream is not None:
                        yield done()
                    name, size = names[low].as_py(), 0
                    disk, path = store.resolve(os.path.join(folder, name))
                    disk.create_dir(os.path.dirname(path), recursive=True)
                    stream = disk.open_output_stream(f"{path}.partial")
                held = b"".join(batch.column(DATA).slice(low, high - low).to_pylist())
                stream.write(held)
                size += len(held)
        if stream is not None:
            yield done()

    dealt = rows.repartition(FILE).sortWithinPartitions(FILE, LINE_NO)
    return dealt.mapInArrow(run, f"{FILE} string, bytes long")


def _text(body: DataFrame, header: list[str | bytes]) -> DataFrame:
    """Files of a fixed header and the body rows (file, idx, line)."""
    lines = [h if isinstance(h, bytes) else h.encode() for h in header]
    head = body.select(FILE).distinct().select(
        FILE, F.posexplode(F.array(*[F.lit(h + b"\n") for h in lines])).alias(LINE_NO, DATA)
    )
    data = F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias(DATA)
    return body.select(FILE, (F.col(IDX) + len(header)).alias(LINE_NO), data).unionByName(head)


def _packed(body: DataFrame) -> DataFrame:
    """Fixed records of rows (file, idx, t, k): a time in days and eight multiples of k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, store.RECORD)
            out["ole"] = 45292.0 + batch.column(T).to_numpy() / 86400.0 / 100.0
            out["raw"] = np.outer(batch.column("k").to_numpy(), np.arange(1, 9)).astype(np.int64)
            data = [r.tobytes() for r in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(FILE), batch.column(IDX), pa.array(data, pa.binary())], [FILE, LINE_NO, DATA]
            )

    ship_package(body.sparkSession)
    return body.select(FILE, IDX, T, "k").mapInArrow(run, f"{FILE} string, {LINE_NO} long, {DATA} binary")


def _whole(body: DataFrame, data: Column) -> DataFrame:
    """Files (file) with one content each."""
    return body.select(FILE).distinct().select(FILE, F.lit(0).cast("long").alias(LINE_NO), data.alias(DATA))


SLOT_TEXT = (
    "[chan2]\n45\n[chan1]\n19\n[chan3]\n99\n[chan5]\n20\r\n[chan4]\n17\n[chan6]\n1\n[chan8]\n47\n"
    "[chan7]\n32\n[ValU]\n0\n"
)
_SLOT_CHANNELS = """(VALUES (1, 'Coolant Temp', '°C', 1.0), (2, 'AFR', 'AFR', 0.1), (3, 'Channel 3 (ID 99)', '', 1.0),
  (4, 'Battery', 'V', 0.01), (5, 'RPM', 'RPM', 1.0), (6, 'TPS', '%', 0.1), (7, 'MAP', 'kPa', 0.1), (8, 'Lambda', 'λ', 0.01))
  c(pos, name, unit, scale)"""

#: The folder of each kind of file, by log_id % 8.
FOLDERS = (
    "plain", "held/long title", "clock 100%/[a]{b}", "calendar/ä,ö", "records/*x*", "odd bytes", "cut records", "damaged",
)
PAD = "long line " * 60


def _named(rec: DataFrame, kind: int, suffix: str) -> DataFrame:
    mine = rec.filter(F.col(LOG) % 8 == kind)
    return mine.withColumn(FILE, F.concat(F.lit(f"{FOLDERS[kind]}/log "), F.col(LOG), F.lit(suffix)))


def _folder_rows(spark: SparkSession, sf: str) -> DataFrame:
    rec = _stamped(spark, sf)
    k, us = F.col("k").cast("int").cast("string"), F.col("us")
    cents = F.round(F.col("value") * 100).cast("long")

    def lines(kind: int, line: Column, header: list[str | bytes]) -> DataFrame:
        return _text(_named(rec, kind, ".csv").select(FILE, IDX, line.alias("line")), header)

    clocked = F.concat(_clock(us), F.lit(","), k, F.lit(", "), cents)
    types = ["Type : EngineSpeed", "Channel : Oil Pressure", "Type : Pressure"]
    held = F.concat(
        _seconds_text(F.round(F.col(T) * 1e6).cast("long")), F.lit(";"), F.col("value").cast("string"), F.lit(";"),
        F.when(F.col("k") % 2 == 1, F.lit("")).otherwise(k),
    )
    ms = F.floor(F.round(F.col(T) * 1e6).cast("long") / 1000) + 500
    stamp = F.date_format(F.timestamp_micros("us"), "EEE MMM dd HH:mm:ss yyyy")
    records, cut = (_named(rec, kind, ".lg1") for kind in (4, 6))
    slots = F.lit(SLOT_TEXT.encode())
    damage = [b"HEPS\x00\x01", b"MLVLG\x00\x00", b"no log at all\n\xff\xfe\n"]
    parts = [
        lines(0, clocked, ["%DataLog%", "Channel : Engine Speed", *types]),
        lines(1, held, [f"TIME;engine/{PAD}/rpm;sensors/tps1"]),
        lines(2, F.concat(ms, F.lit(","), F.col("value").cast("string")), [f"Time {PAD},Engine Speed (rpm)"]),
        lines(3, F.concat(stamp, F.lit(", "), k, F.lit(", "), F.col("value").cast("string")),
              [CALENDAR_HEADER[0] + PAD, *CALENDAR_HEADER[1:]]),
        _packed(records),
        _whole(_named(rec, 4, ".LG2"), slots),
        lines(5, clocked, [b"Channel : Engine\xffSpeed", *types]),
        # the last record is cut short
        _packed(cut).unionByName(
            cut.groupBy(FILE).agg(F.count("*").alias(LINE_NO)).select(FILE, LINE_NO, F.lit(b"12345").alias(DATA))
        ),
        _whole(_named(rec, 6, ".lg2"), slots),
    ]
    for i, content in enumerate(damage):
        parts.append(_whole(_named(rec, 7, ".csv").filter(F.col(LOG) % 3 == i), F.lit(content)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def log_folder(spark: SparkSession, sf: str) -> str:
    """The folder with the files of all logs, written once like any folder of logger exports."""
    return _written(spark, sf, "folder", _folder_rows)


def _written(spark: SparkSession, sf: str, label: str, rows) -> str:  # noqa: ANN001
    def build() -> DataFrame:
        folder = scratch_dir(spark, f"{label}-files")
        return write_files(rows(spark, sf), folder).withColumn("folder", F.lit(folder))

    return ingest_once(spark, sf, label, build).select("folder").first()[0]


def _relative(path: str, folder: str) -> Column:
    """The name below the folder; the listing escapes it."""
    return F.substring_index(F.url_decode(path), f"/{os.path.basename(folder.rstrip('/'))}/", -1)


@query(
    "ingest_folder_all",
    f"""WITH {_CLOCKED}, w AS (SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
   floor(epoch_us(ts) / 1e6) AS s FROM events),
d AS (SELECT j.*, w.s - first_value(w.s) OVER (PARTITION BY j.log_id ORDER BY j.idx) AS days FROM j JOIN w ON w.log_id = j.log_id AND w.idx = j.idx),
h AS (SELECT *, coalesce(last_value(CASE WHEN k % 2 = 0 THEN k END IGNORE NULLS)
        OVER (PARTITION BY log_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS tps,
      45292.0 + t / 86400.0 / 100.0 AS ole FROM d),
g AS (SELECT *, ole - first_value(ole) OVER (PARTITION BY log_id ORDER BY idx) AS span FROM h),
r AS (
SELECT 'plain/log ' || log_id || '.csv' AS file, idx, rel AS t, v.channel, v.value FROM g,
  LATERAL (VALUES ('Engine Speed', k), ('Oil Pressure', round(value * 100) / 10 - 101.3)) v(channel, value) WHERE log_id % 8 = 0
UNION ALL SELECT 'held/long title/log ' || log_id || '.csv', idx, t, v.channel, v.value FROM g,
  LATERAL (VALUES ('rpm', value), ('tps1', tps)) v(channel, value) WHERE log_id % 8 = 1
UNION ALL SELECT 'clock 100%/[a]{{b}}/log ' || log_id || '.csv', idx, (floor(round(t * 1e6) / 1000) + 500) / 1000.0 - 0.5,
  'Engine Speed', value FROM g WHERE log_id % 8 = 2
UNION ALL SELECT 'calendar/ä,ö/log ' || log_id || '.csv', idx, days, v.channel, v.value FROM g,
  LATERAL (VALUES ('Notch', k), ('Speed', value)) v(channel, value) WHERE log_id % 8 = 3
UNION ALL SELECT 'records/*x*/log ' || log_id, idx, span * 24.0 * 60.0 * 60.0, c.name, k * c.pos * c.scale FROM g, {_SLOT_CHANNELS} WHERE log_id % 8 = 4
UNION ALL SELECT 'odd bytes/log ' || log_id || '.csv', idx, rel, v.channel, v.value FROM g,
  LATERAL (VALUES ('Engine' || chr(65533) || 'Speed', k), ('Oil Pressure', round(value * 100) / 10 - 101.3)) v(channel, value) WHERE log_id % 8 = 5)
SELECT file, idx, {r6('t')} AS t, channel, {r6('value')} AS value FROM r""",
)
def ingest_folder_all(spark, sf):
    """Files of all formats in nested folders of odd names, with long first lines, invalid bytes and damage."""
    folder = log_folder(spark, sf)
    samples, _ = files.ingest_folder(spark, folder)
    return samples.select(
        _relative(LOG, folder).alias("file"), IDX, rounded(F.col(T)).alias(T), CHANNEL,
        rounded(F.col(VALUE)).alias(VALUE),
    )


@query(
    "ingest_folder_rejects",
    """WITH l AS (SELECT DISTINCT user_id AS log_id FROM events)
SELECT 'cut records/log ' || log_id || '.lg1' AS file, 'keyvalue' AS format,
  'neither whole records nor slots; no samples found as keyvalue' AS reason FROM l WHERE log_id % 8 = 6
UNION ALL SELECT 'cut records/log ' || log_id || '.lg2', 'fixedrecord',
  'no records: the slot dictionary, the record file, its dates or spacing' FROM l WHERE log_id % 8 = 6
UNION ALL SELECT 'damaged/log ' || log_id || '.csv', CASE log_id % 3 WHEN 0 THEN 'hlgzip' WHEN 1 THEN 'mlg' ELSE 'keyvalue' END,
  CASE log_id % 3 WHEN 0 THEN 'proprietary .hlgzip file: export it as CSV first' WHEN 1 THEN 'no decoder for .mlg files'
    ELSE 'no samples found as keyvalue' END FROM l WHERE log_id % 8 = 7""",
)
def ingest_folder_rejects(spark, sf):
    """The files of the same folder that give no sample, and why."""
    folder = log_folder(spark, sf)
    _, rejects = files.ingest_folder(spark, folder)
    return rejects.select(_relative("path", folder).alias("file"), "format", "reason")


def _record_rows(spark: SparkSession, sf: str) -> DataFrame:
    rec = tables.event_records(spark, sf)
    body = rec.withColumn(FILE, F.concat(F.col(LOG).cast("string"), F.lit(".lg1")))
    lists = rec.withColumn(FILE, F.concat(F.col(LOG).cast("string"), F.lit(".lg2")))
    return _packed(body).unionByName(_whole(lists, F.lit(SLOT_TEXT.encode())))


def record_folder(spark: SparkSession, sf: str) -> str:
    """The folder with a record file and a slot dictionary of each log, written once."""
    return _written(spark, sf, "records", _record_rows)


@query(
    "ingest_fixed_records",
    f"""WITH {EVENTS_CTE}, g AS (SELECT CAST(log_id AS VARCHAR) AS log_id, idx, 45292.0 + t / 86400.0 / 100.0 AS ole, k FROM e),
b AS (SELECT *, first_value(ole) OVER (PARTITION BY log_id ORDER BY idx) AS ole0 FROM g)
SELECT log_id, idx, {r6('(ole - ole0) * 24.0 * 60.0 * 60.0')} AS t, c.name AS channel, c.unit, {r6('k * c.pos * c.scale')} AS value
FROM b, {_SLOT_CHANNELS}""",
)
def ingest_fixed_records(spark, sf):
    """One record file and one slot dictionary for each log."""
    folder = record_folder(spark, sf)
    got = files.fixed_records(files.route(files.file_heads(spark, folder)))
    names = got.channels.select(LOG, F.col("name").alias(CHANNEL), "unit")
    out = got.samples().join(names, [LOG, CHANNEL])
    return out.withColumns(
        {LOG: _relative(LOG, folder), T: rounded(F.col(T)), VALUE: rounded(F.col(VALUE))}
    )


@query(
    "route_formats",
    """WITH h AS (SELECT event_id, CASE CAST(event_id % 12 AS INTEGER)
  WHEN 0 THEN 'hlgzip' WHEN 1 THEN 'daq' WHEN 2 THEN 'xrk' WHEN 3 THEN 'mlg' WHEN 4 THEN 'llg' WHEN 5 THEN 'fixedrecord'
  WHEN 6 THEN 'holdfill' WHEN 7 THEN 'msclock' WHEN 8 THEN 'calendar' WHEN 9 THEN 'fixedrecord' WHEN 10 THEN 'keyvalue' ELSE 'keyvalue' END AS format FROM events)
SELECT event_id, format, format IN ('hlgzip', 'daq', 'xrk', 'mlg', 'llg') AS rejected FROM h""",
)
def route_formats(spark, sf):
    """One invented content per event, routed by what it begins with."""
    slots = "".join(f"[chan{i}]\n{i}\n" for i in range(1, 9)).encode()
    contents = [
        b"HEPSdata", b"EMERALD1", b"<hCNFxyz", b"MLVLG\x00\x00", b"\x01\x02\x03\x04lf3\x00", slots,
        b"TIME;a;b\n0;1;2", b"Time (msec),A (rpm)\n", b"TimeStamp: x\r\n Customer: y\r\n",
        struct.pack("<d8H", 45292.5, *range(8)) * 2, b"%DataLog%\nDataLogVersion : 1.1", b"no header",
    ]
    exts = ["csv", "csv", "xrk", "mlg", "llg", "LG2", "csv", "csv", "csv", "lg1", "csv", "txt"]
    pick = (F.col("event_id") % 12 + 1).cast("int")
    ext = F.element_at(F.array(*[F.lit(e) for e in exts]), pick)
    size = F.element_at(F.array(*[F.lit(len(c)).cast("long") for c in contents]), pick)
    name = F.concat(F.lit("/logs/"), F.col("event_id"), F.lit("."), ext)
    ev = tables.read_table(spark, sf, "events").select(
        name.alias("path"), name.alias("file"), size.alias("length")
    )

    def content(name: str) -> io.BytesIO:
        return io.BytesIO(contents[int(os.path.basename(name).split(".")[0]) % 12])

    ship_package(spark)
    routed = files.route(store.sniffed(ev, content))
    return routed.select(
        F.regexp_extract("path", r"(\d+)\.", 1).cast("long").alias("event_id"), "format",
        F.col("reject").isNotNull().alias("rejected"),
    )
