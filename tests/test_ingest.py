"""Real files through routing, parsers and folder ingest; tables and names."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemetra.functions import decode
from telemetra.operators import binning, lookup, names
from telemetra.sources import files, store, text

KEYVALUE = """%DataLog%
DataLogVersion : 1.1
Channel : RPM
ID : 384
Type : EngineSpeed
DisplayMaxMin : 20000,0
Channel : Coolant
Type : Temperature

14:15:46.000,1000,3000
14:15:46.020,1010,3010
bad row
14:15:46.040,abc,3020
14:15:46.060,1030,3030,99
14:15:x.080,1040,3040
"""


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_keyvalue_file(spark, tmp_path):
    got = text.parse_keyvalue(text.read_lines(spark, write(tmp_path, "a.csv", KEYVALUE)))
    channels = got.channels.orderBy("channel_idx").collect()
    assert [(c.name, c.type_name, c.unit, c.display_max) for c in channels] == [
        ("RPM", "EngineSpeed", "RPM", 20000.0), ("Coolant", "Temperature", "K", None),
    ]
    rec = got.records.orderBy("idx").collect()
    assert [(r.idx, round(r.t, 6), r.cells[:2]) for r in rec] == [
        (0, 0.0, [1000.0, 300.0]), (1, 0.02, [1010.0, 301.0]), (2, 0.06, [1030.0, 303.0]),
    ]
    assert got.logs.first()["meta"] == {"DataLogVersion": "1.1"}
    assert got.samples().count() == 6  # the extra cell has no channel


def test_keyvalue_base_time_is_first_parsed_row(spark, tmp_path):
    body = "Channel : A\nChannel : B\n00:00:10.0,1\n00:00:11.0,1,2\n"
    got = text.parse_keyvalue(text.read_lines(spark, write(tmp_path, "a.csv", body)))
    assert rows(got.records, "idx", "t") == [(0, 1.0)]


def test_keyvalue_without_header_keeps_rows(spark, tmp_path):
    got = text.parse_keyvalue(text.read_lines(spark, write(tmp_path, "a.csv", "00:00:01,5\n00:00:02,x\n")))
    assert rows(got.records, "idx", "t", "cells") == [(0, 0.0, [5.0])]


def test_holdfill_file(spark, tmp_path):
    body = "TIME;engine/rpm;sensors/tps1;fuel/pressure\n0.5;1000;;\n0.6;;5\n0.7;x;6;300\n\nbad;1;1;1\n0.8;1200\n"
    got = text.parse_holdfill(text.read_lines(spark, write(tmp_path, "h.csv", body)))
    assert rows(got.channels.orderBy("channel_idx"), "name", "unit") == [("rpm", "RPM"), ("tps1", "%"), ("pressure", "kPa")]
    assert rows(got.records.orderBy("idx"), "t", "cells") == [
        (0.5, [1000.0, 0.0, 0.0]), (0.6, [1000.0, 5.0, 0.0]), (0.7, [1000.0, 6.0, 300.0]), (0.8, [1200.0, 6.0, 300.0]),
    ]
    tabs = text.parse_holdfill(text.read_lines(spark, write(tmp_path, "t.csv", "TIME\ta/b\n1\t2\n")))
    assert rows(tabs.records, "t", "cells") == [(1.0, [2.0])]


def test_msclock_files(spark, tmp_path):
    comma = "Time (msec),Engine Speed (rpm),A/F Sensor\n100,850,14.7\n120,,\n140,900\n"
    got = text.parse_msclock(text.read_lines(spark, write(tmp_path, "c.csv", comma)))
    assert rows(got.channels.orderBy("channel_idx"), "name", "unit") == [("Engine Speed", "rpm"), ("A/F Sensor", "AFR")]
    assert [(round(t, 9), c) for t, c in rows(got.records.orderBy("idx"), "t", "cells")] == [
        (0.0, [850.0, 14.7]), (0.02, [0.0, 0.0]), (0.04, [900.0, 0.0]),
    ]
    regional = "Time (msec);Speed (km/h);AFR\n0;12,5;14,00\n20;13,0;12.5d\n"
    got = text.parse_msclock(text.read_lines(spark, write(tmp_path, "s.csv", regional)))
    assert rows(got.records.orderBy("idx"), "cells") == [([12.5, 14.0],), ([13.0, 0.0],)]


def test_calendar_file(spark, tmp_path):
    body = (
        "TimeStamp: Sat Nov 15 19:00:03 2025\nCustomer: X\nUnitNumber: 1\nSoftwarePartNumber: 2\n"
        "SoftwareVersion: 3\n\nTimeStamp, A, B, C\n"
        "Sat Nov 15 19:00:03 2025, 1, 1, 1\nSat Nov 15 19:00:05 2025, 2, x, 2\n"
        "Sun Nov 16 00:00:03 2025, 3, 3, 3\nSun Foo 16 00:00:03 2025, 3, 3, 3\n"
    )
    got = text.parse_calendar(text.read_lines(spark, write(tmp_path, "l.csv", body)))
    assert rows(got.channels.orderBy("channel_idx"), "name") == [("A",), ("B",), ("C",)]
    assert rows(got.records.orderBy("idx"), "t", "cells") == [(0.0, [1.0] * 3), (18000.0, [3.0] * 3)]
    assert got.logs.first()["meta"]["UnitNumber"] == "1"


@pytest.mark.parametrize(
    "cell,want",
    [("12.5", 12.5), ("12.5d", None), ("1f", None), ("-3e2", -300.0), ("0x1p3", None), ("", None),
     (".5", 0.5), ("5.", 5.0), ("inf", float("inf")), ("1 2", None), ("+7", 7.0)],
)
def test_strict_numbers(spark, cell, want):
    assert spark.range(1).select(text.number(F.lit(cell))).first()[0] == want


def test_split_file_keeps_order(spark, tmp_path):
    body = "TIME;v\n" + "".join(f"{i / 10};{i}\n" for i in range(6000))
    path = write(tmp_path, "big.csv", body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = text.parse_holdfill(text.read_lines(spark, path))
        assert text.read_lines(spark, path).rdd.getNumPartitions() > 5
        out = got.records.orderBy("idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.idx for r in out] == list(range(6000))
    assert [r.cells[0] for r in out] == [float(i) for i in range(6000)]


def fixed_file(times, value=100):
    return b"".join(struct.pack("<d8H", 46022.5 + t / 86400, *[value + c for c in range(8)]) for t in times)


def test_folder_ingest(spark, tmp_path):
    write(tmp_path, "kv.csv", KEYVALUE)
    write(tmp_path, "hold.csv", "TIME;a\n0;1\n1;2\n")
    write(tmp_path, "ms.csv", "Time (msec),A (rpm)\n0,1\n")
    write(tmp_path, "loco.csv", "TimeStamp: x\nCustomer: y\nU: 1\nS: 2\nV: 3\nTimeStamp, A\nMon Nov 17 00:00:00 2025, 4\n")
    write(tmp_path, "x.hlgzip", b"HEPS....")
    write(tmp_path, "y.daq", b"EMERALD...")
    write(tmp_path, "z.xrk", b"<hCNFabc")
    write(tmp_path, "w.llg", b"\x01\x02\x03\x04lf3\x00\xff\xfe")
    write(tmp_path, "drive.lg1", fixed_file([0, 0.5, 1.0]))
    write(tmp_path, "drive.lg2", "[chan1]\n20\n[chan2]\n1\n[chan3]\n200\n[chan4]\n4\n")
    write(tmp_path, "broken.csv", b"Channel : B\xff\n00:00:01,1\n")
    samples, rejects = files.ingest_folder(spark, str(tmp_path))
    got = {}
    for r in samples.collect():
        got.setdefault(r.log_id.rsplit("/", 1)[1], []).append((r.idx, r.channel, r.value))
    assert sorted(got) == ["broken.csv", "drive", "hold.csv", "kv.csv", "loco.csv", "ms.csv"]
    first = {c: round(v, 9) for i, c, v in got["drive"] if i == 0}
    assert first == {"RPM": 100.0, "TPS": 10.1, "Channel 3 (ID 200)": 102.0, "Lambda": 0.103}
    assert len(got["drive"]) == 12 and got["broken.csv"] == [(0, "B�", 1.0)]
    why = {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}
    assert sorted(why) == ["w.llg", "x.hlgzip", "y.daq", "z.xrk"]
    assert "CSV" in why["x.hlgzip"] and "CSV" in why["y.daq"]


def test_record_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    n = 5120
    record = np.zeros(n, store.RECORD)
    record["ole"] = 46022.5 + np.arange(n) / 86400
    record["raw"] = np.arange(n)[:, None] % 5000 + np.arange(8)
    late = record.copy()
    late["ole"][0] = 1.0
    slots = "[chan1]\n20\n[chan2]\n1\n[chan3]\n200\n[chan4]\n4\n"
    write(tmp_path, "a b,[1]{2}*.lg1", record.tobytes())
    write(tmp_path, "late.lg1", late.tobytes())
    for k in range(30):
        write(tmp_path, f"small{k}.LG1", record[: k + 1].tobytes())
        write(tmp_path, f"small{k}.lg2", slots)
    for name in ("a b,[1]{2}*.lg2", "late.lg2"):
        write(tmp_path, name, slots)
    want = []
    for stem, size in [("a b,[1]{2}*", n), *((f"small{k}", k + 1) for k in range(30))]:
        for c, (name, scale) in enumerate([("RPM", 1.0), ("TPS", 0.1), ("Channel 3 (ID 200)", 1.0), ("Lambda", 0.001)]):
            want += [(stem, i, round(float(i), 3), name, round((i % 5000 + c) * scale, 6)) for i in range(size)]
    for ranges in (store.RANGE_RECORDS, 1000):
        monkeypatch.setattr(store, "RANGE_RECORDS", ranges)
        samples, rejects = files.ingest_folder(spark, str(tmp_path))
        got = samples.select(F.regexp_extract(F.url_decode("log_id"), "([^/]*)$", 1), "idx", F.round("t", 3), "channel", F.round("value", 6))
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert sorted(r.path.rsplit("/", 1)[1] for r in rejects.collect()) == ["late.lg1", "late.lg2"]


def test_ranges_of_all_files_are_one_plan(spark, tmp_path, monkeypatch):
    """Tasks follow the bytes, not the files."""
    monkeypatch.setattr(store, "RANGE_RECORDS", 100)
    monkeypatch.setattr(store, "TASK_BYTES", 24 * 500)
    rows = []
    for k, n in enumerate((1, 7, 5000)):
        path = write(tmp_path, f"f{k}.lg1", fixed_file(range(n)))
        rows.append((f"f{k}", path, 24 * n, 46022.5))
    table = spark.createDataFrame(rows, "log_id string, file string, length long, first_time double")
    raw = store.records_of(table)
    assert raw.rdd.getNumPartitions() == 10
    per_task = raw.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in per_task) <= 700
    assert raw.groupBy("log_id").agg(F.max("idx").alias("m")).orderBy("log_id").select("m").collect() == [(0,), (6,), (4999,)]


BIG = b"x" * 200_000


@pytest.mark.parametrize(
    "content,want",
    [(b"TIME;a\n", "holdfill"), (b"TIME\ta", "holdfill"), (b" TIME;a\n", None), (b"time", None), (b"", None), (b"\n", None),
     (b"Time " + BIG + b";a\n", "msclock"), (b"Time " + BIG + b"\n0,1\n", None), (b"TIMESTAMP,a", "msclock"),
     (b"TimeStamp: a\nCustomer: b", "calendar"), (b"  TimeStamp:" + BIG + b"\r\n \t Customer:\n", "calendar"),
     (b"TimeStamp: a, b\nCustomer: b", "msclock"), (b"TimeStamp: a\nUnit: 1\nCustomer: b", None),
     (b"\xff\xfeTime,", None), ("\u00a0TimeStamp:\nCustomer:".encode(), "calendar"), (b"TimeStamp: a", None),
     (b" " * 70_000 + b"TimeStamp:\nCustomer:", "calendar"), (b"TimeStamp: " + b"x" * 65_525 + b"\nCustomer:", "calendar")],
)
def test_first_lines_decide_whatever_their_length(content, want):
    assert store.opening(io.BytesIO(content)) == want


def test_slot_marks_over_blocks():
    names = [f"[chan{i}]".encode() for i in range(1, 9)]
    pad = b"." * (store.BLOCK - 3)
    assert store.slot_marks(io.BytesIO(names[0] + pad + names[1] + pad + names[4])) == 3
    assert store.slot_marks(io.BytesIO(b"".join(names[1:]))) == 0
    assert store.slot_marks(io.BytesIO(b"".join(names) + b"\xff")) == 0
    assert store.slot_marks(io.BytesIO(b"".join(names) + "é".encode()[:1])) == 0


def test_slot_lists_take_the_next_line_along(spark):
    lines = ["[chan1]", "[chan2]", "7", "[chan+3]", " 9 ", "[chan4]", "x", "[chan900]", "5", "[chan6]", "+8", "[chan5]", "300", "[chan0]", "1"]
    table = spark.createDataFrame([("a", i * 10, t) for i, t in enumerate(lines)], "log_id string, line_no long, line string")
    got = files.slot_lists(table).orderBy("channel_idx").collect()
    assert [(r.slot, r.channel_id) for r in got] == [(0, 1), (3, 9), (6, 8)]


def test_folder_is_read_by_name(spark, tmp_path):
    """A parser gets its own files only, and files of a known format are not opened by others."""
    for k in range(3):
        write(tmp_path, f"h{k}.csv", "TIME;a\n0;1\n")
    write(tmp_path, "k.csv", "Channel : A\n00:00:01,1\n")
    samples, rejects = files.ingest_folder(spark, str(tmp_path))
    assert rejects.isEmpty() and samples.count() == 4
    empty = tmp_path / "none"
    empty.mkdir()
    samples, rejects = files.ingest_folder(spark, str(empty))
    assert samples.isEmpty() and rejects.isEmpty()


def test_lines_of_small_files_are_those_of_the_text_reader(spark, tmp_path):
    """Many files are a few tasks, whatever ends their lines."""
    contents = [
        b"", b"\n", b"a", b"a\n", b"a\r\nb\rc\n\nd", b"\xef\xbb\xbfh\nx\xefy\x0bz\x0c\x1c\xc2\x85\xe2\x80\xa8w\n", b"\xff\xfe\xc3(\n\xe2\x82",
        b"a\n\xef\xbb\xbfb\r\r\n", b"x" * 100000 + b"\n\x00",
    ]
    for k in range(90):
        (tmp_path / f"log [{k}] %.csv").write_bytes(contents[k % len(contents)])
    heads = files.file_heads(spark, str(tmp_path))
    lines = store.whole_lines(heads)
    assert lines.rdd.getNumPartitions() == 2
    names = [store.literally(r["file"]) for r in heads.collect()]
    want, got = (
        sorted((r.log_id, n, r.line) for n, r in enumerate(t.orderBy("log_id", "line_no").collect()))
        for t in (text.read_lines(spark, names), files.lines_of(heads))
    )
    assert got == want and len(got) >= 90


def test_manifest_skips_loaded(spark, tmp_path):
    a = write(tmp_path, "a.csv", "TIME;a\n0;1\n")
    write(tmp_path, "b.csv", "TIME;a\n0;1\n")
    routed = files.route(files.file_heads(spark, str(tmp_path)))
    manifest = routed.filter(F.col("path").endswith(a)).select("path")
    assert [r.path.rsplit("/", 1)[1] for r in files.unseen(routed, manifest).collect()] == ["b.csv"]


def test_lookup_table_text(spark, tmp_path):
    body = "\t10\t20\t1,000\n5\t1\t2\t3\n\n4\t4\tx\t1,234.56\n"
    path = write(tmp_path, "t.tsv", body)
    lines = text.read_lines(spark, path).withColumnRenamed("log_id", "table_id")
    t = files.parse_lookup_tables(lines).first()
    assert (t.x_breaks, t.y_breaks) == ([10.0, 20.0, 1000.0], [5.0, 4.0])
    assert t["data"] == [[1.0, 2.0, 3.0], [4.0, 1234.56]]


def test_resample_flips_and_interpolates(spark):
    t = spark.createDataFrame([("t", [[1.0, 2.0], [3.0, 4.0]])], "table_id string, data array<array<double>>")
    same = {(r.y_bin, r.x_bin): r.value for r in lookup.resample(t, 2, 2).collect()}
    assert same == {(0, 0): 3.0, (0, 1): 4.0, (1, 0): 1.0, (1, 1): 2.0}
    up = {(r.y_bin, r.x_bin): r.value for r in lookup.resample(t, 3, 3).collect()}
    assert up[(1, 1)] == 2.5 and up[(0, 1)] == 3.5 and up[(2, 2)] == 2.0


@pytest.mark.parametrize(
    "op,h,t,want",
    [("add", 2.0, 3.0, 5.0), ("subtract", 2.0, 3.0, -1.0), ("multiply", 2.0, 3.0, 6.0), ("divide", 3.0, 2.0, 1.5),
     ("divide", 3.0, 0.0, 0.0), ("add", None, 3.0, 3.0), ("add", None, 0.0, None), ("multiply", None, 2.0, 0.0)],
)
def test_cell_operations(spark, op, h, t, want):
    c = lookup.apply_operation(F.lit(h).cast("double"), F.lit(t), op)
    assert spark.range(1).select(c).first()[0] == want


def test_histogram_text_and_roundtrip(spark, logs, tmp_path):
    rec = logs({"a": {"x": [0, 0, 4, 10], "y": [0, 0, 8, 8], "z": [1, 2, 0.125, 7]}})
    out = lookup.histogram_lines(rec, "x", "y", "z", 4, 4)
    lines = [r.line for r in out.orderBy("line_no").collect()]
    assert lines == [
        "\t1.2\t3.8\t6.2\t8.8", "7.0\t0.00\t0.12\t0.00\t7.00", "5.0\t0.00\t0.00\t0.00\t0.00",
        "3.0\t0.00\t0.00\t0.00\t0.00", "1.0\t1.50\t0.00\t0.00\t0.00",
    ]
    target = str(tmp_path / "out")
    lookup.write_lines(out, target)
    back = text.read_lines(spark, target + "/log_id=a").withColumnRenamed("log_id", "table_id")
    t = files.parse_lookup_tables(back).first()
    assert t["data"][0] == [0.0, 0.12, 0.0, 7.0] and t.y_breaks == [7.0, 5.0, 3.0, 1.0]


def test_bins_at_the_edges(logs):
    rec = logs({"a": {"x": [0, 1, 2, 3, 4], "y": [5, 5, 5, 5, 5]}})
    cells = {(r.x_bin, r.y_bin): r.hits for r in binning.hist2d(rec, "x", "y", columns=4, rows=4).collect()}
    assert cells == {(0, 0): 1, (1, 0): 1, (2, 0): 1, (3, 0): 2}
    assert binning.grid_shape(32) == (32, 32) and binning.grid_shape(16, 300, 2) == (256, 4)
    # An inverted custom range still filters, with automatic bounds.
    odd = binning.hist2d(rec, "x", "y", columns=4, rows=4, x_limits=(3.0, 1.0))
    assert odd.groupBy().sum("hits").first()[0] == 5
    inside = binning.hist2d(rec, "x", "y", columns=4, rows=4, x_limits=(1.0, 3.0))
    assert inside.groupBy().sum("hits").first()[0] == 3


def test_filters_keep_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (9.0,)], "x double")
    kept = binning.apply_filters(df, [binning.RangeFilter("x", 0.0, 5.0)]).collect()
    assert sorted(str(r.x) for r in kept) == ["1.0", "nan"]


GROUPS = {
    "AFR": ["Act_AFR", "wideband o2"], "Coolant Temp": ["CLT", "a/CoolantTemp"], "RPM": ["rpm", "engine/rpm"],
    "Vehicle Speed": ["VSS", "speed"], "Battery V": ["VBAT"], "TPS": ["tps1"], "MAP": ["Map"],
    "Lambda 1": ["LAMBDA"], "EGT": ["egt"], "Gear": ["Current Gear"], "IAT": ["iat"],
}


def test_standard_names(spark):
    asked = [(n,) for ns in GROUPS.values() for n in ns] + [("No Such",)]
    got = {r.name: (r.normal_name, r.is_normalized) for r in names.normalise_names(spark.createDataFrame(asked, "name string")).collect()}
    for target, sources in GROUPS.items():
        for s in sources:
            assert got[s] == (target, True)
    assert got["No Such"] == ("No Such", False)
    assert len(names.STANDARD_NAMES) == 29


def test_spec_documents(spark, tmp_path):
    one = "id: one\nvendor: Acme\nfile_format: {type: csv, extensions: [.CSV]}\nchannels:\n- {id: r, name: Rpm, category: engine, data_type: float, unit: rpm, min: 0, max: 9000, precision: 0, source_names: [RPM, Revs]}\n"
    two = '{"id": "two", "vendor": "ACME", "file_format": {"extensions": [".log"]}, "channels": [{"id": "r2", "name": "Revs Two", "category": "speed", "unit": "rpm", "source_names": ["revs"]}]}'
    write(tmp_path, "a.yaml", one)
    write(tmp_path, "b.json", two)
    specs = files.read_specs(spark, str(tmp_path))
    d = {r.key: r.spec.name for r in names.spec_dictionary(specs).collect()}
    assert d == {"rpm": "Rpm", "revs": "Revs Two"}
    assert names.specs_by_vendor(specs, "acme").count() == 2
    assert [r.id for r in names.specs_by_extension(specs, "CSV").collect()] == ["one"]
    assert [r.category for r in names.categories(specs).collect()] == ["engine", "speed"]
    assert names.specs_by_id(specs, "two").count() == 1


def test_virtual_channel_index(spark):
    samples = spark.createDataFrame(
        [("a", 0, 0.0, "x", 1.0), ("a", 0, 0.0, "y", 2.0), ("a", 0, 0.0, "calc", 3.0)],
        "log_id string, idx long, t double, channel string, value double",
    )
    channels = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "log_id string, channel_idx int, name string")
    computed = spark.createDataFrame([("a", 0, "calc")], "log_id string, computed_idx int, name string")
    pick = [names.channel_by_index(samples, channels, i, computed).collect() for i in range(4)]
    assert [p[0].value if p else None for p in pick] == [1.0, 2.0, 3.0, None]


def test_unit_rule_order(spark):
    df = spark.createDataFrame(
        [("ecu/torqueEstimation/x",), ("dbw/target",), ("wheelSpeed",), ("speedRpmTarget",), ("gearRatio",)], "path string"
    )
    got = [r[0] for r in df.select(decode.unit_by_rules(decode.HOLDFILL_UNITS, decode.path_name(F.col("path")), F.col("path"))).collect()]
    assert got == ["%", "%", "km/h", "RPM", ""]


def test_intake_loads_each_file_once(spark, tmp_path):
    from telemetra.streaming.intake import follow_folder

    inbox, table, memory = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "memory")
    inbox.mkdir()
    write(inbox, "a.csv", "TIME;x\n0;1\n1;2\n")

    def drain():
        follow_folder(spark, str(inbox), table, "holdfill", memory).awaitTermination()
        got = spark.read.parquet(table).collect()
        return sorted((r.log_id.rsplit("/", 1)[1], r.idx, r.value) for r in got)

    assert drain() == [("a.csv", 0, 1.0), ("a.csv", 1, 2.0)]
    write(inbox, "b.csv", "TIME;x\n5;9\n")
    assert drain() == [("a.csv", 0, 1.0), ("a.csv", 1, 2.0), ("b.csv", 0, 9.0)]


def test_every_file_gives_samples_or_a_reject(spark, tmp_path):
    import struct

    body = "Time (msec),RPM (rpm)\n0,1\n10,2\n"
    names = ["plain.csv", "with space.csv", "50%.csv", "öl.csv", "sub/nested.csv"]
    (tmp_path / "sub").mkdir()
    for name in names:
        (tmp_path / name).write_text(body)
    record = struct.pack("<d8H", 46022.5, *range(8))
    (tmp_path / "alone.lg1").write_bytes(record)
    (tmp_path / "bad.lg1").write_bytes(struct.pack("<d8H", 1.0, *range(8)))
    (tmp_path / "junk.txt").write_text("nothing here\n")
    samples, rejects = files.ingest_folder(spark, str(tmp_path))
    per_file = {r["log_id"]: r["count"] for r in samples.groupBy("log_id").count().collect()}
    assert len(per_file) == len(names) and set(per_file.values()) == {2}
    gone = {r["path"].rsplit("/", 1)[1] for r in rejects.collect()}
    assert gone == {"alone.lg1", "bad.lg1", "junk.txt"}


def test_folder_is_followed_without_a_checkpoint_argument(spark, tmp_path):
    from telemetra.streaming.intake import follow_folder

    inbox, table = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    for k in range(3):
        (inbox / f"f{k}.csv").write_text("TIME;a/b\n1;2\n2;3\n")
        follow_folder(spark, str(inbox), table, "holdfill").awaitTermination()
    assert spark.read.parquet(table).count() == 6


def test_changed_source_is_ingested_again(spark, tmp_path):
    from telemetra.session import ingest_once

    source = str(tmp_path / "s.parquet")
    for n in (3, 5):
        spark.range(n).write.mode("overwrite").parquet(source)
        read = lambda: spark.read.parquet(source)
        assert ingest_once(spark, source, "rows", read).count() == n


def test_staged_data_goes(spark, tmp_path):
    import os

    from telemetra import session

    old, session._SCRATCH[:] = list(session._SCRATCH), []
    kept, session._INGESTED = session._INGESTED, {}
    try:
        session.materialise(spark.range(3), "x")
        path = session._SCRATCH[-1][1].removeprefix("file://")
        assert os.path.isdir(path)
        session.drop_scratch(spark)
        assert not os.path.exists(path)
    finally:
        session._SCRATCH[:], session._INGESTED = old, kept
