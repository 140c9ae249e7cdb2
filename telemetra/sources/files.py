"""Folders of logger files: format routing, rejects, fixed records, lookup tables, specs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T
from telemetra.functions.decode import slot_channel_table
from telemetra.session import materialise, settle, ship_package
from telemetra.sources import store
from telemetra.sources.text import PARSERS, Ingest, number, read_lines

# Leading bytes of formats that are recognised but not decoded here.
EXPORT_FIRST = (("HEPS", "hlgzip"), ("EMERALD", "daq"))
UNDECODED = (("<hCNF", 0, "xrk"), ("MLVLG", 0, "mlg"), ("lf3", 4, "llg"))


def file_heads(spark: SparkSession, path: str) -> DataFrame:
    """path, file, length and the facts that routing looks at, for each file below ``path``.

    Files whose format the caller knows need no sniffing: pass them straight
    to their parser.
    """
    ship_package(spark)
    return settle(store.sniffed(store.listed(spark, path)))


def lines_of(files: DataFrame) -> DataFrame:
    """Numbered lines of listed text files (path, file, length), written once for all passes of a parser.

    Small files are read whole in tasks; large and compressed ones, whose names the driver
    holds, by Spark's text reader.
    """
    spark = files.sparkSession
    lines = store.whole_lines(files.filter(store.is_small()))
    names = [r["file"] for r in files.filter(~store.is_small()).select("file").collect()]
    if names:
        lines = lines.unionByName(read_lines(spark, [store.literally(n) for n in names]))
    return materialise(lines, "lines")


def _starts(head: Column, magic: str, offset: int = 0) -> Column:
    return F.substring(head, offset + 1, len(magic)) == F.lit(magic.encode())


def _extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def route(heads: DataFrame) -> DataFrame:
    """The files with format and reject: the first matching rule decides.

    Vendor archives are rejected with the advice to export them; recognised
    binary formats without a decoder are rejected by name; ``.lg1`` and ``.lg2`` files
    are records and slot dictionaries if they look like it; all else is text, which is
    a key-value log unless its first lines say otherwise.
    """
    head = F.col("head")
    paired = _extension(F.col("path")).isin("lg1", "lg2")
    fixed = paired & (F.col("first_time").isNotNull() | (F.col("slot_marks") >= 4))

    kind, why = None, None
    for magic, name in EXPORT_FIRST:
        hit = _starts(head, magic)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        advice = f"proprietary .{name} file: export it as CSV first"
        why = F.when(hit, advice) if why is None else why.when(hit, advice)
    for magic, offset, name in UNDECODED:
        hit = _starts(head, magic, offset) & (F.col("length") >= offset + len(magic))
        kind = kind.when(hit, name)
        why = why.when(hit, f"no decoder for .{name} files")
    kind = kind.when(fixed, "fixedrecord").otherwise(F.coalesce("opening", F.lit("keyvalue")))
    return heads.withColumns({"format": kind, "reject": why})


def rejects(routed: DataFrame) -> DataFrame:
    return routed.filter(F.col("reject").isNotNull()).select(
        "path", "format", F.col("reject").alias("reason")
    )


def unseen(routed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files not loaded before."""
    return routed.join(manifest.select("path"), "path", "left_anti")


def ingest_folder(
    spark: SparkSession, path: str, manifest: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(samples, rejects) of all files below a folder that are not in the manifest.

    Every file gives samples or a reject with its reason: by its format, or because
    its records, header or slot dictionary are missing or unusable.  The folder is
    listed and sniffed once; then each parser reads the files of its format and no others, once.
    """
    routed = route(file_heads(spark, path))
    if manifest is not None:
        routed = settle(unseen(routed, manifest))
    good = routed.filter(F.col("reject").isNull())
    found = {r["format"] for r in good.select("format").distinct().collect()}
    samples, loaded = None, None
    for kind, parse in PARSERS.items():
        if kind in found:
            got = parse(lines_of(good.filter(F.col("format") == kind)))
            samples, loaded = _also(samples, got.samples()), _also(loaded, got.loaded())
    fixed = fixed_records(routed)
    if fixed is not None:
        samples, loaded = _also(samples, fixed.samples()), _also(loaded, fixed.loaded())
    if samples is None:
        samples = spark.createDataFrame([], f"{LOG} string, {IDX} long, {T} double, channel string, value double")
        loaded = samples.select(LOG)
    return samples, rejects(routed).unionByName(_fruitless(good, loaded))


def _also(frame: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if frame is None else frame.unionByName(more)


def _fruitless(good: DataFrame, loaded: DataFrame) -> DataFrame:
    """Routed files without a sample; a slot dictionary counts with its records."""
    paired = F.col("format") == "fixedrecord"
    files = good.withColumn(LOG, F.when(paired, _stem(F.col("path"))).otherwise(F.col("path")))
    empty = files.join(loaded.distinct(), LOG, "left_anti")
    odd = _extension(F.col("path")).isin("lg1", "lg2")
    why = F.when(
        paired, F.lit("no records: the slot dictionary, the record file, its dates or spacing")
    ).when(
        odd, F.concat(F.lit("neither whole records nor slots; no samples found as "), F.col("format"))
    ).otherwise(F.concat(F.lit("no samples found as "), F.col("format")))
    return empty.select("path", "format", why.alias("reason"))


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", "")


def slot_lists(lines: DataFrame) -> DataFrame:
    """(log_id, channel_idx, slot, channel_id) from ``[chanN]`` / id line pairs.

    A slot line takes the line after it along, also if that is no id.  Slots are
    numbered in slot order.  ``lines`` has log_id, line_no, line.
    """
    numbered = Window.partitionBy(LOG).orderBy("line_no")
    slot = F.regexp_extract(F.trim("line"), r"^\[chan\+?(\d+)\]$", 1).try_cast("int")
    pairs = lines.select(
        LOG, F.row_number().over(numbered).alias("_i"),
        F.when(slot <= 255, slot).alias("slot"),
        F.trim(F.lead("line").over(numbered)).alias("_next"),
    ).filter(F.col("slot").isNotNull())
    # of slot lines in a row every second one is the other's next line
    run = F.col("_i") - F.row_number().over(Window.partitionBy(LOG).orderBy("_i"))
    place = F.row_number().over(Window.partitionBy(LOG, "_run").orderBy("_i"))
    found = (
        pairs.withColumn("_run", run)
        .withColumn("_place", place)
        .filter("_place % 2 = 1")
        .withColumn("channel_id", F.regexp_extract("_next", r"^\+?(\d+)$", 1).try_cast("int"))
        .filter(F.col("channel_id").between(0, 255))
    )
    order = Window.partitionBy(LOG).orderBy("slot", "_i")
    return found.select(
        LOG, (F.row_number().over(order) - 1).alias("channel_idx"), "slot", "channel_id"
    )


def slot_channels(slots: DataFrame) -> DataFrame:
    """Name, unit and scale per slot; unknown ids keep their number as name."""
    known = slot_channel_table(slots.sparkSession)
    both = slots.join(F.broadcast(known), "channel_id", "left")
    spare = F.format_string("Channel %d (ID %d)", "slot", "channel_id")
    return both.select(
        LOG, "channel_idx", F.coalesce("slot_name", spare).alias("name"),
        F.coalesce("unit", F.lit("")).alias("unit"), F.lit("fixedrecord").alias("type_name"),
        "channel_id", F.coalesce("scale", F.lit(1.0)).alias("scale"),
    )


def fixed_records(routed: DataFrame) -> Ingest | None:
    """The record files among routed ones with their slot dictionaries; None if there is none."""
    ship_package(routed.sparkSession)
    ext = _extension(F.col("path"))
    stem = _stem(F.col("path")).alias(LOG)
    files = settle(
        routed.filter((F.col("format") == "fixedrecord") & (ext == "lg1") & F.col("first_time").isNotNull())
        .select(stem, "file", "length", "first_time")
    )
    lists = routed.filter(F.col("reject").isNull() & (ext == "lg2")).select(stem, "path", "file", "length")
    named = settle(lists.join(files.select(LOG), LOG, "left_semi").select("path", "file", "length"))
    if named.isEmpty():
        return None
    slots = slot_lists(lines_of(named).withColumn(LOG, _stem(F.col(LOG))))
    return decode_fixed_records(files, slots)


def decode_fixed_records(files: DataFrame, slots: DataFrame) -> Ingest:
    """Scaled cells of record files (log_id, file, length, first_time) by the slot lists."""
    ship_package(files.sparkSession)
    channels = settle(slot_channels(slots))
    scales = channels.groupBy(LOG).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("channel_idx", "scale"))), lambda c: c["scale"]
        ).alias("_scales")
    )
    known = settle(files.join(scales, LOG))  # files without slots are not read
    records = store.records_of(known.drop("_scales")).join(known.select(LOG, "_scales"), LOG).select(
        LOG, IDX, T,
        F.transform("_scales", lambda s, i: F.get("raw", i) * s).alias("cells"),
    )
    logs = files.select(LOG).withColumn("format", F.lit("fixedrecord"))
    no_meta = F.create_map().cast("map<string,string>")
    return Ingest(
        logs.withColumn("meta", no_meta), channels, lambda: records, known.select(LOG).distinct()
    )


def parse_lookup_tables(lines: DataFrame) -> DataFrame:
    """Lookup tables from tab text: table_id, data rows (top first), breakpoints.

    ``lines`` has table_id, line_no, line.  The first row holds the x
    breakpoints (after a blank corner cell, if there is one), the first cell of
    each later row its y breakpoint.  Thousands commas are removed; cells that
    are no number are left out.
    """
    cells = F.split("line", "\t")

    def numbers(parts: Column) -> Column:
        parsed = F.transform(parts, lambda c: number(F.replace(F.trim(c), F.lit(","), F.lit(""))))
        return F.filter(parsed, lambda v: v.isNotNull())

    rest = F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))
    blank = F.trim(F.get(cells, 0)) == ""
    top = lines.groupBy("table_id").agg(
        F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("_no")
    ).select("table_id", "_no", numbers(F.when(blank, rest).otherwise(cells)).alias("x_breaks"))
    later = lines.join(top.select("table_id", "_no"), "table_id").filter(
        F.col("line_no") > F.col("_no")
    )
    body = later.select(
        "table_id", "line_no", numbers(F.slice(cells, 1, 1)).alias("_y"), numbers(rest).alias("_row")
    )
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "_y", "_row")))
    tables = body.groupBy("table_id").agg(ordered.alias("_rows")).select(
        "table_id",
        F.filter(F.transform("_rows", lambda r: r["_row"]), lambda r: F.size(r) > 0).alias("data"),
        F.flatten(F.transform("_rows", lambda r: r["_y"])).alias("y_breaks"),
    )
    return tables.join(top.drop("_no"), "table_id").filter(F.size("data") > 0)


CHANNEL_SPEC = (
    "struct<id:string,name:string,description:string,category:string,data_type:string,"
    "unit:string,min:double,max:double,precision:int,source_names:array<string>,"
    "source_unit:string,conversion:string,tags:array<string>>"
)
SPEC_SCHEMA = (
    "id string, name string, version string, vendor string, description string, "
    "file_format struct<type:string,extensions:array<string>,encoding:string,delimiter:string,"
    "header_row:int,data_start_row:int,timestamp_column:string,timestamp_unit:string,"
    f"endianness:string>, channels array<{CHANNEL_SPEC}>"
)
PROTOCOL_SCHEMA = (
    "id string, name string, version string, vendor string, protocol struct<type:string,"
    "baudrate:long,extended_id:boolean>, messages array<struct<id:long,name:string,length:int,"
    "interval_ms:int,signals:array<struct<name:string,start_bit:int,length:int,byte_order:string,"
    "data_type:string,scale:double,offset:double,unit:string,min:double,max:double>>>>"
)


def read_specs(spark: SparkSession, path: str, schema: str = SPEC_SCHEMA) -> DataFrame:
    """Spec documents (JSON or YAML, one per file); load_order follows the path."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )

    def to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            batch["text"] = [json.dumps(yaml.safe_load(t), default=str) for t in batch["text"]]
            yield batch

    ship_package(spark)
    docs = raw.filter(_extension(F.col("path")).isin("yaml", "yml")).mapInPandas(
        to_json, raw.schema
    ).unionByName(raw.filter(_extension(F.col("path")) == "json"))
    parsed = docs.select("path", F.from_json("text", schema).alias("spec"))
    order = Window.orderBy("path")  # spec files are a few dozen small documents
    return parsed.select((F.row_number().over(order) - 1).alias("load_order"), "spec.*")
