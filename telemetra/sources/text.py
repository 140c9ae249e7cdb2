"""Text logger exports to the shared sample model.

Every parser takes numbered lines (log_id, line_no, line), ``line_no`` growing
through a log, and returns an ``Ingest``.  Parsing is Column expressions over lines, so a folder of files and
one huge file split the same way; only a file's few header lines are grouped
per file.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetra.frame import CHANNEL, IDX, LOG, T, VALUE
from telemetra.functions import decode
from telemetra.operators.layout import hold_vectors, index_in_buckets
from telemetra.session import materialise, settle

# The shapes that mark data rows.
CLOCK_ROW = r"^\d{1,2}:\d{2}:\d{2}"
WEEKDAY_ROW = r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) "
CALENDAR = r"^\w{3} (\w{3}) +(\d{1,2}) (\d{1,2}):(\d{2}):(\d{2}) (\d{4})$"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
META_LINES = 5
BLANKS = " \t\r\n\f\v"
# What Spark reads as a number but a logger does not write: hex, type suffixes.
_ODD_NUMBER = r"[xXdD]|(?<![nN])[fF]$"


class Ingest:
    """``logs`` (log_id, format, meta), ``channels`` (log_id, channel_idx, name,
    unit, ...), ``records`` (log_id, idx, t, cells array).

    The records are parsed when they are first asked for.
    """

    def __init__(
        self,
        logs: DataFrame,
        channels: DataFrame,
        records: Callable[[], DataFrame],
        loaded: DataFrame | None = None,
    ) -> None:
        self.logs = logs
        self.channels = channels
        self._records = records
        self._loaded = loaded

    @cached_property
    def records(self) -> DataFrame:
        return self._records()

    def loaded(self) -> DataFrame:
        """log_id of the logs that have a sample, from the records as they were parsed."""
        if self._loaded is not None:
            return self._loaded
        width = self.channels.groupBy(LOG).agg(F.min("channel_idx").alias("_least"))
        cells = self.records.select(LOG, F.size("cells").alias("_n")).groupBy(LOG).agg(F.max("_n").alias("_n"))
        return cells.join(width, LOG).filter(F.col("_n") > F.col("_least")).select(LOG)

    def samples(self) -> DataFrame:
        """Long form with channel names; the channel table is small."""
        cells = self.records.select(
            LOG, IDX, T, F.posexplode("cells").alias("channel_idx", VALUE)
        )
        names = self.channels.select(LOG, "channel_idx", F.col("name").alias(CHANNEL))
        return cells.join(names, [LOG, "channel_idx"]).select(LOG, IDX, T, CHANNEL, VALUE)

    def wide(self, names: list[str]) -> DataFrame:
        """Wide form for the named channels; a log without one has NULLs."""
        order = F.sort_array(F.collect_list(F.struct("channel_idx", "name")))
        listed = self.channels.groupBy(LOG).agg(
            F.transform(order, lambda c: F.lower(c["name"])).alias("_names")
        )
        picks = [
            F.get(
                "cells",
                F.nullif(F.array_position("_names", F.lit(n.lower())), F.lit(0)).cast("int") - 1,
            ).alias(n)
            for n in names
        ]
        return self.records.join(listed, LOG).select(LOG, IDX, T, *picks)


def line_number(block_start: Column) -> Column:
    """Block start plus the row's place in its task."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (block_start + row).alias("line_no")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Numbered lines of text files; log_id is the file path.

    ``line_no`` is the start of the line's block plus its row in the task.  It
    grows through a file, split or not: a line takes at least one byte, full
    blocks are never packed into a task behind other files, and only the last
    block of a file may be.  So lines are numbered without a sort or a shuffle.
    Invalid UTF-8 is replaced.
    """
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias(LOG),
        line_number(F.col("_metadata.file_block_start")),
        F.make_valid_utf8("value").alias("line"),
    )


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def number(text: Column) -> Column:
    """Strict number or NULL: no type suffixes, no hex."""
    return F.when(~F.rlike(text, F.lit(_ODD_NUMBER)), text.try_cast("double"))


def regional_number(text: Column, semicolons: Column) -> Column:
    """In semicolon files the comma is the decimal point."""
    plain = trimmed(text)
    return number(F.when(semicolons, F.replace(plain, F.lit(","), F.lit("."))).otherwise(plain))


def semicolon_header(header: Column) -> Column:
    """True if fields are split at ';': more of them than commas, or at least two."""
    semicolons = F.size(F.split(header, ";")) - 1
    commas = F.size(F.split(header, ",")) - 1
    return (semicolons > commas) | (semicolons >= 2)


def clock_seconds(text: Column) -> Column:
    """``HH:MM:SS.mmm`` to seconds of the day, or NULL."""
    parts = F.split(text, ":")
    h, m, s = (number(F.get(parts, i)) for i in range(3))
    return F.when(F.size(parts) == 3, h * 3600.0 + m * 60.0 + s)


def calendar_stamp(text: Column) -> Column:
    """``Sat Nov 15 19:00:03 2025`` as a zone-less timestamp, or NULL."""

    def part(i: int) -> Column:
        return F.regexp_extract(text, CALENDAR, i)

    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(1)), F.lit(0))
    return F.try_make_timestamp_ntz(
        part(6).try_cast("int"), month.cast("int"), part(2).try_cast("int"),
        part(3).try_cast("int"), part(4).try_cast("int"),
        part(5).try_cast("double").cast("decimal(8,6)"),
    )


def stamp_seconds(column: str) -> Column:
    """Seconds since 1970 of a zone-less timestamp column, read as UTC."""
    return F.expr(
        f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})"
    ).cast("double")


def _trimmed(lines: DataFrame) -> DataFrame:
    out = lines.withColumn("line", trimmed(F.col("line")))
    return out.filter(F.col("line") != "")


def _tail(cells: Column) -> Column:
    return F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))


def _small(header: DataFrame) -> DataFrame:
    """Header facts, computed once so the text is not scanned again for each use."""
    return settle(header)


def _logs(lines: DataFrame, kind: str, meta: DataFrame | None = None) -> DataFrame:
    logs = lines.select(LOG).distinct().withColumn("format", F.lit(kind))
    if meta is None:
        return logs.withColumn("meta", F.create_map().cast("map<string,string>"))
    return logs.join(meta, LOG, "left")


def _meta_map(pairs: DataFrame) -> DataFrame:
    """One map per log; the last line of a key counts.  Header lines only."""
    last = pairs.groupBy(LOG, "key").agg(F.max_by("value", "line_no").alias("value"))
    return last.groupBy(LOG).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta")
    )


LINES_PER_BUCKET = 22  # bits of line_no inside one bucket


def _staged(parsed: DataFrame) -> DataFrame:
    """The parsed rows as a written table, with buckets of lines."""
    return materialise(
        parsed.select(
            LOG, "line_no", "_t", "cells", "_width",
            F.shiftright("line_no", LINES_PER_BUCKET).alias("_bucket"),
        ),
        "parsed",
    )


def _finish(parsed: DataFrame, rebase: bool, ragged: bool) -> DataFrame:
    """Parsed rows (log_id, line_no, _t, cells, _width) to records.

    The rows are written before anything is filtered on: a condition on a
    parsed column would make Spark parse the text once more to test it.  Time
    counts from the first row with a time and a cell; after that ``ragged``
    formats drop rows with fewer cells than channels.
    """
    staged = _staged(parsed)
    readable = staged.filter(F.col("_t").isNotNull())
    if ragged:
        readable = readable.filter(F.exists("cells", lambda v: v.isNotNull()))
    kept = readable.filter(F.size("cells") >= F.col("_width")) if ragged else readable
    out = index_in_buckets(kept.drop("_width"), "_bucket", [F.col("line_no")])
    if not rebase:
        return out.select(LOG, IDX, F.col("_t").alias(T), "cells")
    first = settle(readable.groupBy(LOG).agg(F.min_by("_t", "line_no").alias("_t0")))
    return out.join(first, LOG).select(
        LOG, IDX, (F.col("_t") - F.col("_t0")).alias(T), "cells"
    )


# Header keys that describe the log.
KEYVALUE_META = (
    "DataLogVersion", "Software", "SoftwareVersion", "DownloadDateTime", "DownloadDate/Time",
    "Log Source", "Log Number", "Log",
)


def parse_keyvalue(lines: DataFrame, compat: bool = True) -> Ingest:
    """``Key : Value`` header with channel blocks, then ``HH:MM:SS.mmm,v,v,...`` rows.

    Cells are scaled by the channel type at their position.  A cell that is no
    number is left out and later cells move up (``compat``) or is NULL in
    place.  Rows with fewer cells than channels are dropped; time counts from
    the first readable row, dropped or not.
    """
    spark = lines.sparkSession
    text = _trimmed(lines).filter(F.col("line") != "%DataLog%")
    is_data = F.rlike("line", F.lit(CLOCK_ROW))
    begins = text.filter(is_data).groupBy(LOG).agg(F.min("line_no").alias("_begin"))
    pair = r"^([^:]+?)\s*:\s*(.+)$"
    header = _small(
        text.filter(~is_data & F.rlike("line", F.lit(pair)))
        .join(begins, LOG, "left")
        .filter(F.col("_begin").isNull() | (F.col("line_no") < F.col("_begin")))
        .select(
            LOG, "line_no",
            F.trim(F.regexp_extract("line", pair, 1)).alias("key"),
            F.trim(F.regexp_extract("line", pair, 2)).alias("value"),
        )
    )
    so_far = Window.partitionBy(LOG).orderBy("line_no")
    blocks = header.withColumn(
        "_no", F.sum(F.when(F.col("key") == "Channel", 1).otherwise(0)).over(so_far)
    ).filter(F.col("_no") > 0)

    def last(key: str) -> Column:
        return F.max_by("value", F.when(F.col("key") == key, F.col("line_no")))

    shown = F.split(F.col("_display"), ",")
    channels = blocks.groupBy(LOG, "_no").agg(
        last("Channel").alias("name"), last("ID").alias("id"),
        last("Type").alias("type_name"), last("DisplayMaxMin").alias("_display"),
    ).select(
        LOG, (F.col("_no") - 1).cast("int").alias("channel_idx"), "name", "id",
        F.coalesce("type_name", F.lit("Raw")).alias("type_name"),
        F.when(F.size(shown) >= 2, number(trimmed(F.get(shown, 1)))).alias("display_min"),
        F.when(F.size(shown) >= 2, number(trimmed(F.get(shown, 0)))).alias("display_max"),
    )
    types = decode.keyvalue_type_table(spark)
    channels = _small(
        channels.join(F.broadcast(types), channels["type_name"] == types["type"], "left")
        .drop("type")
        .withColumns(
            {
                "unit": F.coalesce("unit", F.lit("")),
                "divisor": F.coalesce("divisor", F.lit(1.0)),
                "addend": F.coalesce("addend", F.lit(0.0)),
            }
        )
    )
    scales = channels.groupBy(LOG).agg(
        F.sort_array(F.collect_list(F.struct("channel_idx", "divisor", "addend"))).alias("_scale")
    )

    def engineering(cell: Column, i: Column) -> Column:
        s = F.get("_scale", i)
        return number(trimmed(cell)) / F.coalesce(s["divisor"], F.lit(1.0)) + F.coalesce(
            s["addend"], F.lit(0.0)
        )

    cut = F.split("line", ",")
    values = F.transform(_tail(cut), engineering)
    parsed = text.filter(is_data).join(scales, LOG, "left").select(
        LOG, "line_no",
        clock_seconds(trimmed(F.get(cut, 0))).alias("_t"),
        (F.filter(values, lambda v: v.isNotNull()) if compat else values).alias("cells"),
        F.when(F.col("_scale").isNull(), 0).otherwise(F.size("_scale")).alias("_width"),
    )
    meta = _meta_map(header.filter(F.col("key").isin(*KEYVALUE_META)))
    return Ingest(_logs(lines, "keyvalue", meta), channels, lambda: _finish(parsed, True, True))


def parse_holdfill(lines: DataFrame) -> Ingest:
    """``TIME;path/a;path/b`` rows in seconds with sparse cells.

    An empty, unreadable or missing cell repeats the channel's last value, or 0
    before its first.  Time is kept as written.
    """
    body, channels = _headed(lines, F.contains(F.col("line"), F.lit(";")), "\t")
    path = F.trim("title")
    channels = channels.select(
        LOG, "channel_idx", decode.path_name(path).alias("name"), path.alias("type_name"),
        decode.unit_by_rules(decode.HOLDFILL_UNITS, decode.path_name(path), path).alias("unit"),
    )
    cut = F.when(F.col("_semi"), F.split("line", ";")).otherwise(F.split("line", "\t"))
    parsed = (
        body.filter(F.col("_first") == "TIME")
        .withColumn("_cut", cut)
        .withColumn("_t", number(trimmed(F.get("_cut", 0))))
        .withColumn(
            "cells",
            F.transform(
                F.sequence(F.lit(1), F.col("_width")),
                lambda i: number(trimmed(F.get("_cut", i))),
            ),
        )
    )

    def records() -> DataFrame:
        staged = _staged(parsed.filter(F.col("_width") > 0)).filter(F.col("_t").isNotNull())
        held = hold_vectors(staged.drop("_width"), "_bucket", "line_no", "cells")
        return held.select(LOG, IDX, F.col("_t").alias(T), "cells")

    return Ingest(_logs(lines, "holdfill"), channels, records)


def parse_msclock(lines: DataFrame) -> Ingest:
    """``Time (msec),Name (unit),...`` rows; semicolon files use decimal commas.

    Time becomes seconds since the first row; unreadable or missing cells are 0.
    """
    body, channels = _headed(lines, semicolon_header(F.col("line")), ",")
    name, unit = decode.name_and_unit(F.col("title"))
    channels = channels.select(
        LOG, "channel_idx", name.alias("name"), F.lit("msclock").alias("type_name"),
        unit.alias("unit"),
    )
    cut = F.when(F.col("_semi"), F.split("line", ";")).otherwise(F.split("line", ","))
    parsed = (
        body.filter(F.startswith(F.lower(F.trim("_first")), F.lit("time")))
        .withColumn("_cut", cut)
        .withColumn("_t", regional_number(F.get("_cut", 0), F.col("_semi")) / 1000.0)
        .withColumn(
            "cells",
            F.when(
                F.col("_width") > 0,
                F.transform(
                    F.sequence(F.lit(1), F.greatest("_width", F.lit(1))),
                    lambda i: F.coalesce(
                        regional_number(F.get("_cut", i), F.col("_semi")), F.lit(0.0)
                    ),
                ),
            ).otherwise(F.array().cast("array<double>")),
        )
    )
    return Ingest(_logs(lines, "msclock"), channels, lambda: _finish(parsed, True, False))


def _headed(lines: DataFrame, semicolons: Column, other: str) -> tuple[DataFrame, DataFrame]:
    """Split one-header files into trimmed body rows and channel titles.

    Body rows carry _semi (field split), _first (first title) and _width
    (number of channels).
    """
    header = _small(
        lines.groupBy(LOG)
        .agg(F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("_no"))
        .withColumn("_semi", semicolons)
        .withColumn(
            "_titles",
            F.when(F.col("_semi"), F.split("line", ";")).otherwise(F.split("line", other)),
        )
        .select(
            LOG, "_no", "_semi", "_titles", F.upper(F.get("_titles", 0)).alias("_first"),
            (F.size("_titles") - 1).alias("_width"),
        )
    )
    channels = header.select(
        LOG, F.posexplode(_tail(F.col("_titles"))).alias("channel_idx", "title")
    )
    body = _trimmed(lines).join(header.drop("_titles"), LOG).filter(F.col("line_no") > F.col("_no"))
    return body, channels


# Header keys of calendar-clock files.
CALENDAR_META = ("TimeStamp", "Customer", "UnitNumber", "SoftwarePartNumber", "SoftwareVersion")


def parse_calendar(lines: DataFrame) -> Ingest:
    """Five ``Key: value`` lines, a title line, then ``Sat Nov 15 19:00:03 2025, v, v``.

    Unreadable cells are left out and later ones move up; rows with fewer cells
    than channels are dropped; time is seconds since the first readable row.
    """
    text = _trimmed(lines)
    is_data = F.rlike("line", F.lit(WEEKDAY_ROW))
    begins = text.filter(is_data).groupBy(LOG).agg(F.min("line_no").alias("_begin"))
    head = (
        text.filter(~is_data)
        .join(begins, LOG, "left")
        .filter(F.col("_begin").isNull() | (F.col("line_no") < F.col("_begin")))
        .withColumn("_colon", F.contains(F.col("line"), F.lit(":")).cast("int"))
    )
    head = _small(head)
    before = Window.partitionBy(LOG).orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    head = head.withColumn("_seen", F.coalesce(F.sum("_colon").over(before), F.lit(0)))
    meta = _meta_map(
        head.filter((F.col("_seen") < META_LINES) & (F.col("_colon") == 1))
        .select(
            LOG, "line_no", F.trim(F.substring_index("line", ":", 1)).alias("key"),
            F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"),
        )
        .filter(F.col("key").isin(*CALENDAR_META))
    )
    titles = (
        head.filter(F.col("_seen") >= META_LINES)
        .groupBy(LOG)
        .agg(F.min_by("line", "line_no").alias("line"))
        .withColumn(
            "_titles",
            F.filter(
                F.transform(_tail(F.split("line", ",")), lambda c: F.trim(c)),
                lambda c: c != "",
            ),
        )
    )
    channels = titles.select(LOG, F.posexplode("_titles").alias("channel_idx", "name")).select(
        LOG, "channel_idx", "name", F.lit("calendar").alias("type_name"), F.lit("").alias("unit")
    )
    cut = F.split("line", ",")
    stamp = calendar_stamp(trimmed(F.get(cut, 0)))
    width = titles.select(LOG, F.size("_titles").alias("_width"))
    parsed = (
        text.filter(is_data)
        .join(width, LOG, "left")
        .withColumn("_stamp", stamp)
        .select(
            LOG, "line_no",
            stamp_seconds("_stamp").alias("_t"),
            F.filter(
                F.transform(_tail(cut), lambda c: number(trimmed(c))), lambda v: v.isNotNull()
            ).alias("cells"),
            F.coalesce("_width", F.lit(0)).alias("_width"),
        )
    )
    return Ingest(
        _logs(lines, "calendar", meta), channels, lambda: _finish(parsed, True, True)
    )


PARSERS = {
    "keyvalue": parse_keyvalue,
    "holdfill": parse_holdfill,
    "msclock": parse_msclock,
    "calendar": parse_calendar,
}
