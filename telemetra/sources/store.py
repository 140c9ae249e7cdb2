"""Files read inside tasks: what their first lines say, and byte ranges of whole records.

Spark lists a folder without opening its files; tasks then open only what they
need by name.  Names are those of Spark's listing (``scheme:/path``, not escaped);
Arrow opens local paths and the stores it knows (hdfs, viewfs, s3, gs, abfs).
"""

from __future__ import annotations

import codecs
import functools
import re
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T

BLOCK = 1 << 16  # bytes read at a time
MAGIC_BYTES = 16
RECORD_BYTES = 24
#: Records of one range, and the bytes that ranges of one task hold together.
RANGE_RECORDS = 1 << 18
TASK_BYTES = 64 << 20
PIECE_RECORDS = 1 << 14
#: Bytes of text files, and of one of them, that a task holds.
TEXT_BYTES = 4 << 20
#: Names that the text reader decompresses.
_PACKED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|passthrough)$"
OLE_RANGE = (35000.0, 55000.0)
SLOTS = 8
RECORD = np.dtype([("ole", "<f8"), ("raw", "<u2", (8,))])

# Fixed value: what Arrow calls a store that Hadoop names otherwise.
_ARROW_SCHEME = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "gs": "gs"}


@functools.cache
def _store(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(f"{_ARROW_SCHEME.get(scheme, scheme)}://{authority}/")


def resolve(file: str) -> tuple[fs.FileSystem, str]:
    """The file system of a listed name, and the path there."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?(/.*)$", file, re.S)
    if not found or found[1] == "file":
        return fs.LocalFileSystem(), found[3] if found else file
    store, root = _store(found[1], found[2] or "")
    return store, root.rstrip("/") + found[3]


def open_file(file: str) -> BinaryIO:
    store, path = resolve(file)
    return store.open_input_file(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path (as the text reader spells it), file (as it is) and length of all files below; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    names = files.select(
        F.col("_metadata.file_path").alias("path"), F.col("path").alias("file"), "length"
    )
    # a scan counts every file as some megabytes; nothing of them is read here
    return names.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))


def is_small(length: str = "length", file: str = "file") -> Column:
    """Whether a text file is read whole in a task."""
    return (F.col(length) <= TEXT_BYTES) & ~F.lower(file).rlike(_PACKED)


def whole_lines(files: DataFrame) -> DataFrame:
    """Numbered lines (log_id, line_no, line) of small files (path, file), as the text reader gives them.

    A task opens many files and holds one of them and a block of lines, so that a file costs
    neither a listing nor a part of a task of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, numbers, lines, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            columns = [pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [LOG, "line_no", "line"])

        for batch in batches:
            for row in batch.select(["path", "file"]).to_pylist():
                with open_file(row["file"]) as f:
                    data = f.read()
                some = data.removeprefix(codecs.BOM_UTF8).splitlines()  # bytes end lines at \n, \r and \r\n only
                paths += [row["path"]] * len(some)
                numbers += range(len(some))
                lines += some
                held += len(data)
                if held > TEXT_BYTES:
                    yield block()
                    paths, numbers, lines, held = [], [], [], 0
        yield block()

    dealt = files.select("path", "file").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.mapInArrow(run, f"{LOG} string, line_no long, line binary")
    return found.withColumn("line", F.make_valid_utf8(F.col("line").cast("string")))


def literally(file: str) -> str:
    """The name as a pattern that matches only itself."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", file)


class _Line:
    """One line of a file, read block by block, so that its length costs no memory."""

    def __init__(self, f: BinaryIO, rest: bytes = b""):
        self.f, self.rest, self.ended = f, rest, False

    def blocks(self) -> Iterator[bytes]:
        """What is left of the line; afterwards ``rest`` holds what follows it."""
        while not self.ended:
            block = self.rest or self.f.read(BLOCK)
            part, end, self.rest = block.partition(b"\n")
            self.ended = bool(end) or not block
            yield part

    def begins(self, mark: bytes, blank: bool = False) -> bool:
        """Whether the line begins with ``mark``, leading white space aside if ``blank``."""
        held = b""
        for part in self.blocks():
            held += part
            start = held.decode("utf-8", "replace").lstrip().encode() if blank else held
            if len(start) >= len(mark) or self.ended:
                if not self.ended:
                    self.rest = held + self.rest
                return start.startswith(mark)
            held = start if blank else held
        return held.startswith(mark)

    def holds(self, marks: bytes) -> bool:
        return any(not set(marks).isdisjoint(part) for part in self.blocks())

    def skip(self) -> bytes:
        """What follows the line."""
        for _ in self.blocks():
            pass
        return self.rest


def opening(f: BinaryIO) -> str | None:
    """Which text format the first two lines announce; None for the key-value default."""
    f.seek(0)
    start = f.read(BLOCK)
    if start.startswith((b"TIME;", b"TIME\t")):
        return "holdfill"
    if start[:4].lower() == b"time" and _Line(f, start).holds(b",;"):
        return "msclock"
    f.seek(0)
    first = _Line(f)
    if not first.begins(b"TimeStamp:", blank=True):
        return None
    second = _Line(f, first.skip())
    return "calendar" if second.begins(b"Customer:", blank=True) else None


def slot_marks(f: BinaryIO) -> int:
    """How many of [chan1]..[chan8] a text holds; 0 without [chan1] or if it is not UTF-8."""
    f.seek(0)
    marks = [f"[chan{i + 1}]".encode() for i in range(SLOTS)]
    seen, held = set(), b""
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while block := f.read(BLOCK):
            decoder.decode(block)
            held += block
            seen.update(m for m in marks if m in held)
            held = held[-len(marks[0]) :]
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return 0
    return len(seen) if marks[0] in seen else 0


def first_time(f: BinaryIO, length: int) -> float | None:
    """The time of the first record of a file of whole, plausible records."""
    if not length or length % RECORD_BYTES:
        return None
    f.seek(0)
    ole = np.frombuffer(f.read(2 * RECORD_BYTES), RECORD)["ole"]
    low, high = OLE_RANGE
    if not low <= ole[0] <= high or (len(ole) > 1 and not abs(ole[1] - ole[0]) <= 1.0):
        return None
    return float(ole[0])


HEAD = "path string, file string, length long, head binary, opening string, slot_marks int, first_time double"


def sniffed(files: DataFrame, source: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """The listed files with the facts that routing looks at; only what decides is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["path", "file", "length"]).to_pylist()
            for row in rows:
                with source(row["file"]) as f:
                    row["head"] = f.read(MAGIC_BYTES)
                    records = row["file"].lower().endswith((".lg1", ".lg2"))
                    row["opening"] = opening(f)
                    row["slot_marks"] = slot_marks(f) if records else 0
                    row["first_time"] = first_time(f, row["length"]) if records else None
            yield pa.RecordBatch.from_pylist(rows, _HEAD_ARROW)

    return files.mapInArrow(run, HEAD)


_HEAD_ARROW = pa.schema([
    ("path", pa.string()), ("file", pa.string()), ("length", pa.int64()), ("head", pa.binary()),
    ("opening", pa.string()), ("slot_marks", pa.int32()), ("first_time", pa.float64()),
])


def records_of(files: DataFrame) -> DataFrame:
    """(log_id, idx, t, raw) of all record files (log_id, file, length, first_time) in one plan.

    Files are cut into ranges of whole records, which are dealt to tasks by their
    bytes whatever the files' sizes; a range is one read and one array.
    """
    spark = files.sparkSession
    total = files.agg(F.sum("length").alias("b"), F.sum(F.ceil(F.col("length") / RANGE_RECORDS / RECORD_BYTES)).alias("n"))
    size = total.first()
    tasks = max((size["b"] or 0) // TASK_BYTES, min(size["n"] or 1, spark.sparkContext.defaultParallelism), 1)
    count = F.floor(F.col("length") / RECORD_BYTES)
    ranges = files.select(
        LOG, "file", "first_time", count.alias("n"),
        F.explode(F.sequence(F.lit(0).cast("long"), count - 1, F.lit(RANGE_RECORDS).cast("long"))).alias("start"),
    ).repartition(int(tasks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = min(RANGE_RECORDS, row["n"] - row["start"])
                with open_file(row["file"]) as f:
                    f.seek(row["start"] * RECORD_BYTES)
                    records = np.frombuffer(f.read(n * RECORD_BYTES), RECORD)
                for low in range(0, n, PIECE_RECORDS):
                    yield _unpacked(row, low, records[low : low + PIECE_RECORDS])

    return ranges.mapInArrow(run, f"{LOG} string, {IDX} long, {T} double, raw array<int>")


def _unpacked(row: dict, low: int, records: np.ndarray) -> pa.RecordBatch:
    n = len(records)
    first = row["start"] + low
    cells = pa.ListArray.from_arrays(
        np.arange(n + 1, dtype=np.int32) * 8, pa.array(records["raw"].astype(np.int32).reshape(-1))
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row[LOG]] * n, pa.string()),
            pa.array(np.arange(first, first + n)),
            pa.array((records["ole"] - row["first_time"]) * 24.0 * 60.0 * 60.0),
            cells,
        ],
        [LOG, IDX, T, "raw"],
    )
