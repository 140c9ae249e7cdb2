"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "telemetra", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Adaptive execution picks join sides and splits skewed partitions at run
    time, so no operator needs a forced broadcast.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Operators with Python tasks call it, so a cluster needs no installed copy.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="telemetra-package-")  # the driver serves it from here
    archive = os.path.join(folder, "telemetra.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for base, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder that ``spark.checkpoint.dir`` names.

    Without that setting only a local session, whose tasks share the driver's
    disk, gets a folder; on a cluster executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="telemetra-")
    path = os.path.join(root, f"{label}-{uuid.uuid4().hex}")
    _SCRATCH.append((app, path))
    return path


_SCRATCH: list[tuple[str, str]] = []  # (application, folder)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all staged data of the application; results must have been written by now."""
    app = spark.sparkContext.applicationId
    for entry in [e for e in _SCRATCH if e[0] == app]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _SCRATCH.remove(entry)
    for key in [k for k in _INGESTED if k[0] == app]:
        del _INGESTED[key]


def _state_of(spark: SparkSession, source: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of each file below a path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def settle(small: DataFrame) -> DataFrame:
    """Compute a per-log or per-chunk table before the rows are joined to it.

    Read back from files, its size is known to the planner, which broadcasts it
    below Spark's threshold.  Left lazy, it would have no known size, and the
    rows would be shuffled by log before adaptive execution could tell.
    """
    return materialise(small, "small")


_INGESTED: dict[tuple, tuple] = {}


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Ordered operators read their input several times (edges, counts, rows);
    doing so from a written table costs scans instead of repeated sorts, and a
    lost executor does not reach behind the table.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ingest_once(
    spark: SparkSession, source: str, label: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """The records table of a source, written at first use in this application.

    A source whose files have changed since is written anew.
    """
    key = (spark.sparkContext.applicationId, source, label, _state_of(spark, source))
    if key not in _INGESTED:
        path = scratch_dir(spark, label)
        built = build()
        built.write.parquet(path)
        _INGESTED[key] = (path, built.schema)
    path, schema = _INGESTED[key]
    return spark.read.schema(schema).parquet(path)


def constant_table(spark: SparkSession, rows: Sequence[tuple], **columns: pa.DataType) -> DataFrame:
    """A fixed table as a local relation, so that its small size is known to the planner."""
    arrays = [
        pa.array([r[i] for r in rows], type=t) for i, t in enumerate(columns.values())
    ]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))
