"""Helpers of the operators: staged tables, shipped files, plain row keys."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.session import scratch_dir

_SHIPPED: dict[tuple[str, str], str] = {}
_STAGED: list[tuple[str, str]] = []  # (application, folder)


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to the executors once; its name there."""
    key = (spark.sparkContext.applicationId, os.path.realpath(path))
    if key not in _SHIPPED:
        spark.sparkContext.addFile(key[1])
        _SHIPPED[key] = os.path.basename(path)
    return _SHIPPED[key]


def local_file(name: str) -> str:
    """Where a task finds a shipped file."""
    return SparkFiles.get(name)


def stage(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.options(**options).parquet(path)
    _STAGED.append((spark.sparkContext.applicationId, path))
    return spark.read.schema(df.schema).parquet(path)


def staged(spark: SparkSession) -> list[str]:
    """The folders that operators of this application have written and not deleted yet."""
    return [path for app, path in _STAGED if app == spark.sparkContext.applicationId]


def drop_staged(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete staged folders, by default all; the results that read them must have been written."""
    app = spark.sparkContext.applicationId
    for path in staged(spark) if paths is None else paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if (app, path) in _STAGED:
            _STAGED.remove((app, path))


def own_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that other names cannot clash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


NO_ID = -(1 << 63)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns and a key (_doc, _tie) that tells different texts apart.

    _doc is the id, NO_ID for null.  _tie is 0 unless rows share the id; then it is a
    hash of the text, so that equal rows have equal keys and others an order.
    """
    rows = docs.withColumn("_doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)))
    shared = rows.groupBy("_doc").agg(F.count("*").alias("_n")).filter("_n > 1")
    shared = stage(shared.select("_doc", F.lit(True).alias("_shared")), "shared")
    tie = F.when(F.col("_shared"), F.xxhash64(F.coalesce(F.col(text), F.lit("")))).otherwise(0)
    return rows.join(shared, "_doc", "left").withColumn("_tie", tie.cast("long")).drop("_shared")


def shield(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame with its columns of those names renamed, and how to rename them back.

    Operators that add columns of their own on the way call it first.
    """
    taken = {c.lower() for c in docs.columns} | set(names)
    away = {}
    for c in docs.columns:
        if c.lower() in names:
            new = f"_own{c}"
            while new.lower() in taken:
                new = f"_{new}"
            taken.add(new.lower())
            away[c] = new
    return docs.withColumnsRenamed(away), {new: c for c, new in away.items()}


#: Columns that keyed documents and their spans have.
KEYED = ("_doc", "_tie", "_n", "_shared", "_spans", "_runs", "_pos", "_code")


def span_table(verdicts: DataFrame) -> DataFrame:
    """Rows (_doc, _tie, pos, m) of runs of m window starts, as one list for each document."""
    return verdicts.groupBy("_doc", "_tie").agg(
        F.collect_list(F.struct("pos", "m")).alias("_spans")
    )


def span_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pos, m) of the lists of such a column; a null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    inner = pc.list_flatten(column)
    row = np.repeat(np.arange(len(column)), size)
    return row, inner.field("pos").to_numpy(), inner.field("m").to_numpy()


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    """The batch with a column added, or replaced if it has one of that name."""
    at = batch.schema.get_field_index(name)
    if at >= 0:
        return batch.set_column(at, name, column)
    return batch.append_column(name, column)


def schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of such batches."""
    fields = [f for f in df.schema.fields if f.name != name]
    if len(fields) < len(df.columns):
        return T.StructType([T.StructField(name, kind) if f.name == name else f for f in df.schema])
    return T.StructType([*fields, T.StructField(name, kind)])
