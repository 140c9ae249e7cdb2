"""Telemetry views of columnar tables: each adapter yields records.

Numbering the records of a log needs a sort, so the ``*_records`` views are
ingested: written once per application as a records table with ``idx``, ``t``
and the log size ``n``, and read from there by every query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T
from telemetra.operators.layout import CHUNK_ROWS, with_record_index
from telemetra.session import ingest_once, settle

_EPOCH = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"


def micros(column: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column."""
    return F.expr(_EPOCH.format(column))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rebase(
    df: DataFrame,
    raw: str,
    unit: float = 1.0,
    keys: tuple[str, ...] = (LOG,),
    order: tuple[str, ...] = (IDX,),
    source: DataFrame | None = None,
) -> DataFrame:
    """``t`` = (raw - raw of the first record) / unit, first by ``order``.

    The firsts come from ``source``, which may be a plain table scan below df.
    """
    base = df if source is None else source
    first = base.groupBy(*keys).agg(F.min_by(raw, F.struct(*order)).alias("_first"))
    return (
        df.join(settle(first), list(keys))
        .withColumn(T, (F.col(raw) - F.col("_first")) / F.lit(unit))
        .drop("_first")
    )


def _event_channels(events: DataFrame) -> DataFrame:
    return events.withColumn("us", micros("ts")).withColumn(
        "k", F.get_json_object("props", "$.k").cast("double")
    )


def _build_event_records(spark: SparkSession, folder: str, rows: int) -> DataFrame:
    events = _event_channels(read_table(spark, folder, "events"))
    raw = events.select(F.col("user_id").alias(LOG), "us", "event_id", "value", "k")
    indexed = with_record_index(raw, ["us", "event_id"], rows=rows, total="n")
    return rebase(indexed, "us", 1e6, order=("us", "event_id"), source=raw).select(LOG, IDX, T, "value", "k", "n")


def _build_event_stream_record(spark: SparkSession, folder: str, rows: int) -> DataFrame:
    events = _event_channels(read_table(spark, folder, "events"))
    raw = events.select(F.lit(0).cast("long").alias(LOG), "us", "event_id", "value", "k")
    indexed = with_record_index(raw, ["us", "event_id"], rows=rows, total="n")
    return rebase(indexed, "us", 1e6, order=("us", "event_id"), source=raw).select(LOG, IDX, T, "value", "k", "n")


def event_rate_points(spark: SparkSession, folder: str) -> DataFrame:
    """Unequal rates: one channel per event type, each with its own times."""
    events = read_table(spark, folder, "events").withColumn("us", micros("ts"))
    first = events.groupBy("user_id").agg(F.min("us").alias("_first"))
    return events.join(first, "user_id").select(
        F.col("user_id").alias(LOG),
        F.col("event_id").alias("seq"),
        ((F.col("us") - F.col("_first")) / F.lit(1e6)).alias(T),
        F.col("event_type").alias("channel"),
        "value",
    )


LINE_CHANNELS = {
    "quantity": "l_quantity",
    "extendedprice": "l_extendedprice",
    "discount": "l_discount",
    "tax": "l_tax",
}


def line_values(spark: SparkSession, folder: str) -> DataFrame:
    """Wide logs without record order: one log per supplier, four channels."""
    lines = read_table(spark, folder, "lineitem")
    return lines.select(
        F.col("l_suppkey").alias(LOG), *[F.col(c).alias(n) for n, c in LINE_CHANNELS.items()]
    )


def _build_line_records(spark: SparkSession, folder: str, rows: int) -> DataFrame:
    lines = read_table(spark, folder, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
    raw = lines.select(
        F.col("l_suppkey").alias(LOG),
        *order,
        *[F.col(c).alias(n) for n, c in LINE_CHANNELS.items()],
    )
    indexed = with_record_index(raw, order, rows=rows, total="n")
    return indexed.withColumn(T, F.col(IDX) * F.lit(0.01)).select(
        LOG, IDX, T, *LINE_CHANNELS, "n"
    )


def _build_order_records(spark: SparkSession, folder: str, rows: int) -> DataFrame:
    orders = read_table(spark, folder, "orders")
    raw = orders.select(
        F.col("o_custkey").alias(LOG),
        (micros("o_orderdate") / F.lit(1e6)).alias(T),
        "o_orderkey",
        F.col("o_totalprice").alias("totalprice"),
    )
    return with_record_index(raw, [T, "o_orderkey"], rows=rows, total="n").select(
        LOG, IDX, T, "totalprice", "n"
    )


def event_records(spark: SparkSession, folder: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Many short logs: one log per user, channels ``value`` and ``k``."""
    return ingest_once(
        spark, folder, f"event_records-{rows}", lambda: _build_event_records(spark, folder, rows)
    )


def event_stream_record(spark: SparkSession, folder: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """One long log that holds every event; the hot-key shape."""
    return ingest_once(
        spark, folder, f"event_stream_record-{rows}", lambda: _build_event_stream_record(spark, folder, rows)
    )


def line_records(spark: SparkSession, folder: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Wide logs in order-key order at 100 Hz."""
    return ingest_once(
        spark, folder, f"line_records-{rows}", lambda: _build_line_records(spark, folder, rows)
    )


def order_records(spark: SparkSession, folder: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Logs with tied times: one log per customer, channel ``totalprice``."""
    return ingest_once(
        spark, folder, f"order_records-{rows}", lambda: _build_order_records(spark, folder, rows)
    )
