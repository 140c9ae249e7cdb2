"""Structural audits of ingested logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemetra.frame import IDX, LOG, T, is_finite
from telemetra.operators.layout import CHUNK_ROWS
from telemetra.operators.series import monotonic_audit


def structure_audit(
    records: DataFrame,
    channels: Sequence[str],
    min_records: int = 1,
    keys: Sequence[str] = (LOG,),
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per log: short rows, non-finite cells, first time, backward steps, verdict."""
    keys = list(keys)
    short, odd = F.lit(False), F.lit(0)
    for c in channels:
        short = short | F.col(c).isNull()
        odd = odd + F.when(~is_finite(F.col(c)), 1).otherwise(0)
    facts = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(short.cast("int")).alias("short_rows"),
        F.sum(odd).alias("non_finite_cells"),
        F.min_by(T, IDX).alias("t_first"),
    )
    steps = monotonic_audit(records.select(*keys, IDX, T), keys, rows)
    good = (
        (F.col("n_records") >= min_records)
        & (F.col("short_rows") == 0)
        & (F.col("non_finite_cells") == 0)
        & (F.col("t_first") >= 0)
        & (F.col("backward_steps") == 0)
    )
    return facts.join(steps, keys).withColumn("sound", good)
