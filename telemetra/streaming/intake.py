"""Incremental intake of a folder that keeps receiving logger files.

The file source remembers in its checkpoint which files it has handed out, so
no path is ever loaded twice, also after a lost driver or executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from telemetra.frame import LOG
from telemetra.sources.text import PARSERS, line_number


def follow_folder(
    spark: SparkSession,
    folder: str,
    table: str,
    kind: str,
    checkpoint: str | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Append the samples of files that appeared since the last call.

    Runs until the folder and those below it are drained.  Files must appear whole
    (moved in, not written in place); ``kind`` names their format.  What was read is
    remembered in ``checkpoint``, by default beside the table's batches.
    """
    lines = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            F.col("_metadata.file_path").alias(LOG),
            F.col("_metadata.file_block_start").alias("_block"),
            F.make_valid_utf8("value").alias("line"),
        )
    )

    def load(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.select(LOG, line_number(F.col("_block")), "line")
        samples = PARSERS[kind](numbered).samples()
        # A repeated batch replaces what its first try wrote.
        samples.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        lines.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint or f"{table}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
