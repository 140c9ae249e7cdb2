"""The corpus pipeline: stages over ``documents``, each a call of one corpus operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet below the shared folder and reads it back as the next stage's input.
All stages but the last return the columns of ``documents``.  Decisions are made by row, so
rows without doc_id or with a shared one go through like all others.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import bpe, decontaminate, neardup, substrings, toxicity
from telemetra.llm.common import drop_staged, stage, staged
from telemetra.llm.queries import TOKENIZER
from telemetra.session import scratch_dir

#: A document of which this share of words is benchmark text goes as a whole.
LEAKED_SHARE = 0.5
TOXIC = 0.3


def _same_columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``; n_chars follows the text where there is such a column."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(like.columns)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: dict[str, list[str]] = {}  # what the stage before has staged, by application


def _tidy(step: Stage) -> Stage:
    """The stage, which first deletes what the stage before it staged: that one's result is written."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        drop_staged(spark, _LEFT.pop(app, []))
        before = set(staged(spark))
        out = step(spark, docs, sf_dir)
        _LEFT[app] = [path for path in staged(spark) if path not in before]
        return out

    return run


@_tidy
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model, into="_toxic")
    return scored.filter(F.col("_toxic") < TOXIC).select(docs.columns)


@_tidy
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (5 words, 0.8), that of least id."""
    return neardup.one_of_each_group(docs, words=5, percent=80)


@_tidy
def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes words of repeated 50-word windows; documents left without words go."""
    cut = substrings.remove_repeats(docs, size=50, into="_cut")
    emptied = (F.col("_cut.n_removed") > 0) & (F.col("_cut.n_removed") == F.col("_cut.n_words"))
    kept = cut.filter(~emptied)
    removed = F.col("_cut.n_removed") > 0
    kept = kept.withColumn("text", F.when(removed, F.col("_cut.text")).otherwise(F.col("text")))
    return _same_columns(kept, docs)


@_tidy
def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes benchmark passages, or the document where they are half of it."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # staged, so that a task has one Python worker at a time
    marked = stage(decontaminate.mark(docs, benchmark, into="_leak"), "marked")
    mostly = F.col("_leak.n_hit") >= LEAKED_SHARE * F.col("_leak.n_words")
    kept = marked.filter(~((F.col("_leak.n_hit") > 0) & mostly))
    return _same_columns(decontaminate.remove_spans(kept, mark="_leak"), docs)


@_tidy
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding gives it back."""
    coded = stage(bpe.encode(docs.select("doc_id", "text"), TOKENIZER), "coded")
    coded = bpe.decode(coded, TOKENIZER)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.col("ids"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("near_dedup", one_of_each_group),
    ("substring_dedup", repeats_out),
    ("decontamination", benchmark_out),
    ("bpe", token_ids),
]

#: Trained scores and BPE merges are beyond SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = os.path.join(scratch_dir(spark, "pipeline"), name)
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
