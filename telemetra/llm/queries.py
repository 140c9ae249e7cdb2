"""The named queries of the operators, with their production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemetra.llm import (
    bpe,
    bytedup,
    chat,
    decontaminate,
    neardup,
    periodic,
    quality,
    ranked,
    sharding,
    simhash,
    substrings,
    token_store,
    toxicity,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.store_folder(spark)
    token_store.write_store(_documents(spark, sf_dir), TOKENIZER, folder)
    read = token_store.read_store(spark, folder)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), words=4, percent=80)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe.encode(docs, TOKENIZER).select("doc_id", "ids")
    return bpe.decode(coded, TOKENIZER).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    marked = decontaminate.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("leak.items"), ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


#: The shards that documents are dealt to.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_documents(spark, sf_dir).select("doc_id"), "doc_id", SHARDS)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return substrings.remove_repeats(docs).select(
        "doc_id",
        "repeats.n_words",
        "repeats.n_removed",
        F.sha2(F.encode("repeats.kept", "UTF-8"), 256).alias("kept_sha256"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    threads = chat.thread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return threads.drop("text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    crf = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, crf).select("doc_id", "quality_rules.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (~toxicity.train_rows(F.col("doc_id"))).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op10_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return bytedup.remove_repeats(docs).select(
        "doc_id",
        "repeats.n_bytes",
        "repeats.n_removed",
        "repeats.n_spans",
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


def _periodic_tails(part: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    """Which word stands at each place: tails of one text in ten repeat, by the checksum of its id."""
    place = np.arange(rows[-1])
    for i, doc in enumerate(part.column("doc_id").to_pylist()):
        n = int(rows[i + 1] - rows[i])
        h = 1 if doc is None else zlib.crc32(str(doc).encode())
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place[rows[i] + a : rows[i + 1]] = rows[i] + a + np.arange(n - a) % p
    return place


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = periodic.periodic_runs(docs, order=_periodic_tails)
    line = F.transform(
        "periodic.runs",
        lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
    )
    best = F.col("periodic.strongest")
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * periodic.strongest.length DIV periodic.strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.encode("periodic.collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked.search(_documents(spark, sf_dir), items, k=20)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_fingerprints(_documents(spark, sf_dir), words=4, distance=4)
    text = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", text.alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_bpe": op3_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_substrings": op6_substrings,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_toxicity": op9_toxicity,
    "op10_suffix_arrays": op10_suffix_arrays,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_ranked_search": op12_ranked_search,
    "op13_simhash": op13_simhash,
}

#: Whole-number scores, so that both engines agree to the last digit.
_RANKED_SQL = r"""
WITH spoken AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM spoken GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, totals GROUP BY term),
scales AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM lengths, totals),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN scales USING (doc_id)
  GROUP BY item_id, doc_id),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank,
    doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {"op12_ranked_search": _RANKED_SQL}
