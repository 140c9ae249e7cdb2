"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed 3- to 5-grams of lower-cased code points.  From
labelled documents each gets r, the log ratio of its smoothed rates among toxic
and other documents; informative features (|r| and count over a floor) enter a
document's vector as r, scaled to length one, and a logistic regression on these
vectors is fitted.

Fitting uses at most ``sample_rows`` labelled documents (the smallest hashes of
their ids, so the choice is stable); a limit of the fit alone, every document is
scored whole.  Scores never see labels, lang, source or doc_id.

Null and empty texts have no features and get the score of the intercept.
Labels that are null or not 0 or 1 are not used; a document with several labels
is toxic if one says so.  Without labelled documents of both kinds the score is
the share of toxic ones, 0 without any.  Rows with a null or repeated doc_id are
scored like all others; an empty table gives an empty result.  ``score`` keeps
all columns and adds (or replaces) the score column.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm import arrays
from telemetra.llm.common import own_columns, schema_with, stage, with_column
from telemetra.session import ship_package

BITS = 18
SIZES = (3, 4, 5)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text in a slice; its n-grams take some hundred times as much.
SLICE = 1 << 20


@functools.cache
def _lower() -> np.ndarray:
    """Lower case of each code point of the first two planes, where it is one code point."""
    pairs = ((i, chr(i).lower()) for i in range(0x20000))
    return np.array([ord(c) if len(c) == 1 else i for i, c in pairs], np.uint64)


def _features(
    data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs of a slice, each once, in order; only ``wanted`` features."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    rows = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), at)
    low = _lower()
    points = np.where(points < len(low), low[np.minimum(points, len(low) - 1)], points)
    text = arrays.owners(rows)
    total = len(points)
    found = []
    h = points.astype(np.uint64)
    for n in range(2, max(SIZES) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * _STEP + points[n - 1 :]
        if n not in SIZES:
            continue
        feature = ((h * _STEP) >> np.uint64(64 - BITS)).astype(np.int64)
        ok = arrays.starts_of_windows(rows, n, total)[: len(h)]
        if wanted is not None:
            ok &= wanted[feature]
        spot = np.flatnonzero(ok)
        found.append((text[spot] << BITS) | feature[spot])
    key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    """``ratio`` is 0 for features that are not used."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        text, feature = _features(data, at, self.ratio != 0)
        return self._of(text, feature, len(at) - 1)

    def _of(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[feature]
        dot = np.bincount(text, r * self.weight[feature], n)
        length = np.sqrt(np.bincount(text, r * r, n))
        z = dot / np.maximum(length, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train_rows(doc_id: Column) -> Column:
    """The rows labels may be learned from; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 8000,
    min_count: int = 3,
    min_ratio: float = 0.8,
    rounds: int = 60,
    penalty: float = 1e-5,
) -> Model:
    """The classifier of at most ``sample_rows`` labelled documents outside the held-out rows."""
    spark = docs.sparkSession
    ship_package(spark)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(train_rows(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    # the sample is bounded, so its side may be broadcast and texts stay where they are
    sample = own_columns(docs).join(F.broadcast(known), "doc_id").select("toxic", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text", SLICE):
            text, feature = _features(*arrays.flat(part.column("text")))
            at = np.searchsorted(text, np.arange(part.num_rows + 1))
            raw = feature.astype("<i4").view(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column("toxic"), arrays.binary_array(raw, at * 4)], ["toxic", "features"]
            )

    vectors = stage(sample.mapInArrow(extract, "toxic int, features binary"), "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for toxic, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[toxic][np.frombuffer(raw.as_buffer(), "<i4")] += 1
        seen = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_pydict(
            {"feature": seen, "other": held[0][seen], "toxic": held[1][seen]}
        )

    counts = vectors.mapInArrow(count, "feature long, other long, toxic long").groupBy("feature")
    table = counts.agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toPandas()
    size = {r["toxic"]: r["n"] for r in vectors.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    ratio, weight = np.zeros(1 << BITS), np.zeros(1 << BITS)
    if not n_toxic or not n_other:
        share = n_toxic / max(n_toxic + n_other, 1)
        return Model(ratio, weight, 500.0 if share == 1 else -500.0)
    toxic, other = table["toxic"].to_numpy(), table["other"].to_numpy()
    r = np.log((toxic + 1) / (n_toxic + 2)) - np.log((other + 1) / (n_other + 2))
    used = (np.abs(r) >= min_ratio) & (toxic + other >= min_count)
    ratio[table["feature"].to_numpy()[used]] = r[used]
    held = spark.sparkContext.broadcast(ratio != 0)  # 2^BITS flags

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(1)]
            kept = [x[held.value[x]].tobytes() for x in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary())], ["toxic", "features"]
            )

    few = vectors.mapInArrow(keep, "toxic int, features binary").toPandas()
    few = few.sort_values(["toxic", "features"])  # the same sums on every run
    parts = [np.frombuffer(x, "<i4").astype(np.int64) for x in few["features"]]
    text = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    feature = np.concatenate(parts)
    return _regress(ratio, text, feature, few["toxic"].to_numpy(float), rounds, penalty)


def _regress(
    ratio: np.ndarray, text: np.ndarray, feature: np.ndarray, label: np.ndarray,
    rounds: int, penalty: float,
) -> Model:
    """Logistic regression by Adam steps over the whole sample."""
    n = len(label)
    used, column = np.unique(feature, return_inverse=True)
    value = ratio[feature]
    length = np.sqrt(np.bincount(text, value * value, n))
    value = value / np.maximum(length, 1e-9)[text]
    at = np.zeros(len(used) + 1)
    at[-1] = np.log(label.mean() / (1 - label.mean()))
    first, second = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, rounds + 1):
        z = np.bincount(text, value * at[:-1][column], n) + at[-1]
        error = 1 / (1 + np.exp(-z)) - label
        grad = np.append(
            np.bincount(column, value * error[text], len(used)) / n + penalty * at[:-1],
            error.mean(),
        )
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        at = at - 0.5 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weight = np.zeros(len(ratio))
    weight[used] = at[:-1]
    return Model(ratio, weight, float(at[-1]))


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 2^BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, text, SLICE):
            found = held.value.scores(*arrays.flat(part.column(text)))
            yield with_column(part, into, pa.array(found, pa.float64()))

    return docs.mapInArrow(run, schema_with(docs, into, T.DoubleType()))
