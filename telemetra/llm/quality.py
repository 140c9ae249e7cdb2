"""Quality rules: base counts of each text, and a linear-chain CRF over its lines.

Base counts are exact (see ``counts_of``).  The CRF marks each line with a word as
content or boilerplate by Viterbi decoding; a text is kept if it passes the base
rules and at least ``content_share`` of its word characters lie in content lines.

The CRF is fitted on at most ``sample_rows`` labelled documents (smallest hashes
of their ids; a bound of the fit alone).  All lines of documents of quality 1
are content; lines of the others are boilerplate unless a first fit of the lines
alone finds them to be content.  Without labels of both kinds all lines are content.

Works row by row without a shuffle.  A null text is empty: no words, base failed,
not kept.  An empty table gives an empty result; rows with null or repeated
doc_id are judged like all others.  ``judge`` keeps all columns and adds (or
replaces) one struct column.  Labels that are null or not 0 or 1 are not used;
of several labels of a document the lowest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm import arrays
from telemetra.llm.common import own_columns, schema_with, with_column
from telemetra.session import ship_package

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
FEATURES = 13
PIECE = 64  # lines of a training sequence
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in _COUNTS),
        T.StructField("content_chars", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def _is(values: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_SYMBOL, _UPPER = _is(SYMBOLS), _is(bytes(range(65, 91)))
_LETTER = _is(bytes([*range(65, 91), *range(97, 123)]))
_DIGIT, _BANG, _LINK, _STOP = _is(b"0123456789"), _is(b"!"), _is(b"@/:"), _is(b".!?\"")


class Lines:
    """Texts of a slice with their words, lines and counts."""

    def __init__(self, texts: pa.Array):
        data, at = arrays.flat(texts)
        self.at, self.words = at, arrays.Words(data, at, arrays.SPACED)
        self.n = len(at) - 1
        breaks = np.flatnonzero(data == 10)
        # lines without their breaks; each text has one more line than breaks
        begin = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
        self.text = np.repeat(np.arange(self.n), np.diff(np.searchsorted(breaks, at)) + 1)
        end = np.append(begin[1:] - 1, at[-1])
        last = np.append(self.text[1:] != self.text[:-1], True)
        end[last] = at[1:]
        self.begin, self.end = begin, end
        words = self.words
        self.first = np.searchsorted(words.start, begin)
        self.stop = np.searchsorted(words.start, end)
        self.hashes = words.hashes()
        lead = (data & 0xC0) != 0x80
        self._lead = np.r_[0, np.cumsum(lead & arrays.SPACED[data])]
        self._data = data
        self.chars = self._lead[end] - self._lead[begin]
        self.repeated = self._equal_to_earlier()

    def _equal_to_earlier(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        rest = self._data[self._data != 10]
        size = np.r_[0, np.cumsum(self.end - self.begin)]
        coded = arrays.binary_array(rest, size).dictionary_encode().indices
        code = coded.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first = np.unique(self.text * (len(code) + 1) + code, return_index=True)
        again = np.ones(len(code), bool)
        again[first] = False
        return again & (self.stop > self.first)

    def per_text(self, of_line: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, of_line, self.n).astype(np.int64)

    def counts(self) -> dict[str, np.ndarray]:
        rows, total = self.words.rows, len(self.words)
        repeat = np.zeros(total, bool)
        if total >= 3:
            grams = arrays.gram_hashes(self.hashes, 3)
            owner = arrays.owners(rows)[: len(grams)].astype(np.uint64)
            ok = arrays.starts_of_windows(rows, 3, total)[: len(grams)]
            spot = np.flatnonzero(ok)
            key = arrays.mix(grams[spot] + owner[spot] * np.uint64(0xD6E8FEB86659FD93))
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            repeat = arrays.covered(spot[times[back] > 1], 3, total)
        symbols = np.r_[0, np.cumsum(_SYMBOL[self._data])]
        return {
            "n_words": self.words.counts(),
            "word_chars": np.diff(self._lead[self.at]),
            "n_symbols": np.diff(symbols[self.at]),
            "n_dup_lines": self.per_text(self.repeated),
            "n_repeat_words": np.diff(np.r_[0, np.cumsum(repeat)][rows]),
        }

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Which lines have words, and a row of 0/1 features for each of these."""
        spot = np.flatnonzero(self.stop > self.first)

        def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(table[self._data])]
            return (total[self.end[spot]] - total[self.begin[spot]]) / np.maximum(of, 1)

        words = (self.stop - self.first)[spot]
        chars = self.chars[spot]
        letters = share(_LETTER, np.ones(len(spot)))
        same = np.zeros(len(self.hashes), bool)
        same[1:] = self.hashes[1:] == self.hashes[:-1]
        same = np.r_[0, np.cumsum(same)]
        echoes = (same[self.stop[spot]] - same[np.minimum(self.first[spot] + 1, self.stop[spot])])
        columns = [
            np.ones(len(spot), bool),
            share(_UPPER, letters) > 0.5,
            share(_SYMBOL, words) > 0.3,
            share(_BANG, words) > 0.3,
            share(_DIGIT, chars) > 0.2,
            self.repeated[spot],
            echoes / words > 0.3,
            words <= 2,
            words <= 6,
            words > 150,
            share(_LINK, words) > 0.1,
            _STOP[self._data[self.words.end[self.stop[spot] - 1] - 1]],
            chars / words > 12,
        ]
        return spot, np.stack(columns, 1)


@dataclass
class Crf:
    """Weights of content against boilerplate, and of label changes and first labels."""

    emit: np.ndarray
    change: np.ndarray  # [from, to], 0 boilerplate, 1 content
    first: np.ndarray

    def decode(self, features: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Most likely labels of lines; sequence i is rows[i] .. rows[i + 1]. All at once."""
        gain = features @ self.emit
        size = np.diff(rows)
        order = np.argsort(-size, kind="stable")
        start, size = rows[:-1][order], size[order]
        label = np.zeros(len(gain), np.int8)
        if not len(gain):
            return label
        steps = int(size[0])
        back = np.zeros((len(gain), 2), np.int8)
        alive = int((size > 0).sum())
        score = np.zeros((alive, 2)) + self.first
        score[:, 1] += gain[start[:alive]]
        best_end = score.copy()
        for t in range(1, steps):
            alive = int(np.searchsorted(-size, -t, side="left"))  # longer than t
            ways = score[:alive, :, None] + self.change
            back[start[:alive] + t] = ways.argmax(1)
            score = ways.max(1)
            score[:, 1] += gain[start[:alive] + t]
            best_end[:alive] = score
        state = best_end.argmax(1)
        for t in range(steps - 1, -1, -1):
            alive = int(np.searchsorted(-size, -t, side="left"))
            at = start[:alive] + t
            label[at] = state[:alive]
            state[:alive] = back[at, state[:alive]] if t else state[:alive]
        return label


def _adam(loss_grad, at: np.ndarray, rounds: int) -> np.ndarray:  # noqa: ANN001
    first, second = np.zeros_like(at), np.zeros_like(at)
    for t in range(1, rounds + 1):
        grad = loss_grad(at)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        at = at - 0.2 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return at


def _fit_lines(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    def grad(w: np.ndarray) -> np.ndarray:
        error = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y
        return x.T @ error / len(y) + 1e-3 * w

    return _adam(grad, np.zeros(x.shape[1]), rounds)


def _fit_chain(x: np.ndarray, y: np.ndarray, size: np.ndarray, rounds: int = 60) -> Crf:
    """Maximum likelihood by forward and backward sums.

    Lines of all sequences are flat; sequences come longest first, so those that
    reach a step are a prefix and step t of sequence i is at ``begin[i] + t``.
    """
    width = x.shape[1]
    begin = np.cumsum(size) - size
    reach = [int((size > t).sum()) for t in range(int(size[0]))]
    at = [begin[:n] + t for t, n in enumerate(reach)]
    gold = np.zeros((2, 2))
    for here, there in zip(at, at[1:], strict=False):
        np.add.at(gold, (y[here[: len(there)]], y[there]), 1)
    gold_emit, gold_first = x[y == 1].sum(0), np.bincount(y[begin], minlength=2)

    def grad(w: np.ndarray) -> np.ndarray:
        emit, change, first = w[:width], w[width : width + 4].reshape(2, 2), w[-2:]
        gain = np.zeros((len(x), 2))
        gain[:, 1] = x @ emit
        fore, after = np.zeros_like(gain), np.zeros_like(gain)
        fore[begin] = first + gain[begin]
        for here, there in zip(at, at[1:], strict=False):
            way = fore[here[: len(there)], :, None] + change
            fore[there] = np.logaddexp(way[:, 0], way[:, 1]) + gain[there]
        ends = fore[begin + size - 1]
        norm = np.logaddexp(ends[:, 0], ends[:, 1])
        expect = np.zeros((2, 2))
        for here, there in reversed(list(zip(at, at[1:], strict=False))):
            n = len(there)
            ahead = change + (gain[there] + after[there])[:, None, :]
            after[here[:n]] = np.logaddexp(ahead[:, :, 0], ahead[:, :, 1])
            pair = fore[here[:n], :, None] + ahead - norm[:n, None, None]
            expect += np.exp(pair).sum(0)
        belief = np.exp(fore + after - np.repeat(norm, size)[:, None])
        out = np.concatenate([
            belief[:, 1] @ x - gold_emit,
            (expect - gold).ravel(),
            belief[begin].sum(0) - gold_first,
        ])
        return out / len(x) + 1e-3 * w

    w = _adam(grad, np.zeros(width + 6), rounds)
    return Crf(w[:width], w[width : width + 4].reshape(2, 2), w[-2:])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000) -> Crf:
    """The CRF of at most ``sample_rows`` labelled documents."""
    ship_package(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
        .filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    sample = own_columns(docs).join(F.broadcast(known), "doc_id").select("quality", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text"):
            lines = Lines(part.column("text"))
            spot, x = lines.features()
            at = np.searchsorted(lines.text[spot], np.arange(part.num_rows + 1))
            bits = (x.astype(np.int64) << np.arange(FEATURES)).sum(1)
            raw = bits.astype("<i2").view(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [part.column("quality"), arrays.binary_array(raw, at * 2)], ["quality", "bits"]
            )

    # two bytes a line of a bounded number of documents
    rows = sample.mapInArrow(extract, "quality int, bits binary").toPandas()
    rows = rows.sort_values(["quality", "bits"])
    return _learn(rows["quality"].tolist(), [np.frombuffer(b, "<i2") for b in rows["bits"]])


def _learn(quality: list[int], bits: list[np.ndarray]) -> Crf:
    if len({q for q, b in zip(quality, bits, strict=True) if len(b)}) < 2:
        return Crf(np.eye(FEATURES)[0] * 50, np.zeros((2, 2)), np.zeros(2))
    pieces, label = [], []
    for q, b in zip(quality, bits, strict=True):
        for low in range(0, len(b), PIECE):
            pieces.append(b[low : low + PIECE])
            label.append(q)
    order = np.argsort([-len(p) for p in pieces], kind="stable")
    pieces, label = [pieces[i] for i in order], [label[i] for i in order]
    size = np.array([len(p) for p in pieces])
    x = ((np.concatenate(pieces).astype(np.int64)[:, None] >> np.arange(FEATURES)) & 1).astype(float)
    good = np.repeat(np.array(label), size)
    plain = _fit_lines(x, good.astype(float))
    return _fit_chain(x, np.where(good == 1, 1, (x @ plain > 0).astype(int)), size)


def judge(
    docs: DataFrame,
    crf: Crf,
    content_share: float = 0.5,
    text: str = "text",
    into: str = "quality_rules",
) -> DataFrame:
    """Adds a struct of the base counts, characters in content lines, base_failed and kept."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, text):
            lines = Lines(part.column(text))
            counts = lines.counts()
            spot, x = lines.features()
            rows = np.searchsorted(lines.text[spot], np.arange(lines.n + 1))
            label = crf.decode(x, rows)
            of_line = np.zeros(len(lines.text))
            of_line[spot] = lines.chars[spot] * label
            content = lines.per_text(of_line)
            words = counts["n_words"]
            failed = (words < 50) | (100 * counts["n_repeat_words"] > 50 * words)
            kept = ~failed & (content >= content_share * counts["word_chars"])
            values = [*(counts[c] for c in _COUNTS), content, failed, kept]
            column = pa.StructArray.from_arrays([pa.array(v) for v in values], VERDICT.names)
            yield with_column(part, into, column)

    return docs.mapInArrow(run, schema_with(docs, into, VERDICT))
