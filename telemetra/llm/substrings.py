"""Substring deduplication on words: seed on winnowed anchors and extend.

A window is ``size`` consecutive words of one document.  Every window has one
anchor, the least of its word grams, chosen by what the window holds; so equal
windows share an anchor and only documents that meet on an anchor can share text.
Three steps:

1. Seed.  Each run of windows with one anchor is a row: anchor, hash of the words the
   run spans, place.  Rows meet by anchor.  Anchors seen once are dropped.
   A run whose whole span has an earlier equal is a repeat from end to end.
2. Extend.  The first run of each different span goes on both ways from its
   anchor, window by window, and windows meet by a 128-bit hash; all but the first
   place of a window are repeats.
3. Repeated windows of a document are chained into maximal repeats of at least
   ``size`` words, whose words are removed.

No pairs are made, so a passage in n documents costs n rows.  Before each shuffle a
task keeps the first place of equal runs or windows alone and reports the rest
as repeats, so a hot passage costs one row for each task.  Reducers stream sorted
rows and hold one of them.  The text is shuffled once and joined twice.

Places are ordered by doc_id (null first), then, for different texts with one
doc_id, by a hash of the text, then by position.  Rows equal in both count as one
document and get the same result.  A null text has no words; texts under
``size`` words lose nothing; an empty table gives an empty result.  All columns
are kept; ``into`` is added, or replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemetra.llm import arrays
from telemetra.llm.common import KEYED, keyed, schema_with, shield, span_arrays, span_table, with_column
from telemetra.session import ship_package

GRAM = 6
#: Rows after which a task drops equal ones and hands on the rest.
HELD = 1 << 20
_PLACE = ["_doc", "_tie", "pos"]
_ROW = "sure boolean, a long, b long, _doc long, _tie long, pos int, m int"
_ROW_ARROW = pa.schema([
    ("sure", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("_doc", pa.int64()),
    ("_tie", pa.int64()), ("pos", pa.int32()), ("m", pa.int32()),
])

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


class _Rows:
    """Rows a task has found, reduced to the first place of each key."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        """a, b, _doc, _tie, pos, m"""
        self.parts.append(list(columns))
        self.size += len(columns[0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        a, b, doc, tie, pos, m = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.__init__()
        order = np.lexsort((pos, tie, doc, b, a))
        a, b, doc, tie, pos, m = (c[order] for c in (a, b, doc, tie, pos, m))
        same = np.r_[False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])]
        yield _batch(np.zeros((~same).sum(), bool), *(c[~same] for c in (a, b, doc, tie, pos, m)))
        if same.any():
            # equal rows of one document at one place (repeated input rows) are one place
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
            later = same & ((doc != doc[head]) | (tie != tie[head]) | (pos != pos[head]))
            yield from _sure(doc[later], tie[later], pos[later], m[later])


def _sure(
    doc: np.ndarray, tie: np.ndarray, pos: np.ndarray, m: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """Runs known to be repeats; runs that touch are one row, dealt by document."""
    if not len(doc):
        return
    order = np.lexsort((pos, tie, doc))
    doc, tie, pos, m = (c[order] for c in (doc, tie, pos, m))
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(tie) != 0) | (pos[1:] > (pos + m)[:-1])]
    begin = np.flatnonzero(new)
    end = np.maximum.reduceat(pos + m, begin)
    deal = arrays.signed(arrays.mix(doc[begin].astype(np.uint64) + pos[begin].astype(np.uint64)))
    yield _batch(
        np.ones(len(begin), bool), deal, np.zeros(len(begin), np.int64), doc[begin], tie[begin],
        pos[begin], end - pos[begin],
    )


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c).cast(f.type) for c, f in zip(columns, _ROW_ARROW, strict=True)],
        schema=_ROW_ARROW,
    )


def _emit(
    find: Callable[[pa.RecordBatch, arrays.Words], tuple[np.ndarray, ...]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that collects what ``find`` sees in each slice: text, a, b, pos, m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for part in arrays.slices(batches, "text"):
            words = arrays.Words(*arrays.flat(part.column("text")), arrays.SPACED)
            text, a, b, pos, m = find(part, words)
            doc, tie = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_doc", "_tie"))
            rows.add(a, b, doc[text], tie[text], pos - words.rows[text], m)
            if rows.size > HELD:
                yield from rows.flush()
        yield from rows.flush()

    return run


def _seeds(size: int) -> Callable:
    def find(part: pa.RecordBatch, words: arrays.Words) -> tuple[np.ndarray, ...]:
        units = words.hashes()
        first, count, gram = arrays.anchors(units, words.rows, size, min(GRAM, size))
        text = np.searchsorted(words.rows, first, side="right") - 1
        span = arrays.span_hashes(units, first, first + count + size - 1)
        return text, arrays.signed(gram), arrays.signed(span), first, count

    return find


def _windows(size: int) -> Callable:
    def find(part: pa.RecordBatch, words: arrays.Words) -> tuple[np.ndarray, ...]:
        units = words.hashes()
        text, pos, m = span_arrays(part.column("_spans"))
        at = np.repeat(words.rows[text] + pos, m)
        at += np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
        one, two = (arrays.gram_hashes(units, size, seed) for seed in (1, 2))
        text = np.repeat(text, m)
        return text, arrays.signed(one[at]), arrays.signed(two[at]), at, np.ones(len(at), np.int64)

    return find


def _judge_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b, place): sure rows, later equals, and firsts to extend.

    A first row is only worth extending if its anchor has another span too, which the
    next rows show; so the first row of an anchor waits.
    """
    anchor = span = place = waiting = None
    for batch in batches:
        sure, a, b, doc, tie, pos, m = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n = len(a)
        a_prev, b_prev = _shift(a, anchor), _shift(b, span)
        same_a = a == a_prev
        same_a[0] &= anchor is not None
        same = same_a & (b == b_prev) & ~sure
        same[0] &= span is not None
        head = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        head_doc, head_tie, head_pos = (
            np.where(head >= 0, c[head], 0 if place is None else place[i])
            for i, c in enumerate((doc, tie, pos))
        )
        later = same & ((doc != head_doc) | (tie != head_tie) | (pos != head_pos))
        firsts = np.flatnonzero(~same & ~sure)
        more = np.zeros(n, bool)  # firsts of an anchor with several spans
        more[firsts] = same_a[firsts]
        opening = firsts[~same_a[firsts]]
        follower = np.searchsorted(firsts, opening, side="right")
        known = follower < len(firsts)
        more[opening[known]] = same_a[firsts[follower[known]]]
        if waiting is not None and len(firsts):
            if same_a[firsts[0]]:
                yield _batch(*(np.array([v]) for v in waiting))
            waiting = None
        if len(opening) and opening[-1] == firsts[-1]:
            i = opening[-1]
            waiting = (False, a[i], b[i], doc[i], tie[i], pos[i], m[i])
        out = sure | later | more
        yield _batch((sure | later)[out], *(c[out] for c in (a, b, doc, tie, pos, m)))
        real = np.flatnonzero(~sure)
        if len(real):
            i = real[-1]
            anchor, span = a[i], b[i]
            if head[i] >= 0:
                j = head[i]
                place = (doc[j], tie[j], pos[j])


def _shift(values: np.ndarray, first: np.int64 | None) -> np.ndarray:
    return np.r_[values[:1] if first is None else np.array([first]), values[:-1]]


def _judge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, b, place): all but the first place of a window are repeats."""
    for batch in _judge_seeds(batches):
        yield batch.filter(batch.column("sure"))


def _met(found: DataFrame, judge: Callable) -> DataFrame:
    """Rows of one key together, in order of place, and what ``judge`` says of them."""
    together = found.repartition("a").sortWithinPartitions("a", "b", *_PLACE)
    return together.mapInArrow(judge, _ROW)


def repeats(docs: DataFrame, size: int) -> DataFrame:
    """(_doc, _tie, _spans): runs of repeated windows of keyed documents."""
    texts = docs.select("_doc", "_tie", "text")
    seeds = _met(texts.mapInArrow(_emit(_seeds(size)), _ROW), _judge_seeds)
    # both uses read whole lists and whole rows, so each exchange is made once
    lists = seeds.groupBy("_doc", "_tie").agg(
        F.collect_list(F.struct("sure", "pos", "m")).alias("_runs")
    )
    opened = docs.join(lists, ["_doc", "_tie"]).withColumn("_spans", _some("_runs", False))
    opened = opened.filter(F.size("_spans") > 0)
    grown = _met(opened.mapInArrow(_emit(_windows(size)), _ROW), _judge_windows)
    known = lists.select("_doc", "_tie", F.explode(_some("_runs", True)).alias("k"))
    every = grown.select("_doc", "_tie", "pos", "m").unionByName(
        known.select("_doc", "_tie", "k.pos", "k.m")
    )
    return span_table(every)


def _some(runs: str, sure: bool) -> Column:
    return F.filter(runs, lambda r: r["sure"] == F.lit(sure))


def remove_repeats(docs: DataFrame, size: int = 20, into: str = "repeats") -> DataFrame:
    """Adds a struct: n_words, n_removed, kept (words left, by single spaces), text (in place)."""
    ship_package(docs.sparkSession)
    docs, back = shield(docs.drop(into), *KEYED)
    rows = keyed(docs)
    found = repeats(rows, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, "text"):
            data, at = arrays.flat(part.column("text"))
            words = arrays.Words(data, at, arrays.SPACED)
            row, pos, m = span_arrays(part.column("_spans"))
            gone = arrays.covered(words.rows[row] + pos, m + size - 1, len(words))
            removed = np.diff(np.r_[0, np.cumsum(gone)][words.rows])
            texts = part.column("text")
            kept, cut = [], []
            for i in range(part.num_rows):
                low, high = words.rows[i], words.rows[i + 1]
                left = [
                    data[s:e].tobytes()
                    for s, e, g in zip(
                        words.start[low:high], words.end[low:high], gone[low:high], strict=True
                    )
                    if not g
                ] if removed[i] else None
                whole = data[at[i] : at[i + 1]].tobytes()
                kept.append(b" ".join(whole.split(None) if left is None else left).decode())
                cut.append(texts[i].as_py() if left is None else _cut(words, at, i, gone, whole))
            column = pa.StructArray.from_arrays(
                [pa.array(words.counts()), pa.array(removed), pa.array(kept), pa.array(cut, pa.string())],
                RESULT.names,
            )
            yield with_column(part, into, column)

    joined = rows.join(found, ["_doc", "_tie"], "left")
    found = joined.mapInArrow(run, schema_with(joined, into, RESULT))
    return found.drop("_doc", "_tie", "_spans").withColumnsRenamed(back)


def _cut(words: arrays.Words, at: np.ndarray, i: int, gone: np.ndarray, whole: bytes) -> str:
    """The text without its removed words and the space between them."""
    low, high = words.rows[i], words.rows[i + 1]
    edge = np.diff(np.r_[0, gone[low:high].astype(np.int8), 0])
    out, done = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(whole[done : words.start[low + a] - at[i]])
        done = words.end[low + b - 1] - at[i]
    return b"".join([*out, whole[done:]]).decode()
