"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of consecutive words of one text with smallest period q, at least
max(SHORTEST, REPEATS * q) words long, that no neighbouring word extends.

1. Splitting.  A word of a run stands at least ``REPEATS`` times in it.  So a word that
   is rarer than that within its segment (at first the text) is in no run, and what
   lies between such words are the new segments.  Segments that change are counted
   again until all are stable; all texts of a slice go through a round at once.
   Ordinary prose is used up in a few rounds.
2. Lag scan.  For each lag q a stable segment is looked at in steps of q: a run covers
   three blocks in a row at multiples of q, which are equal.  Blocks have the largest
   power of two of words up to q and are compared by hash; what agrees is grown word
   by word in both directions, so a hash never decides.  The steps of all lags together
   are n log n, and multiples of a run's period are not grown again inside it.

A text is never cut, and a task holds one slice of texts; nothing is shuffled.

Null texts and texts without words have no run and collapse to the empty text.
Ids, repeated rows and other columns play no part: each row is judged by its text, and all
columns are kept; ``into`` is added, or replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from telemetra.llm import arrays
from telemetra.llm.common import schema_with, with_column
from telemetra.session import ship_package

SHORTEST, REPEATS = 6, 4
SLICE_BYTES = 2 << 20

RUN = T.StructType(
    [T.StructField(name, T.LongType()) for name in ("start", "length", "period")]
)
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("strongest", RUN),
        T.StructField("collapsed", T.StringType()),
    ]
)
_RUN_ARROW = pa.struct([(name, pa.int64()) for name in RUN.names])

#: Given the row of a slice and the offsets of its texts in words, the word that stands at each
#: place (a permutation or repetition of places of the same text).
Order = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]


def stable_segments(code: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the segments left when rare words have split all others.

    ``code`` has a number for each word, ``rows`` the texts' n + 1 offsets.
    """
    place = np.arange(len(code))
    segment = arrays.owners(rows)
    span = int(code.max()) + 1 if len(code) else 1
    done: list[tuple[int, int]] = []
    while len(place):
        key = segment * span + code[place]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        frequent = count[which] >= REPEATS
        # a segment is stable if it has lost none of its words
        edge = np.flatnonzero(np.diff(segment)) + 1
        low = np.r_[0, edge]
        lost = np.logical_or.reduceat(~frequent, low)
        size = np.diff(np.r_[low, len(place)])
        for at, n in zip(place[low[~lost]].tolist(), size[~lost].tolist(), strict=True):
            if n >= SHORTEST:
                done.append((at, at + n))
        on = frequent & np.repeat(lost, size)
        place, segment = place[on], segment[on]
        if not len(place):
            break
        new = np.r_[True, (np.diff(place) != 1) | (np.diff(segment) != 0)]
        segment = np.cumsum(new) - 1
        long = np.bincount(segment) >= SHORTEST
        on = long[segment]
        place, segment = place[on], segment[on]
    return sorted(done)


def _grown(a: np.ndarray, x: int, q: int) -> tuple[int, int]:
    """The stretch around x whose words equal the word q further on, as (start, end)."""
    high, stop, step = x, len(a) - q, 64
    while high < stop:
        to = min(high + step, stop)
        differs = a[high:to] != a[high + q : to + q]
        if differs.any():
            high += int(differs.argmax())
            break
        high, step = to, min(2 * step, 1 << 16)
    low, step = x, 64
    while low > 0:
        to = max(low - step, 0)
        differs = (a[to:low] != a[to + q : low + q])[::-1]
        if differs.any():
            low -= int(differs.argmax())
            break
        low, step = to, min(2 * step, 1 << 16)
    return low, high + q


def lag_scan(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment of word numbers."""
    n = len(a)
    found: dict[tuple[int, int], int] = {}
    inside = np.full(n, -1)  # the run found last that covers a place
    spans: list[tuple[int, int, int]] = []
    blocks = arrays.mix(a.astype(np.uint64) + np.uint64(1))
    width = 1
    while width * REPEATS <= n:
        lags = np.arange(width, min(2 * width - 1, n // REPEATS) + 1)
        steps = np.maximum((n - width) // lags - 1, 0)
        q = np.repeat(lags, steps)
        x = (np.arange(len(q)) - np.repeat(np.cumsum(steps) - steps, steps)) * q
        same = (blocks[x] == blocks[x + q]) & (blocks[x + q] == blocks[x + 2 * q])
        x, q = x[same], q[same]
        if spans and len(x):  # a multiple of a run's period says nothing new inside it
            run = inside[x]
            low, high, period = np.array(spans).T
            known = (run >= 0) & (x >= low[run]) & (x + 2 * q + width <= high[run])
            known &= q % period[run] == 0
            x, q = x[~known], q[~known]
        edges = np.r_[0, np.flatnonzero(np.diff(q)) + 1, len(q)] if len(q) else [0]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            lag, places, k = int(q[low]), x[low:high], 0
            while k < len(places):
                begin, end = _grown(a, int(places[k]), lag)
                if end - begin >= max(SHORTEST, REPEATS * lag) and (begin, end) not in found:
                    found[begin, end] = lag
                    inside[begin:end] = len(spans)
                    spans.append((begin, end, lag))
                k = max(k + 1, int(np.searchsorted(places, end - 2 * lag - width, side="right")))
        if 2 * width * REPEATS > n:
            break
        blocks = arrays.mix(blocks[:-width] * np.uint64(0x9E3779B97F4A7C15) + blocks[width:])
        width *= 2
    return sorted((low, high - low, lag) for (low, high), lag in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equals the first, then the shortest period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(
    docs: DataFrame, text: str = "text", into: str = "periodic", order: Order | None = None
) -> DataFrame:
    """Adds a struct: n_words, runs, the strongest run, and the text with each run cut to one period.

    ``order`` says which word of a text stands at each place before runs are sought.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrays.slices(batches, text, SLICE_BYTES):
            data, at = arrays.flat(part.column(text))
            words = arrays.Words(data, at, arrays.SPACED)
            code = words.as_arrow().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            code = code.astype(np.int64)
            spoken = np.arange(len(code)) if order is None else order(part, words.rows)
            code = code[spoken]
            yield with_column(part, into, _column(words, code, spoken))

    return docs.mapInArrow(run, schema_with(docs, into, RESULT))


def _column(words: arrays.Words, code: np.ndarray, spoken: np.ndarray) -> pa.Array:
    n = len(words.rows) - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    kept = np.ones(len(code), bool)
    for low, high in stable_segments(code, words.rows):
        row = int(np.searchsorted(words.rows, low, side="right")) - 1
        for start, length, period in lag_scan(code[low:high]):
            kept[low + start + period : low + start + length] = False
            runs[row].append((low + start - int(words.rows[row]), length, period))
    for found in runs:
        found.sort(key=lambda r: (r[0], r[2]))
    named = [[dict(zip(RUN.names, r, strict=True)) for r in found] for found in runs]
    best = [strongest(found) for found in runs]
    return pa.StructArray.from_arrays(
        [
            pa.array(words.counts()),
            pa.array(named, pa.list_(_RUN_ARROW)),
            pa.array([r and dict(zip(RUN.names, r, strict=True)) for r in best], _RUN_ARROW),
            joined(words, spoken[kept], np.r_[0, np.cumsum(kept)][words.rows]),
        ],
        RESULT.names,
    )


def joined(words: arrays.Words, chosen: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Texts of the chosen words with a space between them; text d has rows[d] .. rows[d + 1]."""
    size = words.end[chosen] - words.start[chosen] + 1  # the word and a space
    last = rows[1:][rows[1:] > rows[:-1]] - 1
    size[last] -= 1  # but none at the end
    at = np.r_[0, np.cumsum(size)]
    source = np.arange(at[-1]) + np.repeat(words.start[chosen] - at[:-1], size)
    out = words.data[np.minimum(source, len(words.data) - 1)] if len(source) else source
    out = out.astype(np.uint8)
    gap = np.ones(len(chosen), bool)
    gap[last] = False
    out[at[1:][gap] - 1] = 32
    return arrays.binary_array(out, at[rows], text=True)
