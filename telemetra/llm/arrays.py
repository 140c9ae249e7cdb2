"""Texts of an Arrow batch as flat numpy arrays.

Every operator with Python tasks works on slices of a batch: the UTF-8 bytes of
some whole texts in one array with the texts' offsets.  A slice is cut by bytes,
so memory follows the slice and not the batch; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
#: Bits of a unit's place in a slice; no slice has more units, as no text has 2^31 bytes.
PLACE_BITS = 32
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    is_text = pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)
    texts = texts.cast(pa.large_string() if is_text else pa.large_binary())
    if texts.null_count:
        texts = pc.fill_null(texts, "" if is_text else b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(column))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(at, at[low] + limit, side="right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low)
            low = high
        pa.default_memory_pool().release_unused()  # workers outlive their tasks


def _class_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Byte classes; all separators are ASCII, so bytes of longer characters belong to words.
SPACED = _class_table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = _class_table(
    bytes(b for b in range(128) if not (chr(b).isdigit() or "a" <= chr(b) <= "z"))
)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of a slice: byte ranges, owners, and a 64-bit hash of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray):
        inside = table[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        opens = at[:-1][at[1:] > at[:-1]]  # a word never crosses texts
        first[opens] = inside[opens]
        closes = at[1:][at[1:] > at[:-1]] - 1
        last[closes] = inside[closes]
        self.data = data
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of text d: rows[d] .. rows[d + 1]
        self.rows = np.searchsorted(self.start, at)
        self._packed = data[inside]

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def as_arrow(self) -> pa.Array:
        at = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.end - self.start, out=at[1:])
        buffers = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(self._packed))]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), buffers)

    def hashes(self) -> np.ndarray:
        """xxh3 of each word; equal words are hashed once."""
        coded = self.as_arrow().dictionary_encode()
        unique = hash_all(coded.dictionary.to_pylist())
        return unique[coded.indices.to_numpy(zero_copy_only=False)]


def hash_all(values: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def gram_hashes(units: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n units; position i is the run that starts at i."""
    count = max(len(units) - n + 1, 0)
    if not count:
        return np.zeros(0, np.uint64)
    factor = U64((_BASE + 2 * seed) & _MASK)
    out = units[:count].copy()
    for j in range(1, n):
        out *= factor
        out += units[j : j + count]
    return mix(out + U64(n * _BASE & _MASK))


def starts_of_windows(rows: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask over unit positions: a window of ``size`` units of one text starts here.

    ``rows`` are the texts' n + 1 offsets in the unit array of length ``total``.
    """
    ok = np.ones(total, bool)
    for back in range(1, size):  # the last size - 1 positions of each text
        at = rows[1:] - back
        ok[at[at >= rows[:-1]]] = False
    return ok


def owners(rows: np.ndarray) -> np.ndarray:
    """The text of each unit."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def covered(starts: np.ndarray, size: int | np.ndarray, total: int) -> np.ndarray:
    """Mask of units inside any run of ``size`` units that begins at ``starts``."""
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + size, -1)
    return np.cumsum(change[:-1]) > 0


def binary_array(parts: np.ndarray, at: np.ndarray, text: bool = False) -> pa.Array:
    """Bytes cut at ``at`` as a binary (or, known to be valid, a string) column."""
    kind = pa.large_string() if text else pa.large_binary()
    buffers = [
        None,
        pa.py_buffer(np.ascontiguousarray(at, np.int64)),
        pa.py_buffer(np.ascontiguousarray(parts)),
    ]
    column = pa.Array.from_buffers(kind, len(at) - 1, buffers)
    return column.cast(pa.string() if text else pa.binary())


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)


def sliding_min(values: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each run of ``span`` values, by runs of doubled length."""
    width = 1
    while 2 * width <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = span - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(
    units: np.ndarray, rows: np.ndarray, size: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed anchors: (first window, number of windows, hash) of each run.

    The anchor of a window of ``size`` units is the leftmost of its grams of least
    hash, so equal windows choose the same gram wherever they stand.  Windows in
    a row with one anchor are a run; none crosses texts.
    """
    none = np.zeros(0, np.int64)
    if len(units) < size:
        return none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(units, gram)
    low = U64((1 << PLACE_BITS) - 1)  # the same for every slice, as equal windows must choose alike
    ranked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ranked, size - gram + 1)
    spot = np.flatnonzero(starts_of_windows(rows, size, len(units))[: len(least)])
    if not len(spot):
        return none, none, np.zeros(0, np.uint64)
    place = (least[spot] & low).astype(np.int64)
    new = np.r_[True, (np.diff(place) != 0) | (np.diff(spot) != 1)]
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(spot)])
    return spot[begin], count, grams[place[begin]]


def span_hashes(units: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of the runs low .. high of units, equal for equal runs."""
    factor = 0xD1342543DE82EF95
    inverse = U64(pow(factor, -1, 1 << 64))

    def powers(base: np.uint64) -> np.ndarray:
        out = np.full(len(units) + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(mix(units) * powers(U64(factor))[:-1], out=total[1:])
    value = (total[high] - total[low]) * powers(inverse)[low]
    return mix(value + (high - low).astype(np.uint64) * U64(_BASE))


def runs(starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive starts of one owner as (index of the first, length); both sorted, distinct."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, (np.diff(starts) != 1) | (np.diff(owner) != 0)]
    begin = np.flatnonzero(new)
    return begin, np.diff(np.r_[begin, len(starts)])
