"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of all distinct words of a slice lie in one flat array.  A round
looks up the rank of each new neighbour pair by binary search over the sorted
pair keys, takes the lowest rank of every word, and merges its occurrences from
left to right.  Words without a known pair leave the array.

Works row by row without a shuffle: repeated rows and ids, nulls in other
columns and clashing column names need no care.  A null text is empty and has
no ids; an empty table gives an empty table.  All columns of the input are kept
and ``ids_column`` (binary, unsigned 32-bit little-endian) is added, or
replaced if the input has one of that name.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from telemetra.llm import arrays
from telemetra.llm.common import local_file, schema_with, ship_file, with_column
from telemetra.llm.pretoken import WordCodes
from telemetra.session import ship_package

NONE = np.int64(np.iinfo(np.int64).max)
#: Bytes of text, or of ids, in a slice.
SLICE = 1 << 20


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others, in order, take the
    characters from U+0100.
    """
    out, spare = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Vocabulary:
    """Pair ranks and token bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)  # by rank
        keys = left << 32 | right
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.special = tuple((t["content"], t["id"]) for t in spec.get("added_tokens", []))
        size = max([*ids.values(), *(i for _, i in self.special)]) + 1
        spelled = [b""] * size
        value = {c: b for b, c in enumerate(letters)}
        for token, i in ids.items():
            spelled[i] = bytes(map(value.__getitem__, token))
        for content, i in self.special:
            spelled[i] = content.encode()
        self.bytes, self.at = arrays.flat(pa.array(spelled, pa.large_binary()))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, NONE where it has none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and their offsets."""
        data, at = arrays.flat(pa.array(words, pa.large_binary()))
        symbol = self.byte_ids[data]
        word = arrays.owners(at)
        rank = np.full(len(symbol), NONE)
        if len(symbol) > 1:
            rank[:-1] = self.ranks_of(symbol[:-1], symbol[1:])
            rank[:-1][word[:-1] != word[1:]] = NONE
        done_word, done_symbol = [], []
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            length = np.diff(np.r_[begin, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, begin), length)
            ready = lowest == NONE
            if ready.any():
                done_word.append(word[ready])
                done_symbol.append(symbol[ready])
                symbol, word, rank, lowest = (x[~ready] for x in (symbol, word, rank, lowest))
                if not len(symbol):
                    break
            symbol, word, rank = self._merge(symbol, word, rank, rank == lowest)
        if not done_word:
            return np.zeros(0, np.uint32), np.zeros(len(words) + 1, np.int64)
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return symbol[order].astype(np.uint32), np.searchsorted(
            word[order], np.arange(len(words) + 1)
        )

    def _merge(
        self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, lowest: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.flatnonzero(lowest)
        # in a run of overlapping pairs (aaa) every second one is taken, from the left
        breaks = np.r_[True, np.diff(at) > 1]
        run = np.maximum.accumulate(np.where(breaks, at, 0))
        at = at[(at - run) % 2 == 0]
        symbol[at] = self.made[rank[at]]
        keep = np.ones(len(symbol), bool)
        keep[at + 1] = False
        new = (np.cumsum(keep) - 1)[at]
        symbol, word, rank = symbol[keep], word[keep], rank[keep]
        stale = np.unique(np.concatenate([new, new[new > 0] - 1]))
        rank[stale] = NONE
        stale = stale[stale + 1 < len(symbol)]
        stale = stale[word[stale] == word[stale + 1]]
        rank[stale] = self.ranks_of(symbol[stale], symbol[stale + 1])
        return symbol, word, rank

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids of each text spell, and their offsets."""
        length = np.diff(self.at)[ids]
        end = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(length, out=end[1:])
        source = np.repeat(self.at[ids] - end[:-1], length)
        source += np.arange(end[-1])
        return self.bytes[source], end[at]


@functools.lru_cache(maxsize=2)
def _vocabulary(name: str) -> Vocabulary:
    return Vocabulary(local_file(name))


@functools.lru_cache(maxsize=2)
def _codes(name: str) -> WordCodes:
    vocabulary = _vocabulary(name)
    return WordCodes(vocabulary.encode_words, vocabulary.special)


def encode(
    docs: DataFrame, tokenizer: str, text: str = "text", ids_column: str = "ids"
) -> DataFrame:
    """Adds the ids of each whole text under the byte-level BPE file ``tokenizer``."""
    ship_package(docs.sparkSession)
    name = ship_file(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(name)
        for part in arrays.slices(batches, text, SLICE):
            ids, at = codes.texts(*arrays.flat(part.column(text)))
            raw = ids.astype("<u4").view(np.uint8)
            yield with_column(part, ids_column, arrays.binary_array(raw, at * 4))

    return docs.mapInArrow(run, schema_with(docs, ids_column, T.BinaryType()))


def decode(
    coded: DataFrame, tokenizer: str, ids_column: str = "ids", text: str = "decoded"
) -> DataFrame:
    """Adds the text that the ids spell; broken UTF-8 becomes U+FFFD. Null ids spell nothing."""
    ship_package(coded.sparkSession)
    name = ship_file(coded.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(name)
        for part in arrays.slices(batches, ids_column, SLICE):
            raw, at = arrays.flat(part.column(ids_column))
            spelled, end = vocabulary.decode(raw.view("<u4").astype(np.int64), at // 4)
            whole = spelled.tobytes()
            texts = [
                whole[a:b].decode("utf-8", "replace")
                for a, b in zip(end[:-1], end[1:], strict=True)
            ]
            yield with_column(part, text, pa.array(texts, pa.string()))

    return coded.mapInArrow(run, schema_with(coded, text, T.StringType()))
