"""Pre-tokens of byte-level BPE vocabularies, found on whole slices at once.

The split is the published pattern of these vocabularies: contractions, letter,
digit and other runs with at most one leading space, and white space of which
the last character before a word stands apart.  Here it is a rule on neighbouring
character classes, so no regular expression walks the text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from tokenizers import pre_tokenizers

from telemetra.llm import arrays

OTHER, LETTER, DIGIT, SPACE, UNKNOWN = 0, 1, 2, 3, 4
#: The contractions of the pattern, by the letters after the apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point; UNKNOWN where Python's tables have none."""
    kinds = {"L": LETTER, "N": DIGIT, "Z": SPACE}
    found = (unicodedata.category(chr(i)) for i in range(0x110000))
    table = np.array(
        [UNKNOWN if c == "Cn" else kinds.get(c[0], OTHER) for c in found], np.uint8
    )
    table[[*range(0x09, 0x0E), 0x85]] = SPACE  # white space of the control category
    return table


def _ask(points: np.ndarray) -> None:
    """Learn code points newer than Python's tables from the tokenizer library."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    for i in np.unique(points).tolist():
        ends = [end for _, (_, end) in split(f"a{chr(i)}1{chr(i)}")]
        kind = OTHER if 1 in ends else LETTER
        if kind == OTHER and 3 not in ends:
            kind = DIGIT
        classes()[i] = kind


def word_starts(points: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Mask of the code points that begin a pre-token; ``opens`` marks where texts begin."""
    if not len(points):
        return np.zeros(0, bool)
    kind = classes()[points]
    if (kind == UNKNOWN).any():
        _ask(points[kind == UNKNOWN])
        kind = classes()[points]
    blank = kind == SPACE
    last = np.empty(len(points), bool)  # the last code point of its text
    last[:-1], last[-1] = opens[1:], True
    before = np.empty_like(kind)
    before[0], before[1:] = OTHER, kind[:-1]
    changes = kind != before
    after_plain = np.zeros(len(points), bool)  # right after U+0020, which joins what follows
    after_plain[1:] = points[:-1] == 32
    ahead = np.ones(len(points), bool)  # white space follows, or the text ends
    ahead[:-1] = blank[1:]
    ahead |= last
    start = np.where(blank, changes | ~ahead, changes & ~after_plain)
    start |= opens
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        _contract(points, opens, start, quote)
    return start


def _contract(
    points: np.ndarray, opens: np.ndarray, start: np.ndarray, quote: np.ndarray
) -> None:
    n = len(points)
    free = np.ones(len(quote), bool)  # not yet matched by an earlier contraction
    for tail in CONTRACTIONS:
        fits = free & (quote + len(tail) < n)
        for j, letter in enumerate(tail, 1):
            at = np.minimum(quote + j, n - 1)
            fits &= (points[at] == ord(letter)) & ~opens[at]
        free &= ~fits
        begun = quote[fits]
        start[begun + 1] = False  # the letters belong to the apostrophe
        stop = begun + len(tail) + 1
        start[stop[stop < n]] = True


class WordCodes:
    """Ids of texts through the ids of their distinct pre-tokens.

    ``encode`` turns distinct words into ids.  Words stay known to the worker
    until ``limit`` of them are held; then it starts anew, which costs time only.
    """

    def __init__(
        self,
        encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]],
        special: tuple[tuple[str, int], ...] = (),
        limit: int = 1 << 19,
    ):
        self.encode, self.limit = encode, limit
        self.special = [(s, s.encode(), i) for s, i in special]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        flat, at = self.encode(words)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, at[:-1] + self.used])
        self.length = np.concatenate([self.length, np.diff(at)])
        self.used += len(flat)
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def texts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, and their offsets."""
        raw = data.tobytes()
        if any(mark in raw for _, mark, _ in self.special):
            return self._with_special(raw, at)
        if len(self.known) > self.limit:
            self._clear()
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        first_byte = np.flatnonzero((data & 0xC0) != 0x80)
        opens = np.zeros(len(points), bool)
        begin = at[:-1][at[1:] > at[:-1]]
        opens[np.searchsorted(first_byte, begin)] = True
        edges = np.append(first_byte[word_starts(points, opens)], len(data))
        rows = np.searchsorted(edges[:-1], at)
        buffers = [None, pa.py_buffer(edges), pa.py_buffer(raw)]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, buffers)
        coded = words.dictionary_encode()
        unique = coded.dictionary.to_pylist()
        fresh = [w for w in unique if w not in self.known]
        if fresh:
            self._learn(fresh)
        place = np.fromiter(map(self.known.__getitem__, unique), np.int64, len(unique))
        word = place[coded.indices.to_numpy(zero_copy_only=False)]
        length = self.length[word]
        end = np.zeros(len(word) + 1, np.int64)
        np.cumsum(length, out=end[1:])
        source = np.repeat(self.start[word] - end[:-1], length)
        source += np.arange(end[-1])
        return self.ids[source], end[rows]

    def _with_special(self, raw: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of which some hold special tokens: the parts between them stand alone."""
        marks = {m: i for _, m, i in self.special}
        cut = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(marks, key=len)[::-1])) + b")")
        parts: list[bytes] = []
        tokens: list[int] = []  # -1: an ordinary part
        rows = [0]
        for low, high in zip(at[:-1], at[1:], strict=True):
            for part in cut.split(raw[low:high]):
                parts.append(b"" if part in marks else part)
                tokens.append(marks.get(part, -1))
            rows.append(len(parts))
        data, part_at = arrays.flat(pa.array(parts, pa.large_binary()))
        plain = WordCodes.__new__(WordCodes)
        plain.__dict__ = self.__dict__ | {"special": []}
        ids, id_at = plain.texts(data, part_at)
        self.__dict__.update({k: v for k, v in plain.__dict__.items() if k != "special"})
        token = np.array(tokens, np.int64)
        spot = np.flatnonzero(token >= 0)
        ids = np.insert(ids, id_at[spot], token[spot])
        shift = np.zeros(len(parts) + 1, np.int64)
        shift[1:] = np.cumsum(token >= 0)
        return ids, (id_at + shift)[rows]
