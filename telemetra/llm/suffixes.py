"""Suffix arrays of many short strings in numpy.

Strings lie end to end in one byte array.  Suffixes end where their string ends;
a suffix that is a prefix of another comes first, equal suffixes stand in order
of position.
"""

from __future__ import annotations

import numpy as np

#: Symbols of the first sort: 7 codes of 9 bits, where 0 is the end of the string.
_FIRST = 7


def suffix_array(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of strings at[i] .. at[i + 1], and the rank of each position.

    Larsson-Sadakane refinement: suffixes sorted by h symbols are groups; only
    groups of several are sorted again, by the rank of what stands h further on,
    which doubles h.
    """
    n = len(data)
    end = np.repeat(at[1:], np.diff(at))
    code = np.zeros(n + _FIRST, np.uint64)
    code[:n] = data.astype(np.uint64) + np.uint64(1)
    key = np.zeros(n, np.uint64)
    here = np.arange(n)
    for j in range(_FIRST):
        key = (key << np.uint64(9)) | np.where(here + j < end, code[j : j + n], np.uint64(0))
    order = np.argsort(key)
    rank = _ranks(key[order], order, n)
    size = np.bincount(rank, minlength=n)
    loose = here[size[rank] > 1]  # positions in groups of several
    h, longest = _FIRST, int(np.diff(at).max(initial=0))
    while len(loose) and h < longest:
        ahead = loose + h
        inside = ahead < end[loose]
        after = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[loose].astype(np.int64) * (n + 1) + after
        place = np.argsort(key)
        key, loose = key[place], loose[place]
        group = key // (n + 1)  # the group's first rank
        begin = np.r_[True, key[1:] != key[:-1]]
        run = np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
        opens = np.r_[True, group[1:] != group[:-1]]
        base = np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))
        rank[loose] = group + run - base
        count = np.bincount(np.cumsum(begin) - 1)
        loose = loose[np.repeat(count, count) > 1]
        h *= 2
    # groups left are equal suffixes; position decides
    order = np.argsort(rank.astype(np.int64) * n + here)
    rank = np.empty(n, np.int64)
    rank[order] = here
    return order, rank


def _ranks(key: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """The first place of each position's group of equal keys."""
    new = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    return rank


def common_prefixes(
    data: np.ndarray, at: np.ndarray, order: np.ndarray, rank: np.ndarray
) -> np.ndarray:
    """For each place of the array, the common prefix with the place before (Kasai).

    Kasai's walk keeps all but one symbol of the last prefix when it steps to the next
    position; here all strings are walked at once, step by step.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    end = np.repeat(at[1:], np.diff(at))
    size = np.diff(at)
    by_size = np.argsort(-size, kind="stable")
    start, size = at[:-1][by_size], size[by_size]
    held = np.zeros(len(start), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        alive = int(np.searchsorted(-size, -t, side="left"))  # strings longer than t
        here = start[:alive] + t
        place = rank[here]
        before = order[np.maximum(place - 1, 0)]
        h = np.where(place > 0, np.maximum(held[:alive] - 1, 0), 0)
        most = np.where(place > 0, np.minimum(end[here] - here, end[before] - before), 0)
        going = np.flatnonzero(h < most)
        while len(going):
            same = data[here[going] + h[going]] == data[before[going] + h[going]]
            going = going[same]
            h[going] += 1
            going = going[h[going] < most[going]]
        out[place] = h
        held[:alive] = h
    return out
