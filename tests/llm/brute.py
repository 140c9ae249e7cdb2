"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def removed_words(rows, size):
    """{doc_id: (n_words, n_removed, kept)} of distinct ids; None sorts first."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = SPACED.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        left = [w for w, g in zip(words, gone) if not g]
        out[doc] = (len(words), sum(gone), sha(" ".join(left)))
    return out


def removed_bytes(rows, size):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone, own = [False] * len(data), set()
        for k in range(len(data) - size + 1):
            window = data[k : k + size]
            if window in seen:
                gone[k : k + size] = [True] * size
            own.add(window)
        seen |= own
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), spans, sha(kept))
    return out


def shingle_set(text, n):
    words = SPACED.findall(lower(text))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def near_groups(rows, n, percent):
    """{doc_id: (size of set, least id reached)}."""
    sets = {doc: shingle_set(text, n) for doc, text in rows}
    top = {doc: doc for doc in sets}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {doc: (len(sets[doc]), find(doc)) for doc in ids}


def marked(rows, items, n):
    windows = {}
    for item, text in items:
        words = ALNUM.findall(lower(text))
        size = min(n, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    out = {}
    for doc, text in rows:
        words, found = ALNUM.findall(lower(text)), set()
        hit = [False] * len(words)
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                items_here = windows.get(tuple(words[k : k + size]))
                if items_here:
                    found |= items_here
                    hit[k : k + size] = [True] * size
        out[doc] = (len(words), sum(hit), sorted(found))
    return out


def periodic(words):
    """All runs (start, length, period) of a list, by every lag; a run has its smallest period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((low, high - low, q) for (low, high), q in out.items())


def periodic_row(doc, text):
    """The row of op11 without its doc_id."""
    words = SPACED.findall(text or "")
    n = len(words)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = periodic(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *tail, sha(listed), sha(kept))


def ranked(rows, items, k):
    """[(item, rank, doc, score)] with None ids first."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(doc, Counter(term.findall(lower(text)))) for doc, text in rows]
    docs = [(doc, held, sum(held.values())) for doc, held in docs if held]
    df = Counter(t for _, held, _ in docs for t in held)
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * c + 1))) for t, c in df.items()}
    out = []
    for item, text in items:
        found = []
        for doc, held, n in docs:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(
                weight[t] * (10**9 * held[t] // (1000 * held[t] + 12 * m))
                for t in term.findall(lower(text)) if held[t]
            )
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        best = sorted(found)[:k]
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(best, 1)]
    return out


def fingerprint(text, words):
    found = SPACED.findall(lower(text))
    n = len(found)
    parts = [found[k : k + words] for k in range(n - words + 1)] if n >= words else [found][: min(n, 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(p).encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(marks, distance):
    """{mark: least mark reached}."""
    top = {m: m for m in marks}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    every = sorted(top)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= distance:
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return {m: find(m) for m in every}


def _without(text, spans, gone):
    """The text without runs of removed words and what separates the words of a run."""
    out, done, k = [], 0, 0
    while k < len(spans):
        if not gone[k]:
            k += 1
            continue
        last = k
        while last + 1 < len(spans) and gone[last + 1]:
            last += 1
        out.append(text[done : spans[k][0]])
        done = spans[last][1]
        k = last + 1
    return "".join([*out, text[done:]])


def pipeline(rows, items, toxic, tokenizer):
    """{doc_id: ids} after all stages; rows of distinct ids, ``toxic`` the ids that go first."""
    rows = [(d, t) for d, t in rows if d not in toxic]
    groups = near_groups(rows, 5, 80)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    seen, cut = set(), []
    for doc, text in sorted(rows):
        spans = [m.span() for m in SPACED.finditer(text or "")]
        words = [text[a:b] for a, b in spans]
        gone = [False] * len(words)
        for k in range(len(words) - 49):
            window = tuple(words[k : k + 50])
            if window in seen:
                gone[k : k + 50] = [True] * 50
            seen.add(window)
        if not (gone and all(gone)):
            cut.append((doc, _without(text, spans, gone) if any(gone) else text))
    leaks = marked(cut, items, 10)
    windows = {}
    for _, text in items:
        words = ALNUM.findall(lower(text))
        for k in range(max(len(words) - min(10, len(words)) + 1, 0) if words else 0):
            windows[tuple(words[k : k + min(10, len(words))])] = True
    out = {}
    for doc, text in cut:
        n, hit, _ = leaks[doc]
        if hit and 2 * hit >= n:
            continue
        spans = [m.span() for m in ALNUM.finditer(lower(text))]
        words = [lower(text)[a:b] for a, b in spans]
        gone = [False] * len(words)
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in windows:
                    gone[k : k + size] = [True] * size
        text = _without(text, spans, gone) if text is not None else ""
        out[doc] = tokenizer.encode(text, add_special_tokens=False).ids
    return out
