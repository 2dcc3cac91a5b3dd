"""Plain Python versions of the corpus operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER) if lower else text)


def substring_dedup(rows, window):
    """[(doc_id, text)] -> sorted [(doc_id, n_words, n_removed, sha)]."""
    split = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[s:s + window]) for _, w in split for s in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s:s + window])] > 1:
                gone[s:s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def suffix_dedup(rows, window):
    """[(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, sha)]; null ids come last."""
    key = lambda i: float("inf") if i is None else i
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - window + 1):
            first[b[s:s + window]] = min(key(i), first.get(b[s:s + window], float("inf")))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if first[b[s:s + window]] < key(i):
                gone[s:s + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, n):
    w = words(text, lower=True)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def minhash_groups(rows, n, num, den):
    """{doc_id: (n_shingles, component)} by comparing all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in rows}
    holders, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x])
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def line_dedup(rows, min_words):
    """[(doc_id, text)] with distinct ids -> {doc_id: (n_lines, n_removed, kept text)}."""
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            out[i] = (0, 0, None)
            continue
        kept, lines = [], t.split("\n")
        for line in lines:
            w = words(line)
            dup = any(w == v or (min(len(w), len(v)) >= min_words and one_edit(w, v)) for v in seen)
            if not w or not dup:
                kept.append(line)
            if w:
                seen.append(w)
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def leaks(docs, items, n=5, threshold=0.8):
    """{(doc_id, item_id): best similarity} over all windows of an item's word count."""
    def shingle_list(w):
        return [tuple(w[k:k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else ([tuple(w)] if w else [])

    out = {}
    for d, t in docs:
        w = words(t, lower=True)
        for i, text in items:
            v = words(text, lower=True)
            a, best = Counter(shingle_list(v)), 0.0
            if not a or not w:
                continue
            size = min(len(v), len(w))
            for s in range(len(w) - size + 1):
                b = Counter(shingle_list(w[s:s + size]))
                common = sum((a & b).values())
                best = max(best, common / (sum(a.values()) + sum(b.values()) - common))
            if best >= threshold:
                out[d, i] = best
    return out


def token_ids(tokenizer, text, end_id):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def neighbours(vectors, is_query, k):
    """[(id, vector or None)] -> {query id: [(id, score)]}, nearest first."""
    good = [(i, np.array(v, float)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if is_query(q):
            near = sorted(((-float((x * y).sum()), i) for i, y in good if i != q))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out
