"""Plain versions of the operators, for small inputs."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=True):
    raw = (text or "").encode()
    return (raw.translate(LOW) if lower else raw).split()


def shingles(text, size):
    w = words(text)
    k = min(size, len(w))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def similar(rows, size, percent):
    """rows: unique (doc_id, text). {doc_id: (size of the set, component)}"""
    sets = {d: shingles(t, size) for d, t in rows}
    links = [(a, b) for a in sets for b in sets
             if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}


def without_repeats(rows, width):
    """rows: unique (doc_id, text). {doc_id: (words, removed, kept)}"""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = words(t, lower=False)
        gone = set()
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            if key in seen:
                gone |= set(range(i, i + width))
            seen.add(key)
        out[d] = (len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def contained(rows, items, size, percent):
    out = set()
    for i, t in items:
        want = shingles(t, size)
        if want:
            k = len(next(iter(want)))
            for d, text in rows:
                w = words(text)
                have = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}
                if 100 * len(want & have) >= percent * len(want):
                    out.add((d, i, len(want), len(want & have)))
    return out


def near(rows, least):
    """rows: unique (vec_id, vector or None). {vec_id: (links, component)}"""
    good = {i: np.array(v, float) for i, v in rows
            if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least]
    degree = Counter(x for pair in links for x in pair)
    root = roots([i for i, _ in rows], links)
    return {i: (degree[i], root[i]) for i, _ in rows}


def base_scores(rows):
    """rows: (doc_id, text, held_out). {doc_id: (tokens, known, all training tokens, score)}"""
    token = {d: words(t) + [None] for d, t, _ in rows}
    count = Counter(w for d, _, held in rows if not held for w in token[d])
    n, v = sum(count.values()), len(count)
    return {d: (len(t), sum(count[w] > 0 for w in t), n, sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)) for d, t in token.items()}


def crc_ids(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups(rows):
    out = defaultdict(list)
    for key, value in rows:
        out[key].append(value)
    return out
