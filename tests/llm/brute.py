"""Plain evaluations of what the operators promise, for small tables."""

from __future__ import annotations

import re
from itertools import combinations

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text, words):
    raw = (text or "").encode()
    found = WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in raw))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1)))


def groups(texts: dict, words: int, num: int, den: int) -> dict:
    """Smallest key reachable by links, by looking at all pairs."""
    sets = {k: shingle_set(t, words) for k, t in texts.items()}
    top = {k: k for k in sets}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    # only sets that share a shingle can link
    by = {}
    for k, s in sets.items():
        for t in s:
            by.setdefault(t, []).append(k)
    for a, b in {p for ks in by.values() for p in combinations(sorted(ks), 2)}:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}
