"""Plain versions of the operators, for comparison on small data."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1)))


def near_components(rows, n, percent):
    """rows: (id, text). {id: (size, component)}"""
    sets = {i: shingles(t, n) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        seen = {}
        for g in s:
            for j in by[g]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, k in seen.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}
