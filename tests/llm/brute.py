"""Plain single-machine versions that the operators are held against."""

import hashlib
from collections import Counter, defaultdict
from itertools import combinations


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def substring(rows, k=20):
    first, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            x = tuple(w[s : s + k])
            if x in first:
                gone[s : s + k] = [True] * k
            first.add(x)
        out[i] = (len(w), sum(gone), sha(b" ".join(a for a, g in zip(w, gone) if not g)))
    return out


def suffix(rows, k=50):
    first, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        d = (text or "").encode()
        gone, own = [False] * len(d), []
        for s in range(len(d) - k + 1):
            if d[s : s + k] in first:
                gone[s : s + k] = [True] * k
            own.append(d[s : s + k])
        first.update(own)
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out[i] = (len(d), sum(gone), runs, sha(bytes(b for b, g in zip(d, gone) if not g)))
    return out


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[a : a + n]) for a in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for e in s:
            where[e].append(i)
    common = Counter(p for v in where.values() for p in combinations(v, 2))
    parent, links = {i: i for i in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i), links[i]) for i in sets}


def low(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return {i: (max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), sha(low(t))) for i, t in rows}
