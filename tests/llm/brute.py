"""Plain Python forms of what the operators compute."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text, pattern=SPACED, lower=True):
    return pattern.findall((text or "").translate(LOW) if lower else text or "")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, a):
        self.up.setdefault(a, a)
        while self.up[a] != a:
            a = self.up[a]
        return a

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def contamination(docs, items, window=13):
    held = defaultdict(set)
    for item, text in items:
        w = words(text, ALNUM)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            held[tuple(w[i : i + n])].add(item)
    out = []
    for _, text in docs:
        w, hit, found = words(text, ALNUM), set(), set()
        for n in {len(k) for k in held}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    hit.update(range(i, i + n))
                    found |= held[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()


def near_duplicates(docs, n=3, part=85, whole=100):
    sets = {k: shingles(t, n) for k, t in docs}
    u = Union()
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            m = len(sets[a] & sets[b])
            if m and whole * m >= part * (len(sets[a]) + len(sets[b]) - m):
                u.join(a, b)
    return {k: (len(sets[k]), u.find(k)) for k in keys}


def dedup_substrings(docs, n=35):
    own = [words(t, lower=False) for _, t in docs]
    seen = Counter(tuple(w[i : i + n]) for w in own for i in range(len(w) - n + 1))
    out = []
    for (k, _), w in zip(docs, own, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append((k, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def dedup_lines(docs, part=80, whole=100, n=5):
    space = " \t\n\r\x0b\x0c"
    where = defaultdict(list)
    for k, t in sorted(docs, key=lambda d: d[0]):
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(space):
                where[line.strip(space)].append((k, i))
    lines = list(where)
    sets = [frozenset(b[i : i + n] for i in range(max(1, len(b) - n + 1))) for b in (x.encode() for x in lines)]
    u = Union()
    for i in range(len(lines)):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if whole * m >= part * (len(sets[i]) + len(sets[j]) - m):
                u.join(i, j)
    parts = defaultdict(list)
    for i, line in enumerate(lines):
        parts[u.find(i)] += where[line]
    drop = {p for v in parts.values() for p in sorted(v)[1:]}
    return {k: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in drop) for k, t in docs}
