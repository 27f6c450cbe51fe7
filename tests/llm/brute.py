"""Plain Python versions of the operators, for small inputs."""
import math
from collections import Counter, defaultdict

import xxhash


def words(text):
    return (text or "").encode().lower().split()


def simhash(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, bits=2):
    """Lowest index reachable for each fingerprint."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def line_dedup(docs):
    """{id: (n_lines, n_removed, text)} for distinct integer ids."""
    seen, out = set(), {}
    for i in sorted(docs):
        t = docs[i]
        if t is None:
            out[i] = (0, 0, None)
            continue
        lines, cut = t.split("\n"), set()
        for p in range(len(lines) - 2):
            k = tuple(lines[p:p + 3])
            if not any(x.strip(" \t\n\x0b\x0c\r") for x in k):
                continue
            if k in seen:
                cut |= {p, p + 1, p + 2}
            seen.add(k)
        out[i] = (len(lines), len(cut), "\n".join(x for p, x in enumerate(lines) if p not in cut))
    return out


def repeated_words(w):
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    return len({i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)})


class Katz:
    """A back-off model of any order: counts of all n-grams, every probability by its definition."""

    def __init__(self, training, discounts, order=2, top=5, delta=0.5):
        self.order, self.delta, self.c = order, delta, [Counter() for _ in range(order + 1)]
        self.after, self.total = defaultdict(set), Counter()
        for t in training:
            toks = ["^", *words(t), None]
            for n in range(1, order + 1):
                for i in range(max(1, n - 1), len(toks)):
                    g = tuple(toks[i - n + 1:i + 1])
                    self.c[n][g] += 1
                    if n > 1:
                        self.after[g[:-1]].add(g[-1])
                        self.total[g[:-1]] += 1
        self.d = [discounts([sum(v == r for v in c.values()) for r in range(1, top + 2)]) for c in self.c]
        self.top, self.n, self.v = top, sum(self.c[1].values()), len(self.c[1])
        kept = sum(self.cut(1, c) for c in self.c[1].values())
        self.unknown = max(1 - kept / self.n, 1 / (self.n + 1))
        self.scale = (1 - self.unknown) / kept
        self.c1 = {g[0]: c for g, c in self.c[1].items()}
        self.memo = {}

    def cut(self, n, c):
        return c * (self.d[n][c - 1] if c <= self.top else 1)

    def alpha(self, h):
        if h not in self.memo:
            total = self.total[h] + self.delta
            seen = sum(self.cut(len(h) + 1, self.c[len(h) + 1][(*h, w)]) for w in self.after[h])
            self.memo[h] = (total - seen) / total / (1 - sum(self.p(w, h[1:]) for w in self.after[h]))
        return self.memo[h]

    def p(self, w, h):
        if not h:
            return self.cut(1, self.c1[w]) * self.scale if w in self.c1 else self.unknown
        c = self.c[len(h) + 1].get((*h, w))
        if c:
            return self.cut(len(h) + 1, c) / (self.total[h] + self.delta)
        return (self.alpha(h) if h in self.total else 1.0) * self.p(w, h[1:])

    def score(self, text):
        toks = ["^", *words(text), None]
        return sum(math.log10(self.p(toks[i], tuple(toks[max(0, i - self.order + 1):i]))) for i in range(1, len(toks)))
