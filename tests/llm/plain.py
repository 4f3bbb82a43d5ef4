"""Plain forms of the operators, for small inputs."""

import math
import re
from collections import defaultdict
from hashlib import md5


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(texts, similarity=0.8):
    """Links of each text, and its group's first index."""
    sets = [shingles(t) for t in texts]
    links, parent = [0] * len(sets), [*range(len(sets))]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = defaultdict(set)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in seen[g]}:
            both = len(s & sets[j])
            if both / (len(s) + len(sets[j]) - both) >= similarity:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            seen[g].add(i)
    return links, [find(i) for i in range(len(sets))]


def cut(rows, window=13):
    """(kept words, n_words) of (doc_id, text)."""
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in rows]
    owner = {}
    for k, w in words:
        if k is not None:
            for i in range(len(w) - window + 1):
                g = tuple(w[i : i + window])
                owner[g] = min(owner.get(g, k), k)
    out = []
    for k, w in words:
        gone = set()
        if k is not None:
            for i in range(len(w) - window + 1):
                if owner[tuple(w[i : i + window])] < k:
                    gone.update(range(i, i + window))
        out.append(([x for i, x in enumerate(w) if i not in gone], len(w)))
    return out


def copies(rows, seed="mix-1", temper=0.5):
    """Number of copies of (doc_id, source)."""
    n = defaultdict(int)
    for _, s in rows:
        n[s] += 1
    total = sum(v**temper for v in n.values())
    out = []
    for k, s in rows:
        rate = n[s] ** temper * len(rows) / (total * n[s])
        u = int(md5(f"{seed}|{'null' if k is None else k}|1".encode()).hexdigest()[:13], 16) / 2**52
        c, p, f = 0, math.exp(-rate), math.exp(-rate)
        while u >= f:
            c += 1
            p *= rate / c
            f += p
        out.append(c)
    return out
