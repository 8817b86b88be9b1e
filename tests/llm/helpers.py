"""Plain versions that the operators are held against."""

import re
from collections import defaultdict

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def components(n, links):
    """Least member of each member's component."""
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def groups(labels):
    out = defaultdict(set)
    for k, x in enumerate(labels):
        out[x].add(k)
    return sorted(map(sorted, out.values()))


def texts(seed, n, vocabulary=40):
    rng = np.random.default_rng(seed)
    names = [f"w{k}" for k in range(vocabulary)]
    return [" ".join(rng.choice(names, rng.integers(0, 60))) for _ in range(n)]
