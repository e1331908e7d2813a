"""Plain-Python answers for small graphs, written independently of the operators."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations


def canonical(pairs):
    return sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})


def neighbors(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def triangles(edges):
    near = neighbors(edges)
    return sorted(
        (a, b, c)
        for a in near
        for b, c in combinations(sorted(v for v in near[a] if v > a), 2)
        if c in near[b]
    )


def support(cells):
    return Counter(e for t in cells for e in combinations(t, 2))


def core(edges, k, max_rounds=None):
    """({vertex: degree}, [removed per round])"""
    near = neighbors(edges)
    removed = []
    while max_rounds is None or len(removed) < max_rounds:
        bad = {v for v, n in near.items() if len(n) < k}
        if not bad:
            break
        removed.append(len(bad))
        near = {v: n - bad for v, n in near.items() if v not in bad}
    return {v: len(n) for v, n in near.items()}, removed


def truss(edges, k):
    """({edge: support}, [removed per round])"""
    cells = triangles(edges)
    live = dict(support(cells))
    removed = []
    while bad := {e for e, s in live.items() if s < k - 2}:
        removed.append(len(bad))
        cells = [t for t in cells if not bad & set(combinations(t, 2))]
        counts = support(cells)
        live = {e: counts[e] for e in live if e not in bad}
    return live, removed


def levels(edges):
    """{edge: tau}, by asking for every truss in turn."""
    tau, k = {}, 3
    while rest := truss(edges, k)[0]:
        tau.update({e: k - 2 for e in rest})
        k += 1
    return tau


def random_graph(seed, vertices, edges):
    """Pairs with repeats, loops, both directions and two hubs."""
    rng = random.Random(seed)
    pairs = [(rng.randrange(vertices), rng.randrange(vertices)) for _ in range(edges)]
    return pairs + [(hub, v) for hub in (0, 1) for v in range(vertices)]


def cliques(*groups):
    return [pair for group in groups for pair in combinations(group, 2)]
