from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from knitgraph.llm import centroids

VECTORS = "vec_id bigint, embedding array<double>, label int"


def plain(rows, k=8, rounds=10, seed=3):
    """[(vec_id, cluster, distance, cluster_inertia, inertia, digest)] in plain integers."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [int(v) * 1024 if abs(v) >= 1 << 53 else math.floor(v * 1024) for v in x]))
    starts = [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None]
    centers = [v for _, v in sorted(starts)[:k]]
    gap = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    owner = lambda v: min(range(len(centers)), key=lambda c: (gap(v, centers[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(owner(v), []).append(v)
        for c, members in groups.items():
            centers[c] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, owner(v), gap(v, centers[owner(v)])) for i, v in kept]
    total = {}
    for _, c, d in found:
        total[c] = total.get(c, 0) + d
    fits = lambda d: d if d < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()
    whole = None if any(fits(d) is None for _, _, d in found) else fits(sum(total.values()))
    gone = {c for _, c, d in found if fits(d) is None}
    return [(i, c, fits(d), None if c in gone else fits(total[c]), whole, digest(c)) for i, c, d in found]


def compared(spark, rows, **how):
    frame = spark.createDataFrame([(i, x, 0) for i, x in rows], VECTORS)
    frame = frame.withColumn("x", F.lit("own")).withColumn("cluster", F.lit(-1)).withColumn("distance", F.lit("d"))
    found = centroids.cluster_report(*centroids.cluster_vectors(frame.repartition(5), **how))
    key = lambda r: tuple(str(v) for v in r)
    assert sorted([tuple(r) for r in found.collect()], key=key) == sorted(plain(rows, **how), key=key)


@pytest.fixture(scope="module")
def random():
    return np.random.default_rng(7)


def test_rounds_equal_plain_integers(spark, random):
    centers = random.normal(size=(6, 64))
    rows = [(i, (centers[i % 6] + random.normal(scale=0.4, size=64)).tolist()) for i in range(300)]
    compared(spark, rows)


def test_odd_vectors(spark, random):
    good = random.normal(size=(12, 64)).tolist()
    rows = [(i, v) for i, v in enumerate(good)]
    rows += [(0, good[1]), (0, good[1]), (None, good[2]), (3, good[3]), (20, None), (21, []), (22, [0.5] * 63), (23, [0.5] * 65)]
    rows += [(24, [None] + [0.5] * 63), (25, [math.nan] * 64), (26, [math.inf] * 64), (27, [-0.0] * 64), (28, [1e-9] * 64)]
    compared(spark, rows, rounds=4)


def test_few_vectors_ties_and_none(spark):
    compared(spark, [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64)], rounds=3)
    compared(spark, [(9, [0.5] * 64)], rounds=2)
    empty = spark.createDataFrame([], VECTORS)
    assert centroids.cluster_report(*centroids.cluster_vectors(empty)).count() == 0


@pytest.mark.parametrize("large", [2.0**14, 2.0**40, 1e30, 1.7e308])
def test_large_finite_components(spark, random, large):
    rows = [(i, v) for i, v in enumerate(random.normal(size=(20, 64)).tolist())]
    rows += [(30, [large] * 64), (31, [-large] + [0.25] * 63), (32, [large, -large] * 32)]
    compared(spark, rows, rounds=3)


def test_search_is_exact_and_reads_less(random):
    points = random.integers(-3000, 3000, size=(500, 64))
    centers = np.concatenate([random.integers(-3000, 3000, size=(5, 64)), points[:2], points[:1]])
    found, distance, read = centroids.nearest(centroids.transform(points), centroids.transform(centers))
    gaps = ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
    assert (found == gaps.argmin(axis=1)).all() and (distance == gaps.min(axis=1)).all()
    smooth = np.repeat(random.integers(-3000, 3000, size=(500, 1)), 64, axis=1) + random.integers(-5, 5, size=(500, 64))
    _, _, fewer = centroids.nearest(centroids.transform(smooth), centroids.transform(smooth[:8]))
    assert read <= 500 * 8 * 64 and fewer < 500 * 8 * 64 // 3
    assert (centroids.inverse(centroids.transform(points).astype(object)) == points).all()
    for value in (0, 1, -1, 2**32, -(2**70) - 5, 2**200):
        assert sum(d << (32 * p) for p, d in centroids.digits(value)) == value
