"""Centroid clustering (Lloyd's rounds) with a Walsh-Hadamard progressive search, exact in integers.

Components become integers floor(1024 x). Vectors and centroids are multiplied by the Walsh-Hadamard matrix
in sequency order, whose rows are orthogonal with squared length 64, so the squared differences of the
coefficients sum to 64 times the squared distance. They are added from coarse to fine. After each stage a centroid
goes if its sum so far is larger than what another one can reach at most (its sum so far and twice the
energy left in both vectors); ties never go. What is left is finished over all 64 coefficients.

A round is one pass over the vectors, which are written once. A task sends the sums of its coefficients per
centroid; Spark adds them, and k * 65 sums come to the driver whatever the number of vectors. Sums travel
as digits of 32 bits, so they are exact for any finite component.

Defined cases: vectors that are null, of another length than 64, or with a null or non-finite
component are left out; rows that repeat an id are vectors of their own, and a null id is one, but never a
starting centroid; repeated ids that start are taken in the order of their components; with fewer
vectors than centroids each is one; no vector gives no row. A distance beyond 64 bits is null, and so is
the inertia it is part of. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.plans import Workspace

DIM = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
SEED = 3
#: Integers below this, and all their sums and products here, fit 64 bits; others are Python's.
SMALL = 1 << 23
_DIGIT = 32


def walsh(dim: int = DIM) -> np.ndarray:
    """The Walsh-Hadamard matrix with its columns by their number of sign changes, coarse to fine."""
    out = np.ones((1, 1), dtype=np.int64)
    while len(out) < dim:
        out = np.block([[out, out], [out, -out]])
    changes = (out[:, 1:] != out[:, :-1]).sum(axis=1)
    return out[np.argsort(changes, kind="stable")].T.copy()


_H = walsh()


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 x): int64 if all are small, else Python integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if np.abs(scaled).max(initial=0) < SMALL:
        return scaled.astype(np.int64)
    return np.array([[int(v) * SCALE if abs(v) >= 1 << 53 else math.floor(v * SCALE) for v in row] for row in x.tolist()], dtype=object)


def transform(levels: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors; exact, as products of small integers are exact in doubles."""
    if levels.dtype == object:
        return levels.dot(_H.astype(object))
    return (levels.astype(np.float64) @ _H.astype(np.float64)).astype(np.int64)


def inverse(coefficients: np.ndarray) -> np.ndarray:
    return coefficients.dot(_H.T.astype(object)) // DIM


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For coefficients of vectors and centroids: nearest centroid, squared distance, coefficients read."""
    kind = object if object in (points.dtype, centers.dtype) else np.int64
    points, centers = points.astype(kind, copy=False), centers.astype(kind, copy=False)
    n, k = len(points), len(centers)
    so_far = np.zeros((n, k), dtype=kind)
    alive = np.ones((n, k), dtype=bool)
    left_points, left_centers = (points * points).sum(axis=1), (centers * centers).sum(axis=1)
    at, read = 0, 0
    while at < DIM:
        to = max(1, 2 * at)
        row, center = np.nonzero(alive)
        gap = points[row, at:to] - centers[center, at:to]
        so_far[row, center] += (gap * gap).sum(axis=1)
        read += gap.size
        left_points = left_points - (points[:, at:to] ** 2).sum(axis=1)
        left_centers = left_centers - (centers[:, at:to] ** 2).sum(axis=1)
        most = so_far + 2 * (left_points[:, None] + left_centers[None, :])
        # A centroid that went has a larger sum than one that is left can reach: it bounds nothing.
        least_most = np.where(alive, most, most.max(axis=1, initial=0)[:, None]).min(axis=1)
        alive &= so_far <= least_most[:, None]
        at = to
    found = np.where(alive, so_far, so_far.max(initial=0) + 1).argmin(axis=1)
    return found, so_far[np.arange(n), found] // DIM, read


def digits(value: int) -> list[tuple[int, int]]:
    """(place, digit) with value = sum of digit * 2**(32 place); all digits have its sign."""
    sign, rest, out, place = (-1 if value < 0 else 1), abs(value), [], 0
    while rest or not out:
        out.append((place, sign * (rest & ((1 << _DIGIT) - 1))))
        rest >>= _DIGIT
        place += 1
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def _sums(points: DataFrame, centers: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """How many vectors each centroid has, and the sums of their coefficients."""
    k = len(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Place DIM holds the number of vectors.
        sums = [[0] * (DIM + 1) for _ in range(k)]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = transform(integers(_matrix(batch.column("x"))))
            owner, _, _ = nearest(found, centers)
            for c in np.unique(owner).tolist():
                mine = found[owner == c]
                for place, value in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                    sums[c][place] += value
        rows = [
            (c, place, limb, digit)
            for c in range(k) if sums[c][DIM]
            for place, value in enumerate(sums[c])
            for limb, digit in digits(value)
        ]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], ["c", "place", "limb", "digit"])

    sent = points.select("x").mapInArrow(run, "c bigint, place bigint, limb bigint, digit bigint")
    total = [[0] * (DIM + 1) for _ in range(k)]
    for r in sent.groupBy("c", "place", "limb").agg(F.sum("digit").alias("digit")).collect():
        total[r["c"]][r["place"]] += r["digit"] << (_DIGIT * r["limb"])
    return [t[DIM] for t in total], [t[:DIM] for t in total]


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and components as doubles of the vectors that take part."""
    x = F.col(vector)
    whole = (F.size(x) == DIM) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.filter(x.isNotNull() & whole).select("vec_id", x.cast("array<double>").alias("x"))


def cluster_vectors(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of every vector that takes part, and the final centroids."""
    spark = vectors.sparkSession
    work = Workspace(spark, "centroids")
    points = work.save(usable(vectors, vector), "points").df
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.filter("vec_id IS NOT NULL").orderBy(order, "x").limit(k).collect()
    centers = [integers(np.array([r["x"]]))[0].tolist() for r in first]
    for _ in range(rounds if centers else 0):
        counts, sums = _sums(points, _coefficients(centers))
        for c, n in enumerate(counts):
            if n:
                total = inverse(np.array([sums[c]], dtype=object))[0]
                centers[c] = [int(value) // n for value in total]
    if not centers:
        return spark.createDataFrame([], f"vec_id {points.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), np.zeros((0, DIM), object)
    last = _coefficients(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, distance, _ = nearest(transform(integers(_matrix(batch.column("x")))), last)
            fits = [d if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(owner.astype(np.int32)), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"]
            )

    kind = points.schema["vec_id"].dataType.simpleString()
    found = points.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    return work.save(found, "clusters").df, np.array(centers, dtype=object)


def _coefficients(centers: list[list[int]]) -> np.ndarray:
    small = max(abs(v) for c in centers for v in c) < SMALL
    return transform(np.array(centers, dtype=np.int64 if small else object))


def cluster_report(found: DataFrame, centers: np.ndarray) -> DataFrame:
    """`found` with the inertia of its cluster and of all, and a digest of its centroid."""
    # Up to one row a centroid: collected and sent to all tasks.
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("gone"))
    totals = {r["cluster"]: None if r["gone"] else int(r["s"]) for r in sums.collect()}

    def long(value: int | None) -> int | None:
        return value if value is not None and value < 1 << 63 else None

    inertia = None if None in totals.values() else sum(totals.values())
    rows = [
        (c, long(totals[c]), long(inertia), hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()) for c in sorted(totals)
    ]
    told = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
