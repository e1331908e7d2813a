"""Exact top-k inner product search with a vector-approximation file.

Components become integer levels floor(256 x). A block of rows keeps its levels twice: as cells (the level
without its low bits) and whole. A block of queries bounds its scores against all cells of a block of rows by
two matrix products: with lower and upper cell edges per sign of the query. Rows are then read
whole in the order of their upper bounds until the k-th best score is at least the next bound, so
the result is exact. The best of each row block are merged by a window over k rows a block.

Queries and rows meet block by block: each block of rows is sent once to each block of queries. No broadcast
is asked for.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part, and
neither do rows with a null id; vectors of another length than a query's are no candidates of it; rows
that repeat an id are candidates of their own, but a query's own id is none; ties go to the smaller id.
Levels from `MAX_LEVEL` on, whose scores could pass 64 bits, raise an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knitgraph.plans import Workspace

SCALE = 256
#: Low bits of a level that its cell leaves out.
CELL_BITS = 4
MAX_LEVEL = 1 << 26
ROW_BLOCK = 2048
QUERY_BLOCK = 256


def levels(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, length and integer levels of the rows that take part."""
    x = F.col(vector)
    usable = (
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    )
    level = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), level.alias("level"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    out = batch.column("level").flatten().to_numpy().reshape(-1, dim)
    if len(out) and np.abs(out).max() >= MAX_LEVEL:
        raise ValueError("a component is too large for exact integer scores")
    return out


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` rows of one length: block number, ids and levels as binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for at in range(0, part.num_rows, size):
                    some = part.slice(at, size)
                    ids, levels = some.column("vec_id").to_numpy(), _matrix(some, int(dim))
                    name, made = (TaskContext.get().partitionId() << 32) + made, made + 1
                    yield pa.RecordBatch.from_pydict(
                        {"name": [name], "dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()], "levels": [levels.astype(np.int32).tobytes()]}
                    )

    return rows.mapInArrow(run, "name bigint, dim int, ids binary, levels binary")


def search_block(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and scores of its k best rows in a block."""
    low = (rows >> CELL_BITS << CELL_BITS).astype(np.float64)
    high = low + ((1 << CELL_BITS) - 1)
    plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    upper = plus @ high.T + minus @ low.T
    lower = plus @ low.T + minus @ high.T
    slack = 1e-9 * (np.abs(upper) + np.abs(lower)) + 1e-6  # rounding of the bounds themselves
    upper, lower = upper + slack, lower - slack
    same = own[:, None] == ids[None, :]
    upper[same], lower[same] = -np.inf, -np.inf
    out = []
    for q in range(len(queries)):
        certain = np.partition(lower[q], len(ids) - k)[len(ids) - k] if len(ids) > k else -np.inf
        near = np.flatnonzero((upper[q] >= certain) & ~same[q])
        near = near[np.argsort(-upper[q, near], kind="stable")]
        best_s, best_i = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(4 * k, 16)
        for at in range(0, len(near), step):
            if len(best_s) >= k and best_s[k - 1] > upper[q, near[at]]:
                break
            some = near[at : at + step]
            best_s = np.append(best_s, rows[some].astype(np.int64) @ queries[q])
            best_i = np.append(best_i, ids[some])
            order = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[order], best_i[order]
        out.append((best_i, best_s))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of `vectors` for each of `queries`."""
    work = Workspace(vectors.sparkSession, "vectors")
    rows = _blocks(levels(vectors, vector), ROW_BLOCK)
    wanted = work.save(levels(queries, vector), "queries")
    filled = wanted.df.repartition(max(1, -(-wanted.rows // QUERY_BLOCK)))
    # Written, so that the names of the blocks stay what they are if a task runs again.
    asked = work.save(_blocks(filled, QUERY_BLOCK), "query-blocks").df.select(
        F.col("name").alias("asked"), "dim", F.col("ids").alias("query_ids"), F.col("levels").alias("query_levels")
    )
    names = asked.select("asked", "dim").groupBy("dim").agg(F.collect_list("asked").alias("asked"))
    # Every block of rows goes once to every block of queries of its length.
    met = rows.join(names, "dim").withColumn("asked", F.explode("asked")).join(asked, ["asked", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                data = np.frombuffer(row["levels"], dtype=np.int32).reshape(-1, dim).astype(np.int64)
                asked = np.frombuffer(row["query_levels"], dtype=np.int32).reshape(-1, dim).astype(np.int64)
                own = np.frombuffer(row["query_ids"], dtype=np.int64)
                found = search_block(asked, own, data, np.frombuffer(row["ids"], dtype=np.int64), k)
                n = [len(i) for i, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(own, n)),
                        pa.array(np.full(sum(n), row["asked"])),
                        pa.array(np.repeat(np.arange(len(own)), n).astype(np.int32)),
                        pa.array(np.concatenate([i for i, _ in found])),
                        pa.array(np.concatenate([s for _, s in found])),
                    ],
                    ["query_id", "asked", "place", "vec_id", "score"],
                )

    found = met.select("asked", "dim", "ids", "levels", "query_ids", "query_levels").mapInArrow(
        run, "query_id bigint, asked bigint, place int, vec_id bigint, score bigint"
    )
    # Rows that repeat a query are queries of their own.
    best = Window.partitionBy("query_id", "asked", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
