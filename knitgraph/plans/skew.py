"""Joins of a large row set with a table that holds each key once.

Vertex and edge keys of real graphs are skewed: a single hub can be an end of a
third of all edges. Two bounds that hold for any input are used here:

* the rows per key are known beforehand (degree or support), and at most
  ``heavy_keys`` keys can each own more than 1/``heavy_keys`` of all rows, so
  the heavy part of the table has a fixed maximum size and may be broadcast;
* everything below that share is too small to be a hot shuffle key.

Rows of heavy keys take their values from the broadcast part and are dealt out by
a hash of the whole row, so that no task receives a whole hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = "_spread"


@dataclass(frozen=True)
class Limits:
    """Sizes at which plans change; tests lower them to reach every branch."""

    # Tables of at most this many narrow rows (a few dozen MB) are broadcast.
    broadcast_rows: int = 500_000
    # With at most this many rows in total, one key may hold all of them.
    single_task_rows: int = 1_000_000
    # Tables with fewer rows are cheaper to scan with dead rows than to rewrite.
    rewrite_rows: int = 250_000
    # Upper bound on the number of keys treated as heavy.
    heavy_keys: int = 10_000
    # Rows per shuffle partition that a task may hold in an in-memory hash map.
    hash_join_rows: int = 2_000_000
    # Candidate ids of wedges that one task expands or intersects.
    wedge_ids: int = 4_000_000
    # Partitions of the triangle stage over those that its candidate ids call for.
    triangle_multiplier: int = 1
    # Incidence rows of a folder, about.
    bucket_rows: int = 500_000
    # Rows of hot keys that one task ranks.
    range_rows: int = 250_000


DEFAULT_LIMITS = Limits()


def heavy_keys(
    counts: DataFrame, count: str, total_rows: int, limits: Limits = DEFAULT_LIMITS
) -> DataFrame | None:
    """The keys that own too many rows for one task, or None if there cannot be any.

    ``total_rows`` must be the sum of ``count``; fewer than ``limits.heavy_keys``
    rows can then pass the filter.
    """
    if total_rows <= limits.single_task_rows:
        return None
    return counts.filter(F.col(count) > F.lit(total_rows // limits.heavy_keys))


def _hashed_broadcast(
    rows: DataFrame, table: DataFrame, on: dict[str, str], take: dict[str, str], how: str
) -> DataFrame:
    """A broadcast join whose hash map is keyed by one long.

    Probing that map costs a third of probing one with composite keys. The real
    (bigint) keys are compared bit by bit: equalities would join the hash key,
    and the generated code has to stay small enough to be compiled natively.
    """
    key_names = {column: f"_key_{column}" for column in on}
    hashed = table.selectExpr(
        f"xxhash64({', '.join(on.values())}) AS _hash",
        *[f"{key} AS {key_names[column]}" for column, key in on.items()],
        *[f"{column} AS {name}" for column, name in take.items()],
    )
    differing_bits = " | ".join(f"({c} ^ {k})" for c, k in key_names.items())
    matches = F.expr(f"xxhash64({', '.join(on)}) = _hash AND ({differing_bits}) = 0")
    return rows.join(F.broadcast(hashed), matches, how).drop("_hash", *key_names.values())


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: dict[str, str],
    take: dict[str, str],
    *,
    how: str = "left",
    broadcast: bool = False,
    heavy: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add columns of ``table`` to ``rows``.

    ``on`` maps a column of ``rows`` to the key column of ``table``, ``take``
    maps a column of ``table`` to its new name. ``heavy`` holds the rows of
    ``table`` whose keys are hot in ``rows`` and has the same columns.
    """
    keys = list(on)
    if broadcast and len(keys) > 1:
        return _hashed_broadcast(rows, table, on, take, how)

    def side(source: DataFrame, prefix: str = "") -> DataFrame:
        return source.selectExpr(
            *[f"{key} AS {column}" for column, key in on.items()],
            *[f"{column} AS {prefix}{name}" for column, name in take.items()],
        )

    wanted = [*rows.columns, *take.values()]
    if broadcast:
        return rows.join(F.broadcast(side(table)), keys, how).select(*wanted)
    if heavy is None:
        return rows.join(side(table), keys, how).select(*wanted)

    hot = side(heavy, "_hot_").withColumn("_is_hot", F.lit(True))
    probed = rows.join(F.broadcast(hot), keys, "left")
    # Rows of hot keys have their values: they join under a hash of the whole row, which deals
    # them out over all partitions and may match nothing or anything. A constant here would be
    # folded away, and the key alone would decide the partition again.
    first, *rest = keys
    probed = probed.withColumn(
        _SPREAD, F.when(F.col("_is_hot"), F.xxhash64(*rows.columns)).otherwise(F.col(first))
    )
    cold = side(table).withColumnRenamed(first, _SPREAD).withColumn("_is_cold", F.lit(True))
    joined = probed.join(cold, [_SPREAD, *rest], "left")
    if how == "inner":
        joined = joined.filter("_is_hot OR _is_cold")
    return joined.select(
        *rows.columns,
        *[
            F.when(F.col("_is_hot"), F.col(f"_hot_{name}")).otherwise(F.col(name)).alias(name)
            for name in take.values()
        ],
    )
