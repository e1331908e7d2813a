"""Exact ranks of rows within their keys, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knitgraph.plans.workspace import Workspace


def ranked_rows(
    work: Workspace, rows: DataFrame, keys: list[str], order: list[str], total_rows: int, task_rows: int
) -> DataFrame:
    """``rows`` with ``rank``: their place within their key by ``order``, from 0.

    Rows are dealt out by ranges of (key, order), so that a hot key fills several ranges in order, and
    are written: the ranges come from a sample, and the steps below have to see the same ones. A
    first pass counts the rows of each key per range, which gives the place where a key starts in a range; a
    second pass numbers the rows inside it. No task holds more than a range. (key, order) must be unique.
    """
    ranges = max(1, -(-total_rows // task_rows))
    sorted_keys = [F.col(c) for c in (*keys, *order)]
    dealt = rows.repartitionByRange(ranges, *sorted_keys) if ranges > 1 else rows.coalesce(1)
    placed = work.save(dealt.withColumn("_range", F.spark_partition_id()), "ranges").df
    counted = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_here"))
    # A key has at most one row per range here, so this window is as small as the number of ranges.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*keys, "_range", F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range", *keys).orderBy(*sorted_keys[len(keys) :])
    numbered = placed.withColumn("_place", F.row_number().over(inside) - 1)
    return numbered.join(starts, [*keys, "_range"]).select(
        *rows.columns, (F.col("_start") + F.col("_place")).alias("rank")
    )
