"""Round-by-round peeling: k-core and truss subgraph are the same loop.

*Elements* are what gets removed (vertices, or edges) and *cells* are what
counts for them (edges, or triangles). An element stays while it is in enough
live cells. Each round removes the elements that are below the threshold, all at
once, and the cells of removed elements die with them.

What is written in a round is proportional to what dies in it:

* Live counts are a log: one table with the first count of every element, then
  per round a patch with the new counts of the elements that lost a cell. Counts
  only fall, so the newest row of an element is its smallest.
* The removed elements are broadcast to the cells while they are few (their
  number is known from the write before), so cells are scanned but not shuffled.
  They accumulate as a mask until half of the cells are dead. Then cells and
  counts are rewritten: each rewrite of the cells is at most half as large as
  the one before, all of them together no larger than the first table.
* When too many elements leave at once for a broadcast, cells are joined by
  shuffle, with hot elements split off, and are rewritten in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knitgraph.operators.edges import canonical_edges, oriented_edges
from knitgraph.operators.triangles import (
    directed_triangles,
    neighbor_lists,
    triangle_partner_lists,
    triangle_partner_sizes,
    triangles_by_id,
    triangles_by_role,
)
from knitgraph.operators.stripping import strip
from knitgraph.plans.skew import DEFAULT_LIMITS, Limits, heavy_keys, lookup
from knitgraph.plans.workspace import Staged, Workspace, workspace


@dataclass(frozen=True)
class CellShape:
    """Where a cell row keeps the keys of its member elements."""

    keys: tuple[str, ...]
    members: tuple[tuple[str, ...], ...]

    def key_struct(self, member: tuple[str, ...]) -> str:
        fields = [f"{column} AS {key}" for column, key in zip(member, self.keys)]
        return f"struct({', '.join(fields)})"

    def on(self, member: tuple[str, ...]) -> dict[str, str]:
        return dict(zip(member, self.keys))

    def member_counts(self, cells: DataFrame, name: str) -> DataFrame:
        structs = ", ".join(self.key_struct(member) for member in self.members)
        return (
            cells.selectExpr(f"inline(array({structs}))")
            .groupBy(*self.keys)
            .agg(F.count(F.lit(1)).alias(name))
        )


VERTICES_OF_EDGE = CellShape(keys=("vertex",), members=(("src",), ("dst",)))
EDGES_OF_TRIANGLE = CellShape(
    keys=("src", "dst"), members=(("a", "b"), ("a", "c"), ("b", "c"))
)


def _latest(counts: DataFrame, shape: CellShape) -> DataFrame:
    """The newest row of each element in a log of falling counts."""
    return counts.groupBy(*shape.keys).agg(
        F.min("live").alias("live"),
        F.max("round").alias("round"),
        F.lit(0).cast("long").alias("lost"),
    )


@dataclass(frozen=True)
class Peeled:
    """The outcome of a peeling loop."""

    counts: DataFrame  # log of (keys, live, round, lost); round: when it could leave
    cells: Staged
    shape: CellShape
    threshold: int
    masked: int  # removed elements that counts and cells still contain
    removed: list[int]  # elements removed per round
    tables: tuple[Staged, ...] = ()  # what cells and counts are read from

    def _gone(self):
        return (F.col("live") < self.threshold) & (F.col("round") <= len(self.removed))

    def survivors(self, count: str) -> DataFrame:
        """The remaining elements with their number of live cells."""
        newest = _latest(self.counts, self.shape) if self.masked else self.counts
        return newest.filter(~self._gone()).select(
            *self.shape.keys, F.col("live").alias(count)
        )

    def live_cells(self) -> DataFrame:
        """The cells none of whose elements was removed."""
        if not self.masked:
            return self.cells.df
        return _without(self.cells.df, self.shape, self.counts.filter(self._gone()))


def rounds_table(spark: SparkSession, removed: list[int]) -> DataFrame:
    """Telemetry: one row per round that removed something."""
    return spark.createDataFrame(
        list(enumerate(removed, start=1)), "round bigint, removed bigint"
    )


# A scan of more paths than this would list them by a job of its own.
MAX_PATCHES = 24


def _zero() -> Column:
    return F.lit(0).cast("long")


def _hit(index: int) -> str:
    return f"hit_{index}"


def _hits(shape: CellShape) -> list[str]:
    return [_hit(i) for i in range(len(shape.members))]


def _mark(cells: DataFrame, shape: CellShape, gone: DataFrame, **how) -> DataFrame:
    """Cells with the removal round of each member, null for live members."""
    for index, member in enumerate(shape.members):
        cells = lookup(cells, gone, shape.on(member), {"round": _hit(index)}, **how)
    return cells


def _without(cells: DataFrame, shape: CellShape, gone: DataFrame) -> DataFrame:
    """The cells without a member in the (small) table of removed elements."""
    marked = _mark(cells, shape, gone, broadcast=True)
    return marked.filter(F.coalesce(*_hits(shape)).isNull()).drop(*_hits(shape))


def _losses(dying: DataFrame, shape: CellShape) -> DataFrame:
    """``(keys, lost)``: how many dying cells each live element is in."""
    live_members = [
        f"if({_hit(i)} IS NULL, {shape.key_struct(member)}, NULL)"
        for i, member in enumerate(shape.members)
    ]
    return (
        dying.selectExpr(f"inline(array({', '.join(live_members)}))")
        .filter(f"{shape.keys[0]} IS NOT NULL")
        .groupBy(*shape.keys)
        .agg(F.count(F.lit(1)).alias("lost"))
    )


def peel(
    work: Workspace,
    first_cells: Callable[[], Staged],
    shape: CellShape,
    threshold: int,
    max_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    step: str = "peel",
) -> Peeled:
    """Remove elements in fewer than ``threshold`` live cells until none is left
    to remove, or for ``max_rounds`` rounds.

    Elements without live cells stay until the next round removes them, and
    count as removed by that round. In a named run each round is noted under ``step`` before the tables it
    replaces are deleted; a later driver goes on after the last noted round.
    """
    keys = list(shape.keys)
    others = len(shape.members) - 1
    below = F.col("live") < threshold

    def save_counts(df: DataFrame) -> Staged:
        return work.save(
            df.select(*keys, "live", "round", "lost"),
            "counts",
            below=F.count_if(below),
            lost=F.sum("lost"),
        )

    removed: list[int] = []
    masked = dead = 0

    def note(leaving: int, replaced: list[Staged]) -> None:
        work.note(
            step,
            {
                "threshold": threshold, "cells": work.described(cells), "log": [work.described(t) for t in log], "removed": removed,
                "masked": masked, "dead": dead, "leaving": leaving,
            },
        )
        work.drop(*replaced)

    # The first cells are asked for only if no driver of this run has begun: later rounds delete them.
    if noted := work.noted(step):
        if noted["threshold"] != threshold:
            raise ValueError(f"this run was begun with a threshold of {noted['threshold']}")
        cells, log = work.found(noted["cells"]), [work.found(t) for t in noted["log"]]
        removed, masked, dead, leaving = noted["removed"], noted["masked"], noted["dead"], noted["leaving"]
    else:
        cells = first_cells()
        first = shape.member_counts(cells.df, "live")
        log = [save_counts(first.select("*", F.lit(1).alias("round"), _zero().alias("lost")))]
        leaving = log[0].measures["below"]
        note(leaving, [])
    while leaving and (max_rounds is None or len(removed) < max_rounds):
        past = len(removed)
        this_round = past + 1
        replaced: list[Staged] = []
        counts = work.read(*log)
        half_dead = cells.rows >= limits.rewrite_rows and 2 * dead > cells.rows
        if masked and (half_dead or masked + leaving > limits.broadcast_rows):
            gone = counts.filter(below & (F.col("round") <= past))
            smaller = work.save(_without(cells.df, shape, gone), "cells")
            newest = _latest(counts, shape).filter(~below | (F.col("round") > past))
            fresh = save_counts(newest)
            replaced += [cells, *log]
            cells, log, counts = smaller, [fresh], fresh.df
            masked = dead = 0

        removed.append(leaving)
        gone = counts.filter(below)
        if masked + leaving <= limits.broadcast_rows:
            marked = _mark(cells.df, shape, gone, broadcast=True)
            # `least` skips nulls: the round in which the cell lost its first member.
            lost = _losses(marked.filter(F.least(*_hits(shape)) == this_round), shape)
            # Each leaving element has fewer than `threshold` live cells, which
            # bounds the number of elements that lose one.
            if leaving * (threshold - 1) * others <= limits.broadcast_rows:
                lost = F.broadcast(lost)
            patch = (
                counts.drop("lost")
                .join(lost, keys)
                .groupBy(*keys)
                .agg(
                    (F.min("live") - F.max("lost")).alias("live"),
                    F.lit(this_round + 1).alias("round"),
                    F.max("lost").alias("lost"),
                )
            )
            fresh = save_counts(patch)
            log.append(fresh)
            masked += leaving
            # A cell that loses one member is lost for all the others.
            dead += fresh.measures["lost"] // others
        else:
            # Counts and cells hold live elements only, so a hot element has as many
            # cells as its count says. Those that stay are split off; one that leaves
            # has fewer than `threshold` cells and must be found among the leaving.
            staying = counts.filter(~below)
            heavy = heavy_keys(staying, "live", len(shape.members) * cells.rows, limits)
            if heavy is not None:
                heavy = heavy.withColumn("round", F.lit(None).cast("int"))
            marked = _mark(cells.df, shape, gone, heavy=heavy, limits=limits)
            live, dying = work.save_split(
                marked.withColumn("dies", F.coalesce(*_hits(shape)).isNotNull()), "cells", "dies", cells.df.schema
            )
            lost = _losses(dying.df, shape)
            lowered = (
                counts.drop("lost")
                .filter(~below)
                .join(lost, keys, "left")
                .select(
                    *keys,
                    (F.col("live") - F.coalesce("lost", _zero())).alias("live"),
                    F.lit(this_round + 1).alias("round"),
                    F.coalesce("lost", _zero()).alias("lost"),
                )
            )
            fresh = save_counts(lowered)
            replaced += [cells, *log, dying]
            cells, log = live, [fresh]
        leaving = fresh.measures["below"]
        if len(log) > MAX_PATCHES:
            merged = save_counts(_latest(work.read(*log[1:]), shape))
            replaced += log[1:]
            log = [log[0], merged]
        note(leaving, replaced)
    return Peeled(work.read(*log), cells, shape, threshold, masked, removed, (cells, *log))


def stage_edges(work: Workspace, edges: DataFrame) -> Staged:
    """Canonical edges as a table with a known size: they are read many times."""
    return work.once("edges", lambda: work.save(canonical_edges(edges), "edges"))


def stage_triangles(
    work: Workspace,
    edges: DataFrame,
    degrees: DataFrame,
    edge_count: int,
    limits: Limits,
    roles: bool = False,
) -> Staged:
    lists = neighbor_lists(work, oriented_edges(edges, degrees, edge_count, limits), edge_count, limits)
    found = work.save(triangles_by_id(directed_triangles(lists, limits), roles), "triangles")
    work.drop(lists.table)
    return found


def core_peel(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    max_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> Peeled:
    """Drop vertices with fewer than ``k`` remaining neighbors, round by round."""
    with workspace(spark, "core", work) as work:
        return peel(work, lambda: stage_edges(work, edges), VERTICES_OF_EDGE, k, max_rounds, limits, "core")


def core_subgraph(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    max_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """``(vertex, degree)`` of the k-core, degrees counted inside it.

    With ``max_rounds`` the graph may be only partly peeled: vertices that the
    next round would remove are included, even those with degree 0.
    """
    with workspace(spark, "core", work) as work:
        return core_peel(spark, edges, k, max_rounds, limits, work).survivors("degree")


def core_edges(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    max_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """The edges of the (possibly partly peeled) k-core."""
    return core_peel(spark, edges, k, max_rounds, limits, work).live_cells()


def core_rounds(
    spark: SparkSession, edges: DataFrame, k: int, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """``(round, removed)`` of the k-core peeling."""
    with Workspace(spark, "core") as work:
        removed = core_peel(spark, edges, k, None, limits, work).removed
    return rounds_table(spark, removed)


def triangles_in_core(
    work: Workspace,
    spark: SparkSession,
    edges: DataFrame,
    core: int,
    max_rounds: int | None,
    limits: Limits,
    roles: bool = False,
) -> Staged:
    """The triangles of the ``core``-core; of the whole graph if ``core`` < 2. With ``roles`` they keep
    the order (degree, id) of their vertices in that core."""

    done: list[Staged] = []

    def build() -> Staged:
        rounds = max_rounds if core >= 2 else 0
        peeled = core_peel(spark, edges, core, rounds, limits, work)
        remaining, degrees = peeled.cells, peeled.survivors("degree")
        done.extend(peeled.tables)
        if peeled.removed:
            # The edges are read three times below: apply the mask once.
            remaining = work.save(peeled.live_cells(), "edges")
            staged = work.save(degrees, "degrees")
            degrees = staged.df
            done.extend([remaining, staged])
        return stage_triangles(work, remaining.df, degrees, remaining.rows, limits, roles)

    found = work.once("triangles", build)
    work.drop(*done)
    return found


def truss_peel(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
    roles: bool = False,
) -> Peeled:
    """Drop edges in fewer than ``k - 2`` remaining triangles, round by round.

    The (k-1)-core is taken first, for at most ``prefilter_rounds`` rounds
    (None: to the end, 0: not at all). It holds every edge of the result, so it
    changes the work but not the answer.
    """
    if k < 3:
        raise ValueError("a truss needs k >= 3: below, no triangle is asked for")
    with workspace(spark, "truss", work) as work:

        def triangles() -> Staged:
            return triangles_in_core(work, spark, edges, k - 1, prefilter_rounds, limits, roles)

        return peel(work, triangles, EDGES_OF_TRIANGLE, k - 2, None, limits, "truss")


def truss_subgraph(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """``(src, dst, support)``: the largest subgraph whose every edge is in at
    least ``k - 2`` triangles of that subgraph, with those triangle counts.

    The tables that back it live in ``work`` until that is closed, or else until the session ends. With a
    named run in ``work``, a driver that was lost may be followed by one that calls this again."""
    return truss_peel(spark, edges, k, prefilter_rounds, limits, work).survivors("support")


def stripped_truss(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """The rows of :func:`truss_subgraph`, by a loop over incidence rows in folders by edge (see `stripping`): late
    rounds read the folders of the edges that leave. A named run in ``work`` goes on after a lost driver."""
    if k < 3:
        raise ValueError("a truss needs k >= 3: below, no triangle is asked for")
    with workspace(spark, "truss", work) as work:

        def first() -> tuple[Staged, int]:
            triangles = triangles_in_core(work, spark, edges, k - 1, prefilter_rounds, limits)
            return triangles, triangles.rows

        return strip(work, first, k - 2, limits=limits, step="stripped").survivors(work, limits, "support")


def truss_rounds(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(round, removed)`` of the truss peeling, after the prefilter."""
    with Workspace(spark, "truss") as work:
        removed = truss_peel(spark, edges, k, prefilter_rounds, limits, work).removed
    return rounds_table(spark, removed)


def truss_triangles(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """``(a, b, c)``: the triangles of the truss subgraph, with ascending ids."""
    return truss_peel(spark, edges, k, prefilter_rounds, limits, work).live_cells()


def truss_partner_sizes(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """``(src, dst, support, n_high, n_mid, n_low)`` of the edges of the truss: its third vertices that are
    still valid in it, by role. Roles follow the order (degree, id) in the graph whose triangles were listed,
    which is the prefiltered one; they travel with the triangles through the peeling."""
    inside = truss_peel(spark, edges, k, prefilter_rounds, limits, work, roles=True).live_cells()
    return triangle_partner_sizes(triangles_by_role(inside))


def truss_partner_lists(
    spark: SparkSession,
    edges: DataFrame,
    k: int,
    prefilter_rounds: int | None = None,
    max_thirds: int = 100_000,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """``(src, dst, part, support, high, mid, low)``: those third vertices as sorted arrays."""
    with workspace(spark, "truss", work) as work:
        peeled = truss_peel(spark, edges, k, prefilter_rounds, limits, work, roles=True)
        inside = work.save(triangles_by_role(peeled.live_cells()), "inside")
        return triangle_partner_lists(work, inside.df, inside.rows, max_thirds, limits)


def truss_edge_count(spark: SparkSession, edges: DataFrame, k: int) -> DataFrame:
    """``(edges)``: the number of edges of the truss subgraph."""
    return truss_subgraph(spark, edges, k).agg(F.count(F.lit(1)).alias("edges"))
