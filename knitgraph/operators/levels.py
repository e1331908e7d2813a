"""The truss level of every edge, by local refinement.

``tau(e)`` is the largest s such that ``e`` lies in a subgraph whose every edge
is in at least s of its triangles. It is the fix-point of

    tau(e) <- H { min(tau(e1), tau(e2)) : triangle (e, e1, e2) }

starting from the edge support, where H is the h-index (Sariyuce, Seshadhri and
Pinar, PVLDB 12(1), 2018). Values only fall, so the loop ends when none changes. A round may also fall short of
the h-index, as long as it lowers every edge whose h-index is lower: the limit is the same.

`stripped_levels` finds the same levels from the bottom up (see `stripping`): settled edges and their triangles
leave, so the work of a round follows what it removes. It takes more rounds, which on graphs that fit a few tasks cost
more than they save.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knitgraph.operators.peeling import (
    EDGES_OF_TRIANGLE,
    MAX_PATCHES,
    triangles_in_core,
)
from knitgraph.operators.refining import edge_blocks, first_state, next_state, numbered_blocks, step_all
from knitgraph.operators.stripping import strip
from knitgraph.plans.skew import DEFAULT_LIMITS, Limits, heavy_keys, lookup
from knitgraph.plans.workspace import Staged, Workspace, workspace

_SHAPE = EDGES_OF_TRIANGLE
_KEYS = list(_SHAPE.keys)
_SIDES = range(len(_SHAPE.members))


def _attach(rows: DataFrame, table: DataFrame, column: str, prefix: str, **how) -> DataFrame:
    for side in _SIDES:
        rows = lookup(
            rows, table, _SHAPE.on(_SHAPE.members[side]), {column: f"{prefix}{side}"}, **how
        )
    return rows


def _edge_rows(rows: DataFrame, sides: list[tuple[str, str]]) -> DataFrame:
    """One row ``(src, dst, value)`` per side of a triangle for which its
    condition holds; ``sides`` lists (condition, value) for the three sides."""
    structs = [
        f"if({condition}, struct({_SHAPE.key_struct(member)} AS edge, {value} AS value), NULL)"
        for member, (condition, value) in zip(_SHAPE.members, sides)
    ]
    return (
        rows.selectExpr(f"inline(array({', '.join(structs)}))")
        .filter("edge IS NOT NULL")
        .select("edge.*", "value")
    )


def level_histogram_per_edge(
    levelled: DataFrame, conditions: tuple[str, ...] = ("true", "true", "true")
) -> DataFrame:
    """``(src, dst, value, triangles)``: the triangles of an edge by the lowest
    level in them, counted map-side first.

    The own level of the edge takes part in the minimum, which caps the values;
    an h-index step can only lower a level, so the cap does not alter it.
    """
    lowest = f"least({', '.join(f'tau_{side}' for side in _SIDES)})"
    return (
        _edge_rows(levelled, [(condition, lowest) for condition in conditions])
        .groupBy(*_KEYS, "value")
        .agg(F.count(F.lit(1)).alias("triangles"))
    )


def h_index_per_edge(histogram: DataFrame) -> DataFrame:
    """``(src, dst, level)``: the largest h such that h triangles reach h.

    A window group holds the distinct values of one edge. D distinct values
    need edges with supports up to D, so D is at most sqrt(6 * triangles).
    """
    from_top = (
        Window.partitionBy(*_KEYS)
        .orderBy(F.desc("value"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        histogram.withColumn("reaching", F.sum("triangles").over(from_top))
        .groupBy(*_KEYS)
        .agg(F.max(F.least("value", "reaching")).alias("level"))
    )


def attach_levels(
    triangles: DataFrame,
    levels: DataFrame,
    heavy: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Triangles with the levels of their edges ab, ac and bc."""
    return _attach(triangles, levels, "tau", "tau_", how="inner", heavy=heavy, limits=limits)


def refine_all(
    triangles: DataFrame,
    levels: DataFrame,
    heavy: DataFrame | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(src, dst, level)``: one h-index step for every edge. The rows of :func:`attach_levels`,
    :func:`level_histogram_per_edge` and :func:`h_index_per_edge`, which shuffle whole triangles once per side; many triangles are
    dealt to blocks of edges instead, as in the rounds of `refining`."""
    rows = triangles.count()
    if rows > limits.hash_join_rows:
        return step_all(triangles, levels, numbered_blocks(triangles.sparkSession, rows, limits))
    levelled = attach_levels(triangles, levels, heavy, limits)
    return h_index_per_edge(level_histogram_per_edge(levelled))


# Distances below the level of an edge at which its triangles are counted.
GAPS = (0, 1, 2, 4, 8, 16, 64, 256, 4096, 1 << 20, 1 << 30)


def lower_all(levelled: DataFrame) -> DataFrame:
    """``(src, dst, level)``: a level between the h-index of every edge and its present level, below the latter
    if the h-index is.

    The triangles of an edge that reach its level, or that minus a gap, are counted in one map-side
    aggregation. At the first gap g where as many triangles as the level minus g reach that, the h-index is at most
    the level minus the gap before, minus one; for the first gaps that is the h-index itself. So a fall of any
    size takes a few rounds, and there are no values to sort.
    """
    lowest = f"least({', '.join(f'tau_{side}' for side in _SIDES)})"
    sides = ", ".join(
        f"struct({_SHAPE.key_struct(member)} AS edge, tau_{side} AS tau, {lowest} AS value)"
        for side, member in enumerate(_SHAPE.members)
    )
    counted = levelled.selectExpr(f"inline(array({sides}))").selectExpr("edge.*", "tau", "value").groupBy(*_KEYS, "tau").agg(
        *[F.count_if(F.col("value") >= F.col("tau") - gap).alias(f"from_{gap}") for gap in GAPS]
    )
    steps = [f"WHEN from_{gap} >= tau - {gap} THEN tau - {before + 1}" for before, gap in zip(GAPS, GAPS[1:], strict=False)]
    fallen = f"CASE WHEN from_0 >= tau THEN tau {' '.join(steps)} ELSE tau - {GAPS[-1] + 1} END"
    return counted.selectExpr(*_KEYS, f"greatest(1, {fallen}) AS level")


def _latest(log: DataFrame) -> DataFrame:
    """The newest row of each edge in a log of falling levels."""
    return log.groupBy(*_KEYS).agg(F.min("tau").alias("tau"), F.max("support").alias("support"))


def _affected_edges(
    triangles: DataFrame, log: DataFrame, changed: DataFrame, small: bool, themselves: bool
) -> DataFrame:
    """``(src, dst, tau, support)`` of the edges that a change may lower: they
    share a triangle with a changed edge whose new level is below their own. The changed edges ``themselves``
    are among them if they did not fall to their h-index."""
    hit = _attach(triangles, changed, "tau", "new_", broadcast=True)
    # `least` skips nulls, that is partners that did not change.
    lowest = [
        f"least({', '.join(f'new_{other}' for other in _SIDES if other != side)})"
        for side in _SIDES
    ]
    reached = _edge_rows(hit, [(f"{value} IS NOT NULL", value) for value in lowest])
    if themselves:
        reached = reached.unionByName(changed.select(*_KEYS, F.lit(0).cast("long").alias("value")))
    reached = reached.groupBy(*_KEYS).agg(F.min("value").alias("reached_by"))
    return (
        log.join(F.broadcast(reached) if small else reached, _KEYS)
        .groupBy(*_KEYS)
        .agg(
            F.min("tau").alias("tau"),
            F.max("support").alias("support"),
            F.max("reached_by").alias("reached_by"),
        )
        .filter("reached_by < tau")
        .drop("reached_by")
    )


def _refine_affected(
    triangles: DataFrame, log: DataFrame, affected: DataFrame, small: bool
) -> DataFrame:
    """One h-index step for the affected edges: their rows with lower levels.

    The three edges of the triangles around them look up their levels as rows,
    so that the log is read once and not by one join per side.
    """
    flagged = affected.selectExpr(*_KEYS, "true AS affected")
    flags = [f"is_{side}" for side in _SIDES]
    near = _attach(triangles, flagged, "affected", "is_", broadcast=True).filter(
        f"coalesce({', '.join(flags)})"
    )
    corners = ["a", "b", "c", *flags]
    structs = ", ".join(_SHAPE.key_struct(member) for member in _SHAPE.members)
    sides = near.selectExpr(*corners, f"inline(array({structs}))")
    # The minimum over the log rows of all three edges is the lowest level.
    lowest = (
        log.join(F.broadcast(sides) if small else sides, _KEYS)
        .groupBy(*corners)
        .agg(F.min("tau").alias("lowest"))
    )
    histogram = (
        _edge_rows(lowest, [(flag, "lowest") for flag in flags])
        .groupBy(*_KEYS, "value")
        .agg(F.count(F.lit(1)).alias("triangles"))
    )
    return (
        h_index_per_edge(histogram)
        .join(affected, _KEYS)
        .filter("level < tau")
        .selectExpr(*_KEYS, "level AS tau", "support")
    )


def support_levels(triangles: DataFrame) -> DataFrame:
    """The starting levels: ``(src, dst, tau)`` with tau = support."""
    return _SHAPE.member_counts(triangles, "tau")


def _settle(
    work: Workspace, triangles: Staged, limits: Limits, exact_steps: bool = False
) -> tuple[DataFrame, list[int]]:
    """Refine until no level changes; also the number of changes per round.

    While many edges change, edges that fell tell it to the others of their triangles (see `refining`). Once few
    do, levels are a log like the counts of the peeling loop: a round takes the h-index of the edges around the changed
    ones and adds a patch. Should many change again, a round lowers all edges and rewrites the log, by whole
    h-index steps if ``exact_steps`` are asked for.
    """

    def save(df: DataFrame, name: str = "levels") -> Staged:
        """Levels; ``fell`` marks the edges that this round changed."""
        return work.save(
            df,
            name,
            fell=F.count_if("fell"),
            reach=F.sum(F.when(F.col("fell"), F.col("support"))),
        )

    blocks = edge_blocks(work, triangles.rows, limits)
    state = first_state(work, triangles.df, blocks)
    few = min(limits.broadcast_rows, state.rows // 4)
    changes: list[int] = []
    # Each changed edge reaches two edges per triangle it is in.
    while state.measures["fell"] and not (changes and 2 * state.measures["reach"] <= few):
        lower = next_state(work, state, blocks)
        work.drop(state.levels)
        state = lower
        changes.append(state.measures["fell"])
    log = [save(state.df.select(*_KEYS, "tau", "support", "fell"))]
    work.drop(state.levels, state.fixed)
    # Hot edges are those in many triangles.
    heavy_edges = heavy_keys(log[0].df, "support", 3 * triangles.rows, limits)
    if heavy_edges is not None:
        heavy_edges = work.save(heavy_edges.select(*_KEYS), "heavy")
    to_notify = log[0].measures["fell"]
    stepped = True
    while to_notify:
        newest = log[-1]
        everything = work.read(*log)
        patch = None
        # More edges are affected than changed: do not look for them in vain.
        if 2 * to_notify <= few:
            # Each changed edge reaches two edges per triangle it is in.
            small = 2 * newest.measures["reach"] <= limits.broadcast_rows
            changed = newest.df.filter("fell")
            affected = work.save(
                _affected_edges(triangles.df, everything, changed, small, themselves=not stepped),
                "affected",
                triangles=F.sum("support"),
            )
            if affected.rows <= few:
                small = 3 * affected.measures["triangles"] <= limits.broadcast_rows
                lower = _refine_affected(triangles.df, everything, affected.df, small)
                patch = save(lower.withColumn("fell", F.lit(True)))
            work.drop(affected)
        if patch is not None:
            log.append(patch)
            stepped = True
        else:
            stepped = exact_steps
            levels = everything.drop("fell") if len(log) == 1 else _latest(everything)
            heavy = None
            if heavy_edges is not None and heavy_edges.rows:
                heavy = levels.join(F.broadcast(heavy_edges.df), _KEYS)
            if exact_steps:
                proposed = refine_all(triangles.df, levels, heavy, limits)
            else:
                proposed = lower_all(attach_levels(triangles.df, levels, heavy, limits))
            rewritten = save(
                levels.join(proposed, _KEYS).selectExpr(
                    *_KEYS, "level AS tau", "support", "level < tau AS fell"
                )
            )
            work.drop(*log)
            log = [rewritten]
        to_notify = log[-1].measures["fell"]
        changes.append(to_notify)
        if len(log) > MAX_PATCHES:
            older = log[1:-1]
            merged = save(_latest(work.read(*older)).withColumn("fell", F.lit(False)))
            work.drop(*older)
            log = [log[0], merged, log[-1]]
    work.drop(triangles, heavy_edges)
    settled = work.read(*log)
    return (settled if len(log) == 1 else _latest(settled)), changes


def truss_levels(
    spark: SparkSession,
    edges: DataFrame,
    min_core: int = 0,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """``(src, dst, tau)`` of every edge in at least one triangle.

    With ``min_core`` the decomposition runs inside that core only: edges
    outside it are missing and low levels are relative to it.
    """
    with workspace(spark, "levels", work) as work:
        triangles = triangles_in_core(work, spark, edges, min_core, prefilter_rounds, limits)
        settled, _ = _settle(work, triangles, limits)
        return settled.select(*_KEYS, "tau")


def stripped_levels(
    spark: SparkSession,
    edges: DataFrame,
    min_core: int = 0,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
    work: Workspace | None = None,
) -> DataFrame:
    """The rows of :func:`truss_levels`, from the lowest level up. A named run in ``work`` goes on after a lost driver."""
    with workspace(spark, "levels", work) as work:

        def first() -> tuple[Staged, int]:
            triangles = triangles_in_core(work, spark, edges, min_core, prefilter_rounds, limits)
            return triangles, triangles.rows

        return strip(work, first, 2, rising=True, limits=limits, step="levels").levels(work)


def level_report(levels: DataFrame, size: int | None = None) -> DataFrame:
    """``(tau, edges, total)``: the histogram in ascending order, at most ``size`` levels, each with the number of
    edges of all levels, listed or not. One pass over the levels, whose histogram is small."""
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = levels.groupBy("tau").agg(F.count(F.lit(1)).alias("edges"))
    listed = counted.withColumn("total", F.sum("edges").over(whole)).orderBy("tau")
    return listed if size is None else listed.limit(size)


def level_rounds(
    spark: SparkSession,
    edges: DataFrame,
    min_core: int = 0,
    prefilter_rounds: int | None = None,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(round, changed)``: edges whose level each refinement round lowered, the last with 0."""
    with Workspace(spark, "levels") as work:
        triangles = triangles_in_core(work, spark, edges, min_core, prefilter_rounds, limits)
        _, changes = _settle(work, triangles, limits, exact_steps=True)
    return spark.createDataFrame(
        list(enumerate(changes, start=1)), "round bigint, changed bigint"
    )


def level_histogram(levels: DataFrame, size: int | None = None) -> DataFrame:
    """``(tau, edges)`` in ascending order, at most ``size`` levels."""
    counted = levels.groupBy("tau").agg(F.count(F.lit(1)).alias("edges")).orderBy("tau")
    return counted if size is None else counted.limit(size)


def level_total(levels: DataFrame) -> DataFrame:
    """``(edges)``: edges of all levels, whatever part of them is listed."""
    return levels.agg(F.count(F.lit(1)).alias("edges"))


def settled_below(levels: DataFrame, level: int) -> DataFrame:
    """The edges whose level is below ``level``."""
    return levels.filter(F.col("tau") < level)


def remaining_after(levels: DataFrame, settled: DataFrame) -> DataFrame:
    """The edges that are not among the settled ones."""
    return levels.join(settled, _KEYS, "left_anti")
