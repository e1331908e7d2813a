"""What Python tasks shuffle and stage: few bytes, and the same rows."""

from __future__ import annotations

import random
from dataclasses import replace
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from knitgraph.operators import edges as E
from knitgraph.operators import levels as L
from knitgraph.operators import peeling as P
from knitgraph.operators import refining as R
from knitgraph.operators import triangles as T
from knitgraph.plans import Limits, Workspace
from knitgraph.plans.squeeze import as_bytes, bytes_of, flat, restored, squeezed

SHIFTS = [0, -1_000, 1 << 60]


def shipments(shift=0):
    """Parts link suppliers and days, suppliers link days, and neither are linked among themselves."""
    draw = random.Random(3)
    pairs = [(p, 10_000 + draw.randrange(40)) for p in range(300) for _ in range(6)]
    pairs += [(p, 20_000 + draw.randrange(15)) for p in range(300) for _ in range(6)]
    pairs += [(10_000 + s, 20_000 + d) for s in range(40) for d in range(15) if draw.random() < 0.7]
    return [(a + shift, b + shift) for a, b in pairs]


def lists_of(work, graph, pairs, limits):
    edges = E.canonical_edges(graph(pairs))
    count = len(brute.canonical(pairs))
    return T.neighbor_lists(work, E.oriented_edges(edges, E.vertex_degrees(edges), count, limits), count, limits)


def rows(df):
    return sorted(tuple(row) for row in df.collect())


@pytest.mark.parametrize("values", [[], [7], [-5, 300, -5], [-(1 << 63), (1 << 63) - 1, 0], [1 << 40] * 1_000, list(range(0, 9_000_000, 1_000))])
def test_integers_come_back(values):
    values = np.array(values, np.int64)
    packed = squeezed(values)
    assert restored(packed).tolist() == values.tolist() and restored(packed).dtype == np.int64
    both = pa.array([packed, squeezed(values[:3])], pa.binary())
    assert flat(both).tolist() == [*values.tolist(), *values[:3].tolist()]
    assert flat(pa.chunked_array([both.slice(1)])).tolist() == values[:3].tolist()


def test_integers_take_as_many_bytes_as_they_need():
    draw = np.random.default_rng(1)
    assert len(squeezed(np.full(1_000, -(1 << 60)))) < 60
    assert len(squeezed(draw.integers(0, 200, 1_000) + (1 << 50))) < 1_030
    assert len(squeezed(draw.integers(0, 60_000, 1_000))) < 2_030


def test_rows_of_bytes():
    column = bytes_of(np.array([1, 2, 3, 4, 5], np.int32), np.array([2, 0, 3]))
    assert as_bytes(column, np.int32).tolist() == [1, 2, 3, 4, 5]
    assert as_bytes(column.slice(1), np.int32).tolist() == [3, 4, 5]
    assert as_bytes(pa.chunked_array([column, column.slice(0, 1)]), np.int32).tolist() == [1, 2, 3, 4, 5, 1, 2]


@pytest.mark.parametrize("limits", [Limits(wedge_ids=500), Limits(wedge_ids=60, heavy_keys=50)], ids=["whole", "ranges_and_salts"])
@pytest.mark.parametrize("shift", SHIFTS)
def test_candidates_in_blocks_close_all_triangles(spark, graph, limits, shift):
    pairs = shipments(shift)
    with Workspace(spark, "test") as work:
        lists = lists_of(work, graph, pairs, limits)
        found = T.directed_triangles(lists, limits)
        assert T.grid_side(lists, limits) == 0 and "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
        if limits.wedge_ids == 60:
            assert lists.largest > limits.wedge_ids and T._loads(lists, limits).count()
        assert rows(T.triangles_by_id(found)) == brute.triangles(brute.canonical(pairs))


def test_candidates_that_no_middle_vertex_leads_to_are_not_sent(spark, graph, monkeypatch):
    limits = Limits(wedge_ids=500)
    with Workspace(spark, "test") as work:
        lists = lists_of(work, graph, shipments(), limits)
        # Days are what suppliers lead to; parts lead to suppliers, but nothing leads to parts.
        assert lists.highs.tolist() == list(range(20_000, 20_015))
        table = lists.df.selectExpr("low", "higher.id AS higher").toArrow()
        every = [T._flat_lists(table, "low", "higher"), np.full(table.num_rows, -1), limits.wedge_ids, lists.sinks]
        sent = list(T.expanded_wedges(*every[0], *every[1:], lists.highs))
        whole = list(T.expanded_wedges(*every[0], *every[1:], None))
        count = lambda parts: sum(len(part[3]) for part in parts)
        assert count(whole) == lists.closable and 4 * count(sent) < 3 * count(whole)
        # An id takes two bytes at most, with its share of low, mid and size.
        packed = [T._packed_lists(part[1] % 3, {"low": part[0], "mid": part[1]}, *part[2:]) for part in sent]
        assert sum(batch.nbytes for batch in packed) < 2 * count(sent)
        # No list is needed to say that there are too many to send.
        monkeypatch.setattr(T, "_MAX_SINKS", 10)
        assert lists_of(work, graph, shipments(), limits).highs is None
        assert rows(T.directed_triangles(replace(lists, highs=None), limits)) == rows(T.directed_triangles(lists, limits))


@pytest.mark.parametrize("shift", SHIFTS)
def test_a_step_of_all_levels_in_blocks(spark, graph, shift):
    """The same rows as by joins, also where edges have no level; a triangle is shuffled once a side, and its messages."""
    draw = random.Random(7)
    pairs = [(a + shift, b + shift) for a in range(25) for b in range(a) if draw.random() < 0.5]
    cells = spark.createDataFrame(brute.triangles(brute.canonical(pairs)), "a bigint, b bigint, c bigint")
    supports = L.support_levels(cells)
    blocks = replace(Limits(), hash_join_rows=0, bucket_rows=20)
    for levels in (supports, supports.filter("(src + dst) % 7 != 0"), supports.filter("false")):
        found = L.refine_all(cells, levels, limits=blocks)
        plan = found._jdf.queryExecution().toString()
        assert "FlatMapGroupsInArrow" in plan and "Window" not in plan
        assert found.columns == ["src", "dst", "level"]
        assert rows(found) == rows(L.refine_all(cells, levels))


def test_rounds_of_the_levels_write_levels_only(spark, graph, tmp_path):
    """Third vertices are written once; a round writes a few bytes for each."""
    pairs = brute.cliques(range(60), range(40, 90))
    edges = E.canonical_edges(graph(pairs))
    limits = replace(Limits(), bucket_rows=20_000)
    with Workspace(spark, "test") as work:
        triangles = P.stage_triangles(work, edges, E.vertex_degrees(edges), edges.count(), limits)
        blocks = R.edge_blocks(work, triangles.rows, limits)
        first = R.first_state(work, triangles.df, blocks)
        second = R.next_state(work, first, blocks)
        size = lambda table: sum(f.stat().st_size for f in Path(table.path).rglob("*.parquet"))
        assert first.levels is None and second.fixed is first.fixed and second.rows == first.rows
        assert 2 * size(second) < size(first) and size(second) < 3 * triangles.rows
        sent = R.messages(first.df, blocks, small=True).toArrow()
        assert sent.nbytes < 8 * 6 * triangles.rows


def test_a_closed_run_leaves_no_table_of_a_lost_driver(spark, tmp_path):
    lost = Workspace(spark, "levels", f"lost-{tmp_path.name}")
    lost.save_dealt(spark.range(5).withColumn("block", F.lit(1)), "rows", "block", 2)
    named = {table.name for table in spark.catalog.listTables("default", f"{lost._tag()}_*")}
    assert len(named) == 1
    Workspace(spark, "levels", f"lost-{tmp_path.name}").close()
    assert not named & {table.name for table in spark.catalog.listTables("default", "knitgraph_*")}


@pytest.mark.parametrize("shift", SHIFTS)
def test_partner_lists_are_made_in_blocks(spark, graph, shift):
    """Third vertices are shuffled once, in few bytes, and parts are cut where they are listed."""
    pairs = [(a + shift, b + shift) for a, b in brute.cliques(range(14), range(9, 22), (0, 30, 31))]
    edges = E.canonical_edges(graph(pairs))
    with Workspace(spark, "test") as work:
        lists = T.neighbor_lists(work, E.oriented_edges(edges, E.vertex_degrees(edges), edges.count()), edges.count())
        directed = work.save(T.directed_triangles(lists), "triangles")
        limits = Limits(bucket_rows=50)
        found = T.triangle_partner_lists(work, directed.df, directed.rows, 5, limits)
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        cells = brute.triangles(brute.canonical(pairs))
        support = brute.support(cells)
        thirds = {edge: sorted(v for cell in cells if set(edge) < set(cell) for v in cell if v not in edge) for edge in support}
        got = found.collect()
        assert {(r.src, r.dst): r.support for r in got} == dict(support)
        assert {(r.src, r.dst, r.part): sorted(r.high + r.mid + r.low) for r in got} == {
            (*edge, p // 5): ids[p : p + 5] for edge, ids in thirds.items() for p in range(0, len(ids), 5)
        }
        assert all(r[role] == sorted(r[role]) for r in got for role in T.ROLES)
        # Edges of more third vertices than a task should rank go by ranges, with the same rows.
        ranged = T.triangle_partner_lists(work, directed.df, directed.rows, 5, replace(limits, range_rows=6, single_task_rows=1))
        assert rows(ranged) == rows(found)
