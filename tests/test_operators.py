"""Operators against hand graphs and brute force, in every plan variant."""

from __future__ import annotations

import random
from collections import Counter
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
from knitgraph.operators import stripping as S
from knitgraph.operators import triangles as T
from knitgraph.plans import Limits, Workspace
from knitgraph.plans.ranks import ranked_rows
from knitgraph.plans.skew import heavy_keys, lookup

# Every size-dependent branch is taken on small graphs with these limits.
NO_BROADCAST = Limits(
    broadcast_rows=0, single_task_rows=10, rewrite_rows=1, heavy_keys=5, wedge_ids=20, range_rows=15
)
SMALL_MASK = Limits(
    broadcast_rows=40, single_task_rows=30, rewrite_rows=1, heavy_keys=8, wedge_ids=100, triangle_multiplier=3, range_rows=7
)
# Many keys count as heavy: the cut lies below the thresholds, so heavy elements leave.
LOW_CUT = Limits(broadcast_rows=0, single_task_rows=10, rewrite_rows=1, heavy_keys=100)
LOWEST_CUT = Limits(broadcast_rows=0, single_task_rows=10, rewrite_rows=1, heavy_keys=10_000)
VARIANTS = {"low_cut": LOW_CUT, "lowest_cut": LOWEST_CUT, "default": Limits(), "no_broadcast": NO_BROADCAST, "small_mask": SMALL_MASK}

TWO_K4 = brute.cliques((1, 2, 3, 4), (1, 2, 5, 6))
STAR = [(0, v) for v in range(1, 6)]
PATH = [(v, v + 1) for v in range(5)]


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def expected_edges(counts):
    return sorted((a, b, n) for (a, b), n in counts.items())


def oriented(graph, pairs, limits):
    edges = E.canonical_edges(graph(pairs))
    return E.oriented_edges(edges, E.vertex_degrees(edges), len(brute.canonical(pairs)), limits)


def directed(graph, pairs, limits):
    return T.directed_triangles(lists_of(graph, pairs, limits), limits)


def lists_of(graph, pairs, limits):
    found = oriented(graph, pairs, limits)
    return T.neighbor_lists(Workspace(found.sparkSession, "test"), found, len(brute.canonical(pairs)), limits)


@pytest.fixture(params=list(VARIANTS))
def limits(request):
    return VARIANTS[request.param]


def test_canonical_edges_drop_loops_and_repeats(graph):
    found = E.canonical_edges(graph([(1, 2), (2, 1), (1, 2), (3, 3), (-5, 2)]))
    assert rows(found) == [(-5, 2), (1, 2)]


def test_oriented_edges_order_by_degree_then_id(graph, limits):
    pairs = brute.random_graph(1, 30, 60)
    plain = brute.canonical(pairs)
    degree = {v: len(n) for v, n in brute.neighbors(plain).items()}
    rank = lambda v: (degree[v], v)
    edges = E.canonical_edges(graph(pairs))
    found = E.oriented_edges(edges, E.vertex_degrees(edges), len(plain), limits)
    assert rows(found) == sorted(
        (low, high, degree[low], degree[high])
        for low, high in (sorted(edge, key=rank) for edge in plain)
    )


def test_adjacency_of_hubs_is_cut_at_exact_ranks(graph, limits):
    pairs = brute.random_graph(2, 40, 50)
    plain = brute.canonical(pairs)
    edges = E.canonical_edges(graph(pairs))
    found = E.adjacency_lists(
        edges, E.vertex_degrees(edges), len(plain), max_neighbors=10, limits=limits
    )
    assert rows(found) == sorted(
        (v, p, len(near), sorted(near)[10 * p : 10 * p + 10])
        for v, near in brute.neighbors(plain).items()
        for p in range(-(-len(near) // 10))
    )


def test_ranks_of_a_hub_are_found_by_many_tasks(spark):
    """One key with all rows: its ranges hold a bounded part each, and its ranks are exact."""
    rows_ = spark.range(20_000).selectExpr("1 AS k", "(id * 7919) % 20011 AS v", "'x' AS extra")
    work = Workspace(spark, "test")
    found = ranked_rows(work, rows_, ["k"], ["v"], 20_000, 1_000)
    got = sorted((r.v, r["rank"]) for r in found.collect())
    assert [rank for _, rank in got] == list(range(20_000)) and found.columns == ["k", "v", "extra", "rank"]
    ranges = spark.read.parquet(f"{work.path}/0001-ranges").groupBy("_range").count().collect()
    assert len(ranges) > 15 and max(r["count"] for r in ranges) < 2_500


def test_ordered_adjacency_keeps_vertices_without_higher_neighbors(graph):
    edges = graph(STAR)
    degrees = E.vertex_degrees(edges)
    found = E.ordered_adjacency(E.oriented_edges(edges, degrees, 5), degrees)
    assert rows(found) == [(0, 5, [])] + [(v, 1, [0]) for v in range(1, 6)]


@pytest.mark.parametrize("seed", [3, 4])
def test_triangles_support_and_partners(graph, limits, seed):
    pairs = brute.random_graph(seed, 40, 150)
    cells = brute.triangles(brute.canonical(pairs))
    found = directed(graph, pairs, limits)
    assert rows(T.triangles_by_id(found)) == cells
    support = brute.support(cells)
    assert rows(T.edge_support(T.triangles_by_id(found))) == expected_edges(support)
    partners = T.triangle_partners(found).collect()
    assert Counter((p.src, p.dst) for p in partners) == support
    assert all(p.third not in (p.src, p.dst) for p in partners)
    assert Counter(p.role for p in partners) == {role: len(cells) for role in T.ROLES}


def test_triangles_of_dense_graphs_are_closed_in_a_grid(spark, graph):
    """Lists go to the cells of a grid where that sends less than half of the candidate ids."""
    pairs = [(7 * a - 90, 7 * b - 90) for a, b in brute.random_graph(31, 60, 6_000)]
    limits = Limits(wedge_ids=1_000)
    lists = lists_of(graph, pairs, limits)
    assert T.grid_side(lists, limits) > 1 and lists.edges == len(brute.canonical(pairs))
    plan = T.directed_triangles(lists, limits)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert rows(T.triangles_by_id(T.directed_triangles(lists, limits))) == brute.triangles(brute.canonical(pairs))
    sparse = lists_of(graph, brute.random_graph(32, 300, 600), Limits(wedge_ids=100))
    assert T.grid_side(sparse, Limits(wedge_ids=100)) == 0


def test_cells_close_their_wedges_and_no_others():
    plain = brute.canonical(brute.random_graph(33, 50, 400))
    near = brute.neighbors(plain)
    rank = lambda v: (len(near[v]), v)
    higher = {v: sorted((w for w in near[v] if rank(w) > rank(v)), key=rank) for v in near}

    def lists(of):
        flat = [w for v in of for w in higher[v]]
        return [np.array(part, dtype=np.int64) for part in (list(of), [len(higher[v]) for v in of], flat)]

    found = []
    for row in range(3):
        for column in range(2):
            asked, known = [v for v in near if v % 3 == row], [v for v in near if v % 2 == column]
            for part in T.close_wedges(*lists(asked), *lists(known)):
                cells = list(zip(*[column_.tolist() for column_ in part]))
                assert all(low in asked and mid in known for low, mid, _ in cells)
                found += [tuple(sorted(cell)) for cell in cells]
    assert sorted(found) == brute.triangles(plain)
    assert list(T.close_wedges(*lists([]), *lists(near))) == list(T.close_wedges(*lists(near), *lists([]))) == []


def test_partner_lists_of_hot_edges_are_cut_at_exact_ranks(spark, graph, limits):
    pairs = [(0, 1)] + [(hub, v) for hub in (0, 1) for v in range(2, 60)]
    found = directed(graph, pairs, limits)
    lists = T.triangle_partner_lists(Workspace(spark, "test"), found, 58, max_thirds=10, limits=limits)
    hot = sorted(lists.filter("src = 0 AND dst = 1").collect(), key=lambda r: r.part)
    assert [r.part for r in hot] == list(range(6)) and {r.support for r in hot} == {58}
    assert [sorted(v for role in T.ROLES for v in r[role]) for r in hot] == [
        list(range(2 + 10 * p, min(12 + 10 * p, 60))) for p in range(6)
    ]
    assert lists.filter("NOT (src = 0 AND dst = 1)").agg(F.max("part")).first()[0] == 0


def test_wedges_of_a_large_list_are_dealt_out(spark):
    """A vertex with 5,000 higher neighbors has 12.5 million candidate ids: no task expands more than a few ranges."""
    n, bound = 5_000, 250_000
    degrees = spark.range(1, n + 1).selectExpr("0 AS low", "id AS high", f"{n} AS low_degree", f"{n} + id AS high_degree")
    limits = Limits(wedge_ids=bound)
    lists = T.neighbor_lists(Workspace(spark, "test"), degrees, n * n, limits)
    assert (lists.ids, lists.largest) == (n * (n - 1) // 2, n * (n - 1) // 2)
    wedges = T.wedge_candidates(lists, limits)
    sizes = wedges.select("mid", F.size("candidates").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert {r.mid: r.n for r in sizes} == {mid: n - mid for mid in range(1, n)}
    held = Counter()
    for r in sizes:
        held[r.p] += r.n
    assert len(held) > 20 and max(held.values()) <= 4 * (bound + n)


def test_middle_vertices_are_salted_by_their_candidate_ids(spark, graph):
    """One vertex receives nearly all candidate ids, though its degree is far from the largest."""
    ends = [(v, 10_000) for v in range(1, 400)] + [(v, 10_000 + s) for v in range(1, 400) for s in range(1, 12)]
    top = [(10_000 + s, 20_000 + 500 * s + i) for s in range(12) for i in range(100 + s)]
    limits = Limits(wedge_ids=500, heavy_keys=50)
    lists = lists_of(graph, ends + top, limits)
    loads = {r.mid: r.salts for r in T._loads(lists, limits).collect()}
    assert loads[10_000] >= 399 * 11 // 500
    found = T.directed_triangles(lists, limits)
    assert rows(T.triangles_by_id(found)) == brute.triangles(brute.canonical(ends + top))


@pytest.mark.parametrize("multiplier", [1, 5])
def test_triangle_stage_has_its_own_partitions(spark, graph, multiplier):
    limits = Limits(wedge_ids=20, triangle_multiplier=multiplier)
    lists = lists_of(graph, brute.random_graph(3, 40, 150), limits)
    wanted = -(-lists.ids // 20) * multiplier
    assert T.triangle_partitions(lists.ids, limits) == wanted > 8
    plan = T.directed_triangles(lists, limits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {wanted}), REPARTITION_BY_NUM") >= 2


def test_hubs_without_higher_neighbors_receive_no_candidates(spark, graph):
    """Parts link suppliers and days, suppliers link days, and days are linked with none of each other."""
    pairs = [(p, 1_000 + (p * 7 + i) % 40) for p in range(200) for i in range(4)]
    pairs += [(p, 2_000 + (p * 5 + i) % 12) for p in range(200) for i in range(3)]
    pairs += [(1_000 + s, 2_000 + d) for s in range(40) for d in range(12) if (s + d) % 3]
    limits = Limits(wedge_ids=500)
    lists = lists_of(graph, pairs, limits)
    with_higher = {r.low for r in lists.df.select("low").collect()}
    sent = T._open_wedges(lists, limits, closable=True)
    assert {r.mid for r in sent.filter("size(candidates) > 0").collect()} <= with_higher
    left = sent.agg(F.sum(F.size("candidates"))).first()[0]
    assert 4 * left < 3 * lists.ids
    # The wedges themselves stay whole.
    assert T.wedge_candidates(lists, limits).agg(F.sum(F.size("candidates"))).first()[0] == lists.ids
    assert rows(T.triangles_by_id(T.directed_triangles(lists, limits))) == brute.triangles(brute.canonical(pairs))


def test_partitions_grow_slower_than_the_ids():
    """Map tasks times partitions, of 8 bytes each, stay a small part of the ids, however few ids a task may get."""
    for ids in (10**6, 10**9, 10**12):
        assert T.triangle_partitions(ids, Limits(wedge_ids=5)) ** 2 <= max(200**2, ids // 256)
    assert T.triangle_partitions(10**9) == 250


@pytest.mark.parametrize("name", ["default", "no_broadcast"])
def test_roles_survive_the_peeling(spark, graph, name):
    limits = VARIANTS[name]
    pairs = brute.random_graph(6, 45, 220)
    plain = brute.canonical(pairs)
    left, _ = brute.truss(plain, 5)
    inner, _ = brute.core(plain, 4)
    degree = {v: len(n) for v, n in brute.neighbors([e for e in plain if set(e) <= set(inner)]).items()}
    expected = {}
    for cell in brute.triangles(sorted(left)):
        order = sorted(cell, key=lambda v: (degree[v], v))
        for role, third in zip(("low", "mid", "high"), order):
            edge = tuple(sorted(set(cell) - {third}))
            expected.setdefault(edge, {r: [] for r in T.ROLES})[role].append(third)
    found = P.truss_partner_lists(spark, graph(pairs), 5, limits=limits)
    assert rows(found) == sorted(
        (a, b, 0, left[a, b], *(sorted(by[role]) for role in T.ROLES)) for (a, b), by in expected.items()
    )
    sizes = P.truss_partner_sizes(spark, graph(pairs), 5, limits=limits)
    assert rows(sizes) == sorted((a, b, left[a, b], *(len(by[role]) for role in T.ROLES)) for (a, b), by in expected.items())


def test_no_salt_owns_a_hub(graph):
    """A vertex in a third of all edges: its candidate rows go to many salts."""
    pairs = [(0, v) for v in range(1, 400)] + [(v, v + 1) for v in range(1, 800)]
    limits = Limits(single_task_rows=20, wedge_ids=50)
    assert rows(T.triangles_by_id(directed(graph, pairs, limits))) == [
        (0, v, v + 1) for v in range(1, 399)
    ]


@pytest.mark.parametrize(
    "pairs, k, left, removed",
    [
        (STAR, 2, {}, [5, 1]),
        (PATH, 2, {}, [2, 2, 2]),
        (brute.cliques((1, 2, 3, 4)), 3, dict.fromkeys((1, 2, 3, 4), 3), []),
    ],
)
def test_core_of_hand_graphs(spark, graph, pairs, k, left, removed):
    peeled = P.core_peel(spark, graph(pairs), k)
    assert dict(rows(peeled.survivors("degree"))) == left
    assert peeled.removed == removed


def test_capped_core_keeps_vertices_of_degree_zero(spark, graph):
    assert rows(P.core_subgraph(spark, graph(STAR), 2, max_rounds=1)) == [(0, 0)]
    assert rows(P.core_subgraph(spark, graph(PATH), 2, max_rounds=0)) == [
        (0, 1), (1, 2), (2, 2), (3, 2), (4, 2), (5, 1)
    ]


@pytest.mark.parametrize("k, max_rounds", [(3, None), (4, None), (4, 2), (9, None)])
def test_core_against_brute_force(spark, graph, limits, k, max_rounds):
    pairs = brute.random_graph(5, 80, 90)
    left, removed = brute.core(brute.canonical(pairs), k, max_rounds)
    peeled = P.core_peel(spark, graph(pairs), k, max_rounds, limits)
    assert peeled.removed == removed
    assert dict(rows(peeled.survivors("degree"))) == left
    assert rows(peeled.live_cells()) == [
        (a, b) for a, b in brute.canonical(pairs) if a in left and b in left
    ]


@pytest.mark.parametrize("k", [4, 5, 7])
def test_truss_against_brute_force(spark, graph, limits, k):
    pairs = brute.random_graph(6, 45, 220)
    left, removed = brute.truss(brute.canonical(pairs), k)
    peeled = P.truss_peel(spark, graph(pairs), k, prefilter_rounds=0, limits=limits)
    assert peeled.removed == removed
    assert rows(peeled.survivors("support")) == expected_edges(left)


@pytest.mark.parametrize("heavy", [5, 100, 10_000])
def test_heavy_elements_that_leave_are_removed(spark, graph, heavy):
    """Vertices above the heavy cut but below the threshold take their edges with them."""
    clique = brute.cliques(tuple(range(12)))
    tails = [(100 + i, i % 12) for i in range(15)]
    leaves = [(100 + i, 1000 + 10 * i + j) for i in range(15) for j in range(5)]
    limits = Limits(broadcast_rows=0, single_task_rows=10, rewrite_rows=1, heavy_keys=heavy)
    found = P.core_subgraph(spark, graph(clique + tails + leaves), 10, limits=limits)
    assert rows(found) == [(v, 11) for v in range(12)]


def partition_sizes(df):
    return Counter(r[0] for r in df.select(F.spark_partition_id()).collect())


def test_rows_of_a_hub_are_dealt_out(spark, graph):
    """A star's edges, looked up by their hub, do not meet in one partition."""
    pairs = [(0, v) for v in range(1, 8001)]
    edges = E.canonical_edges(graph(pairs))
    degrees = Workspace(spark, "test").save(E.vertex_degrees(edges), "degrees").df
    limits = Limits(single_task_rows=100, heavy_keys=1000)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for key, value in zip(old, ("-1", "false")):
            spark.conf.set(key, value)
        found = E.attach_degrees(edges, degrees, 8000, limits)
        assert found.filter("src_degree = 8000 AND dst_degree = 1").count() == 8000
        hub_first = lookup(
            edges, degrees, {"src": "vertex"}, {"degree": "d"}, heavy=heavy_keys(degrees, "degree", 16000, limits), limits=limits
        )
        sizes = partition_sizes(hub_first)
        assert sum(sizes.values()) == 8000 and max(sizes.values()) < 3 * 8000 / 8
        plan = hub_first._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_spread" in plan
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_many_patches_are_merged(spark, graph, monkeypatch):
    monkeypatch.setattr(P, "MAX_PATCHES", 2)
    monkeypatch.setattr(L, "MAX_PATCHES", 2)
    pairs = brute.random_graph(2, 80, 700)
    left, removed = brute.truss(brute.canonical(pairs), 6)
    assert len(removed) > 8
    peeled = P.truss_peel(spark, graph(pairs), 6, prefilter_rounds=0)
    assert (rows(peeled.survivors("support")), peeled.removed) == (expected_edges(left), removed)
    assert rows(L.truss_levels(spark, graph(pairs))) == expected_edges(
        brute.levels(brute.canonical(pairs))
    )


@pytest.mark.parametrize("rounds", [0, 1, None])
def test_prefilter_changes_no_truss(spark, graph, rounds):
    pairs = brute.random_graph(7, 40, 100)
    left, _ = brute.truss(brute.canonical(pairs), 5)
    assert rows(P.truss_subgraph(spark, graph(pairs), 5, rounds)) == expected_edges(left)


def test_truss_needs_a_triangle(spark, graph):
    with pytest.raises(ValueError):
        P.truss_subgraph(spark, graph(STAR), 2)


def test_levels_of_two_cliques_that_share_an_edge(spark, graph):
    """The shared edge is in four triangles, but its level is that of the rest."""
    found = rows(L.truss_levels(spark, graph(TWO_K4)))
    assert len(found) == 11 and {tau for _, _, tau in found} == {2}


@pytest.mark.parametrize("seed", [8, 9])
def test_levels_against_brute_force(spark, graph, limits, seed):
    pairs = brute.random_graph(seed, 40, 200)
    tau = brute.levels(brute.canonical(pairs))
    found = L.truss_levels(spark, graph(pairs), limits=limits)
    assert rows(found) == expected_edges(tau)
    histogram = Counter(tau.values())
    assert [tuple(r) for r in L.level_histogram(found).collect()] == sorted(histogram.items())
    assert [tuple(r) for r in L.level_histogram(found, 1).collect()] == sorted(histogram.items())[:1]
    assert rows(L.level_total(found)) == [(len(tau),)]
    whole = [(level, n, len(tau)) for level, n in sorted(histogram.items())]
    assert [tuple(r) for r in L.level_report(found, 1).collect()] == whole[:1]
    assert [tuple(r) for r in L.level_report(found).collect()] == whole
    low = L.settled_below(found, 2)
    high = L.remaining_after(found, low)
    assert rows(low) == [e for e in expected_edges(tau) if e[2] < 2]
    assert rows(high) == [e for e in expected_edges(tau) if e[2] >= 2]


def test_levels_inside_a_core(spark, graph):
    pairs = brute.random_graph(10, 60, 60)
    left, _ = brute.core(brute.canonical(pairs), 4)
    inside = [(a, b) for a, b in brute.canonical(pairs) if a in left and b in left]
    assert rows(L.truss_levels(spark, graph(pairs), min_core=4)) == expected_edges(
        brute.levels(inside)
    )


def test_levels_name_every_truss(spark, graph):
    pairs = brute.random_graph(11, 30, 120)
    found = L.truss_levels(spark, graph(pairs)).persist()
    for k in (4, 5):
        part = rows(P.truss_subgraph(spark, graph(pairs), k).select("src", "dst"))
        assert rows(found.filter(F.col("tau") >= k - 2).select("src", "dst")) == part


@pytest.mark.parametrize("name", ["no_broadcast", "small_mask"])
def test_stripping_against_brute_force(spark, graph, name):
    pairs = brute.random_graph(8, 30, 110)
    plain = brute.canonical(pairs)
    small = replace(VARIANTS[name], bucket_rows=150)
    assert rows(L.stripped_levels(spark, graph(pairs), limits=small)) == expected_edges(brute.levels(plain))
    left, removed = brute.truss(plain, 5)
    work = Workspace(spark, "test")
    cells = work.save(spark.createDataFrame(brute.triangles(plain), "a bigint, b bigint, c bigint").withColumn("order", F.col("a") % 5), "t")
    state = S.strip(work, lambda: S.stage_incidence(work, cells.df, cells.rows, small), 3, limits=small)
    assert state.removed == removed and rows(state.survivors(work, small, "support")) == expected_edges(left)
    assert rows(state.live_triangles(work)) == [(*t, t[0] % 5) for t in brute.triangles(sorted(left))]
    assert rows(P.stripped_truss(spark, graph(pairs), 5, limits=small)) == expected_edges(left)


def test_stripping_of_graphs_without_a_level(spark, graph):
    assert rows(L.stripped_levels(spark, graph(STAR))) == []
    assert rows(P.stripped_truss(spark, graph(TWO_K4), 6)) == []
    assert {r.tau for r in L.stripped_levels(spark, graph(brute.cliques(tuple(range(9))))).collect()} == {7}
    with pytest.raises(ValueError):
        P.stripped_truss(spark, graph(STAR), 2)


def files_read(df):
    """Data files that the scans of a plan read."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numFiles").value())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        for at in range(node.children().length()):
            walk(node.children().apply(at))

    walk(plan)
    return found


def test_late_rounds_read_a_share_of_the_files(spark, graph):
    """A lookup of two edges opens the folders of these two."""
    pairs = brute.random_graph(6, 60, 500)
    cells = brute.triangles(brute.canonical(pairs))
    work = Workspace(spark, "test")
    limits = Limits(bucket_rows=50)
    table = spark.createDataFrame(cells, "a bigint, b bigint, c bigint")
    incidence, buckets = S.stage_incidence(work, table, len(cells), limits)
    assert incidence.rows == 3 * len(cells) and buckets > 20
    two = sorted({t[:2] for t in cells})[:2]
    gone = work.save(S.bucketed(spark.createDataFrame(two, "src bigint, dst bigint"), buckets).withColumn("live", F.lit(1)), "gone")
    hit = incidence.df.join(F.broadcast(gone.df.filter("live < 2").select("bucket", *S.EDGE)), ["bucket", *S.EDGE])
    assert hit.count() == sum(e in two for t in cells for e in ((t[0], t[1]), (t[0], t[2]), (t[1], t[2])))
    opened = [n for n in files_read(hit) if n]
    assert max(opened) <= 4 < buckets
    # Edges of one folder are in one file, in order.
    folder = Path(incidence.path)
    assert all(len(list(f.glob("*.parquet"))) == 1 for f in folder.glob("bucket=*"))


def test_a_stripping_round_writes_a_file_a_block(spark, monkeypatch):
    """However many tasks and folders there are; and no other job looks for the next level."""
    plain = brute.canonical(brute.random_graph(8, 30, 110))
    work = Workspace(spark, "test")
    table = work.save(spark.createDataFrame(brute.triangles(plain), "a bigint, b bigint, c bigint"), "t")
    written, original = [], Workspace._written

    def counted(self, df, name, path, *rest):
        taken = original(self, df, name, path, *rest)
        written.append((name, len(list(Path(path).rglob("*.parquet")))))
        return taken

    monkeypatch.setattr(Workspace, "_written", counted)
    limits = Limits(broadcast_rows=0, single_task_rows=30, rewrite_rows=1, bucket_rows=50)
    state = S.strip(work, lambda: (table, table.rows), 2, rising=True, limits=limits)
    rounds = [files for name, files in written if name == "lists"]
    assert state.blocks.count > 3 and max(rounds) <= state.blocks.count
    assert len(rounds) == len(state.removed) + 1 and all(state.removed)
    assert {name for name, _ in written} == {"lists", "settled"}
    assert rows(state.levels(work)) == expected_edges(brute.levels(plain))


def test_a_block_of_many_triangles_is_several_rows(monkeypatch):
    cells = np.array(brute.triangles(brute.canonical(brute.random_graph(8, 30, 110))))
    a, b, c = cells.T
    sides = {"src": np.r_[a, a, b], "dst": np.r_[b, c, c], "third": np.r_[c, b, a]}
    dealt = pa.table({"block": [3]} | {name: [column] for name, column in sides.items()})
    whole = S._collected(dealt, 4)
    monkeypatch.setattr(S, "_CHUNK", 40)
    parts = S._collected(dealt, 4)
    assert whole.num_rows == 1 < parts.num_rows
    told = pa.table({name: pa.array([], pa.list_(pa.int64())) for name in ("src", "dst", "third")})
    monkeypatch.setattr(S, "_CHUNK", 1 << 26)
    assert S._stepped(parts.take(list(range(parts.num_rows))[::-1]), told, 4, False) == S._stepped(whole, told, 4, False)


def test_stripping_goes_on_after_a_lost_driver(spark, graph, monkeypatch, tmp_path):
    pairs = brute.random_graph(8, 25, 70)
    expected = expected_edges(brute.levels(brute.canonical(pairs)))
    limits = Limits(broadcast_rows=40, single_task_rows=30, rewrite_rows=1, bucket_rows=200)
    lost = 0
    written = Workspace._written
    for writes in (4, 7, 9, 200):
        left = [writes]

        def counted(self, *args):
            left[0] -= 1
            if left[0] < 0:
                raise Lost
            return written(self, *args)

        with monkeypatch.context() as patch:
            patch.setattr(Workspace, "_written", counted)
            work = Workspace(spark, "levels", f"strip-{tmp_path.name}")
            try:
                found = L.stripped_levels(spark, graph(pairs), limits=limits, work=work)
            except Lost:
                lost += 1
    assert lost >= 2 and rows(found) == expected
    work.close()


def test_lowered_levels_lie_between_the_h_index_and_the_level(spark):
    """Falls of every size: never below the h-index, and always lower where that is."""
    rng = random.Random(4)
    cells = [(0, 1, c, rng.choice([3, 900, 5000]), rng.randint(1, 4000), rng.randint(1, 4000)) for c in range(2, 1500)]
    cells = [(a, b, c, 2500, x, y) for a, b, c, _, x, y in cells]
    frame = spark.createDataFrame(cells, "a bigint, b bigint, c bigint, tau_0 bigint, tau_1 bigint, tau_2 bigint")
    exact = dict(((a, b), h) for a, b, h in rows(L.h_index_per_edge(L.level_histogram_per_edge(frame))))
    found = {(a, b): h for a, b, h in rows(L.lower_all(frame))}
    own = {(0, 1): 2500} | {(0, c): x for _, _, c, _, x, _ in cells} | {(1, c): y for _, _, c, _, _, y in cells}
    assert found.keys() == exact.keys()
    for edge, level in found.items():
        assert exact[edge] <= level <= own[edge] and (level < own[edge]) == (exact[edge] < own[edge])


def test_h_index_step(spark):
    values = spark.createDataFrame(
        [(1, 2, 5, 2), (1, 2, 4, 2), (1, 2, 1, 1), (1, 3, 1, 3)],
        "src bigint, dst bigint, value bigint, triangles bigint",
    )
    assert rows(L.h_index_per_edge(values)) == [(1, 2, 4), (1, 3, 1)]


def test_relabelled_vertices_give_the_same_levels(spark, graph):
    pairs = brute.random_graph(12, 30, 100)
    moved = [(1000 - 7 * a, 1000 - 7 * b) for a, b in pairs]
    plain = L.level_histogram(L.truss_levels(spark, graph(pairs)))
    other = L.level_histogram(L.truss_levels(spark, graph(moved).repartition(5)))
    assert rows(plain) == rows(other)


def test_staged_tables_are_dropped_once_superseded(spark, graph):
    work = Workspace(spark, "test")
    table = work.save(graph(PATH), "edges", top=F.max("dst"))
    assert (table.rows, table.measures) == (5, {"top": 5})
    work.drop(table)
    with pytest.raises(Exception):
        table.df.count()


class Lost(Exception):
    """Stands for a driver that is gone."""


def losing(monkeypatch, saves):
    """Workspaces whose driver is lost before a later save."""
    left = [saves]
    save, split = Workspace.save, Workspace.save_split

    def counted(method):
        def run(self, *args, **kwargs):
            left[0] -= 1
            if left[0] < 0:
                raise Lost
            return method(self, *args, **kwargs)

        return run

    monkeypatch.setattr(Workspace, "save", counted(save))
    monkeypatch.setattr(Workspace, "save_split", counted(split))


@pytest.mark.parametrize("name", ["default", "no_broadcast"])
def test_a_named_run_goes_on_after_a_lost_driver(spark, graph, name, monkeypatch, tmp_path):
    limits = VARIANTS[name]
    pairs = brute.random_graph(2, 80, 700)
    left, removed = brute.truss(brute.canonical(pairs), 6)
    assert len(removed) > 8
    run = f"{name}-{tmp_path.name}"
    steps = []
    for saves in (4, 9, 100):
        with monkeypatch.context() as patch:
            losing(patch, saves)
            work = Workspace(spark, "truss", run)
            try:
                peeled = P.truss_peel(spark, graph(pairs), 6, 0, limits, work)
            except Lost:
                noted = work.noted("truss")
                steps.append(len(noted["removed"]) if noted else -1)
    assert steps == sorted(steps) and any(3 <= s < len(removed) for s in steps)
    assert peeled.removed == removed and rows(peeled.survivors("support")) == expected_edges(left)
    # A driver that comes after the end finds the result.
    with monkeypatch.context() as patch:
        losing(patch, 0)
        again = P.truss_peel(spark, graph(pairs), 6, 0, limits, Workspace(spark, "truss", run))
    assert again.removed == removed and rows(again.survivors("support")) == expected_edges(left)
    with pytest.raises(ValueError):
        P.truss_peel(spark, graph(pairs), 7, 0, limits, Workspace(spark, "truss", run))
    work.close()
    assert not Path(work.path).exists()


def test_results_own_their_tables(spark, graph, monkeypatch):
    pairs = brute.random_graph(2, 30, 100)
    with Workspace(spark, "owned") as work:
        found = P.truss_subgraph(spark, graph(pairs), 4, work=work)
        assert rows(found) == expected_edges(brute.truss(brute.canonical(pairs), 4)[0])
        assert Path(work.path).exists()
    assert not Path(work.path).exists()
    root = Path(work.path).parent
    before = set(root.iterdir())
    operators = [
        lambda: P.truss_subgraph(spark, graph(pairs), 4), lambda: P.core_subgraph(spark, graph(pairs), 3),
        lambda: L.truss_levels(spark, graph(pairs)), lambda: P.truss_partner_lists(spark, graph(pairs), 4),
        lambda: P.truss_rounds(spark, graph(pairs), 4),
    ]
    for operator in operators:
        with monkeypatch.context() as patch:
            losing(patch, 1)
            with pytest.raises(Lost):
                operator()
    assert set(root.iterdir()) == before


def refined(work, triangles, limits):
    """The states of the rounds, and the messages sent in each."""
    blocks = R.edge_blocks(work, triangles.rows, limits)
    states, told = [R.first_state(work, triangles.df, blocks)], []
    while states[-1].measures["fell"]:
        sent = R.messages(states[-1].df, blocks)
        told.append(sent.select(F.sum(F.size("src"))).first()[0] or 0)
        states.append(R.next_state(work, states[-1], blocks))
    return blocks, states, told


@pytest.mark.parametrize("limits", [Limits(), replace(Limits(), bucket_rows=20)], ids=["one_block", "many_blocks"])
@pytest.mark.parametrize("shift", [0, -40, 1 << 60])
def test_levels_by_messages_in_blocks(spark, graph, limits, shift):
    draw = random.Random(5)
    pairs = [(a + shift, b + shift) for a in range(30) for b in range(a) if draw.random() < 0.45]
    edges = E.canonical_edges(graph(pairs))
    with Workspace(spark, "test") as work:
        triangles = P.stage_triangles(work, edges, E.vertex_degrees(edges), len(pairs), limits)
        blocks, states, told = refined(work, triangles, limits)
        assert (blocks.count > 10) == (limits.bucket_rows == 20)
        assert rows(states[-1].df.select("src", "dst", "tau")) == expected_edges(brute.levels(brute.canonical(pairs)))
        # Each round is the h-index of all edges; the first tells all of every triangle, the others what fell.
        stepped = L.refine_all(triangles.df, states[1].df.select("src", "dst", "tau"))
        assert rows(stepped) == rows(states[2].df.select("src", "dst", "tau"))
        assert told[0] == 6 * triangles.rows
        assert sum(told[1:]) < 2 * triangles.rows * len(told[1:])


def test_a_round_of_the_levels_shuffles_messages_only(spark, graph):
    limits = replace(Limits(), bucket_rows=20)
    edges = E.canonical_edges(graph(brute.cliques(range(12), range(8, 20))))
    with Workspace(spark, "test") as work:
        triangles = P.stage_triangles(work, edges, E.vertex_degrees(edges), edges.count(), limits)
        blocks = R.edge_blocks(work, triangles.rows, limits)
        state = R.first_state(work, triangles.df, blocks)
        step = R.stepped(state.df, blocks)
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
        # A partition gets one block.
        held = step.groupBy(F.spark_partition_id().alias("part")).agg(F.count_distinct("block").alias("n"))
        assert {row.n for row in held.collect()} == {1}
        # Work ends with its tables: none stays in the catalog.
        assert spark.catalog.listTables("default", "knitgraph_*")
    assert not spark.catalog.listTables("default", "knitgraph_*")
