"""The registered queries: each operator over a graph derived from whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitgraph.functions import joined_ids
from knitgraph.operators import edges as E
from knitgraph.operators import levels as L
from knitgraph.operators import peeling as P
from knitgraph.operators import triangles as T
from knitgraph.oracles import ORACLES
from knitgraph.plans import Limits, Workspace
from knitgraph.sources import GRAPHS, read_edge_text

Query = Callable[[SparkSession, str], DataFrame]

# With these limits the plans meant for large graphs run on every graph.
LARGE = Limits(broadcast_rows=0, single_task_rows=200, rewrite_rows=1, heavy_keys=100, wedge_ids=5_000)
# Hot lists in ranges of a few thousand rows.
RANGES = Limits(single_task_rows=200, heavy_keys=100, range_rows=20_000)

QUERIES: dict[str, Query] = {}


def _query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


class _Prepared:
    """A staged graph with its degrees and degree order."""

    def __init__(self, spark: SparkSession, folder: str, graph: str):
        self.work = Workspace(spark, graph)
        staged = self.work.save(GRAPHS[graph](spark, folder), "edges")
        self.edges = staged.df
        self.count = staged.rows
        self.degrees = self.work.save(E.vertex_degrees(self.edges), "degrees").df

    def oriented(self, limits: Limits = Limits()) -> DataFrame:
        return E.oriented_edges(self.edges, self.degrees, self.count, limits)

    def lists(self, limits: Limits = Limits()) -> T.NeighborLists:
        return T.neighbor_lists(self.work, self.oriented(limits), self.count, limits)

    def directed_triangles(self, limits: Limits = Limits()) -> DataFrame:
        return T.directed_triangles(self.lists(limits), limits)

    def triangles(self) -> DataFrame:
        return T.triangles_by_id(self.directed_triangles())


# --- sources ---------------------------------------------------------------


def dirty_lines(edges: DataFrame) -> DataFrame:
    """An edge list as a careless text file: comments, leading and trailing
    spaces and third columns, chosen by vertex id."""
    return edges.select(
        F.concat(
            F.when(F.col("src") % 7 == 0, "#").when(F.col("dst") % 13 == 0, " ").otherwise(""),
            F.col("src").cast("string"),
            F.lit("\t"),
            F.col("dst").cast("string"),
            F.when(F.col("dst") % 11 == 0, "\t1").otherwise(""),
            F.when(F.col("src") % 5 == 0, "  ").otherwise(""),
        ).alias("value")
    )


@_query("edge_list_load")
def edge_list_load(spark: SparkSession, folder: str) -> DataFrame:
    path = Workspace(spark, "text").next_path("lines")
    dirty_lines(GRAPHS["users"](spark, folder)).write.text(path)
    return E.canonical_edges(read_edge_text(spark, path))


@_query("edge_list_permissive")
def edge_list_permissive(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the same list whose integers are spoiled are skipped on request."""
    path = Workspace(spark, "text").next_path("lines")
    edges = GRAPHS["users"](spark, folder)
    spoiled = F.when(F.col("src") % 17 == 0, "x").when(F.col("src") % 19 == 0, ".5").otherwise("")
    edges.select(F.concat_ws(" ", "src", F.concat(F.col("dst").cast("string"), spoiled)).alias("value")).write.text(path)
    return E.canonical_edges(read_edge_text(spark, path, permissive=True))


for _name, _graph in GRAPHS.items():
    QUERIES[f"graph_{_name}"] = _graph


@_query("symmetric_edges")
def symmetric_edges(spark: SparkSession, folder: str) -> DataFrame:
    return E.symmetric_edges(GRAPHS["users"](spark, folder))


# --- degrees and orientation -----------------------------------------------


@_query("vertex_degree")
def vertex_degree(spark: SparkSession, folder: str) -> DataFrame:
    return E.vertex_degrees(GRAPHS["shipments"](spark, folder))


@_query("adjacency_lists")
def adjacency_lists(spark: SparkSession, folder: str) -> DataFrame:
    graph = _Prepared(spark, folder, "shipments")
    lists = E.adjacency_lists(graph.edges, graph.degrees, graph.count)
    return lists.withColumn("neighbors", joined_ids("neighbors"))


@_query("adjacency_lists_parts")
def adjacency_lists_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The neighbors of lists that are cut into parts of about 50."""
    graph = _Prepared(spark, folder, "shipments")
    lists = E.adjacency_lists(graph.edges, graph.degrees, graph.count, 50, LARGE)
    return lists.select("vertex", "degree", F.explode("neighbors").alias("neighbor"))


@_query("adjacency_list_ranges")
def adjacency_list_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Lists cut into parts of 50 consecutive neighbors."""
    graph = _Prepared(spark, folder, "shipments")
    lists = E.adjacency_lists(graph.edges, graph.degrees, graph.count, 50, RANGES)
    return lists.withColumn("neighbors", joined_ids("neighbors"))


@_query("oriented_edges")
def oriented_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _Prepared(spark, folder, "shipments").oriented()


@_query("ordered_adjacency")
def ordered_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    graph = _Prepared(spark, folder, "shipments")
    lists = E.ordered_adjacency(graph.oriented(), graph.degrees)
    return lists.withColumn("higher", joined_ids("higher"))


# --- triangles -------------------------------------------------------------


@_query("wedge_candidates")
def wedge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    wedges = T.wedge_candidates(_Prepared(spark, folder, "users").lists())
    return wedges.withColumn("candidates", joined_ids("candidates"))


@_query("triangle_list")
def triangle_list(spark: SparkSession, folder: str) -> DataFrame:
    return _Prepared(spark, folder, "shipments").triangles()


@_query("triangle_list_salted")
def triangle_list_salted(spark: SparkSession, folder: str) -> DataFrame:
    return T.triangles_by_id(_Prepared(spark, folder, "shipments").directed_triangles(LARGE))


@_query("triangle_count")
def triangle_count(spark: SparkSession, folder: str) -> DataFrame:
    found = _Prepared(spark, folder, "shipments").directed_triangles()
    return found.agg(F.count(F.lit(1)).alias("triangles"))


@_query("edge_support")
def edge_support(spark: SparkSession, folder: str) -> DataFrame:
    return T.edge_support(_Prepared(spark, folder, "shipments").triangles())


@_query("triangle_edge_count")
def triangle_edge_count(spark: SparkSession, folder: str) -> DataFrame:
    support = T.edge_support(_Prepared(spark, folder, "customers").triangles())
    return support.agg(F.count(F.lit(1)).alias("edges"))


@_query("triangle_partners")
def triangle_partners(spark: SparkSession, folder: str) -> DataFrame:
    return T.triangle_partners(_Prepared(spark, folder, "users").directed_triangles())


@_query("triangle_partner_lists")
def triangle_partner_lists(spark: SparkSession, folder: str) -> DataFrame:
    graph = _Prepared(spark, folder, "users")
    directed = graph.work.save(graph.directed_triangles(), "triangles")
    return _joined(T.triangle_partner_lists(graph.work, directed.df, directed.rows))


def _joined(lists: DataFrame) -> DataFrame:
    for role in T.ROLES:
        lists = lists.withColumn(role, joined_ids(role))
    return lists


@_query("triangle_partner_ranges")
def triangle_partner_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Third vertices of hubs in parts of 50 consecutive ones."""
    graph = _Prepared(spark, folder, "shipments")
    directed = graph.work.save(graph.directed_triangles(), "triangles")
    return _joined(T.triangle_partner_lists(graph.work, directed.df, directed.rows, 50, RANGES))


@_query("triangle_partner_sizes")
def triangle_partner_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return T.triangle_partner_sizes(_Prepared(spark, folder, "shipments").directed_triangles())


# --- k-core ----------------------------------------------------------------


def _core(graph: str, k: int, max_rounds: int | None = None) -> Query:
    return lambda spark, folder: P.core_subgraph(
        spark, GRAPHS[graph](spark, folder), k, max_rounds
    )


QUERIES["core_subgraph_3"] = _core("customers", 3)
QUERIES["core_subgraph_4"] = _core("customers", 4)
QUERIES["core_subgraph_vanishing"] = _core("customers", 6)
QUERIES["core_subgraph_orders"] = _core("orders", 6)
QUERIES["core_subgraph_events"] = _core("events", 3)
QUERIES["core_subgraph_hubs"] = _core("shipments", 36)
QUERIES["core_subgraph_capped"] = _core("customers", 4, max_rounds=2)
QUERIES["core_subgraph_unpeeled"] = _core("customers", 4, max_rounds=0)


@_query("core_edges")
def core_edges(spark: SparkSession, folder: str) -> DataFrame:
    return P.core_edges(spark, GRAPHS["customers"](spark, folder), 4)


@_query("core_rounds")
def core_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return P.core_rounds(spark, GRAPHS["customers"](spark, folder), 4)


QUERIES["core_subgraph_shuffled"] = lambda spark, folder: P.core_subgraph(
    spark, GRAPHS["customers"](spark, folder), 4, limits=LARGE
)
QUERIES["core_subgraph_hubs_shuffled"] = lambda spark, folder: P.core_subgraph(
    spark, GRAPHS["shipments"](spark, folder), 36, limits=LARGE
)


# --- truss subgraph --------------------------------------------------------


def _truss(graph: str, k: int, prefilter_rounds: int | None = None) -> Query:
    return lambda spark, folder: P.truss_subgraph(
        spark, GRAPHS[graph](spark, folder), k, prefilter_rounds
    )


QUERIES["truss_subgraph_4"] = _truss("shipments", 4)
QUERIES["truss_subgraph_5"] = _truss("shipments", 5)
QUERIES["truss_subgraph_orders"] = _truss("orders", 4)
QUERIES["truss_subgraph_events"] = _truss("events", 4)
QUERIES["truss_subgraph_6"] = _truss("users", 6)
QUERIES["truss_subgraph_vanishing"] = _truss("users", 8)
QUERIES["truss_subgraph_prefiltered"] = _truss("customers", 4)
QUERIES["truss_subgraph_no_prefilter"] = _truss("customers", 4, prefilter_rounds=0)
QUERIES["truss_subgraph_part_prefilter"] = _truss("customers", 4, prefilter_rounds=1)


@_query("truss_edge_count")
def truss_edge_count(spark: SparkSession, folder: str) -> DataFrame:
    return P.truss_edge_count(spark, GRAPHS["users"](spark, folder), 5)


@_query("truss_rounds")
def truss_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return P.truss_rounds(spark, GRAPHS["users"](spark, folder), 6, prefilter_rounds=0)


QUERIES["truss_subgraph_shuffled"] = lambda spark, folder: P.truss_subgraph(
    spark, GRAPHS["users"](spark, folder), 6, limits=LARGE
)


@_query("truss_triangles")
def truss_triangles(spark: SparkSession, folder: str) -> DataFrame:
    return P.truss_triangles(spark, GRAPHS["users"](spark, folder), 5)


@_query("truss_partner_sizes")
def truss_partner_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return P.truss_partner_sizes(spark, GRAPHS["users"](spark, folder), 5)


@_query("truss_partner_lists")
def truss_partner_lists(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(P.truss_partner_lists(spark, GRAPHS["users"](spark, folder), 5))


# On the graphs without a cap on links: truss cells and their third vertices.
QUERIES["truss_triangles_orders"] = lambda spark, folder: P.truss_triangles(
    spark, GRAPHS["orders"](spark, folder), 4
)
QUERIES["truss_partner_sizes_events"] = lambda spark, folder: P.truss_partner_sizes(
    spark, GRAPHS["events"](spark, folder), 4
)
QUERIES["truss_partner_lists_orders"] = lambda spark, folder: _joined(
    P.truss_partner_lists(spark, GRAPHS["orders"](spark, folder), 4, max_thirds=50, limits=RANGES)
)
QUERIES["truss_subgraph_events_shuffled"] = lambda spark, folder: P.truss_subgraph(
    spark, GRAPHS["events"](spark, folder), 4, limits=LARGE
)
QUERIES["core_subgraph_orders_shuffled"] = lambda spark, folder: P.core_subgraph(
    spark, GRAPHS["orders"](spark, folder), 6, limits=LARGE
)


QUERIES["truss_subgraph_stripped"] = lambda spark, folder: P.stripped_truss(
    spark, GRAPHS["orders"](spark, folder), 4
)
QUERIES["truss_subgraph_stripped_shuffled"] = lambda spark, folder: P.stripped_truss(
    spark, GRAPHS["events"](spark, folder), 4, limits=LARGE
)


# --- truss levels ----------------------------------------------------------


def _levels(spark: SparkSession, folder: str, graph: str, min_core: int = 0) -> DataFrame:
    return L.truss_levels(spark, GRAPHS[graph](spark, folder), min_core)


QUERIES["truss_levels"] = lambda spark, folder: _levels(spark, folder, "users")
QUERIES["truss_levels_events"] = lambda spark, folder: _levels(spark, folder, "events")
QUERIES["truss_levels_hubs"] = lambda spark, folder: _levels(spark, folder, "shipments")
QUERIES["truss_levels_in_core"] = lambda spark, folder: _levels(spark, folder, "customers", 4)


QUERIES["truss_levels_shuffled"] = lambda spark, folder: L.truss_levels(
    spark, GRAPHS["users"](spark, folder), limits=LARGE
)


@_query("level_rounds")
def level_rounds(spark: SparkSession, folder: str) -> DataFrame:
    return L.level_rounds(spark, GRAPHS["users"](spark, folder))


QUERIES["truss_levels_stripped"] = lambda spark, folder: L.stripped_levels(
    spark, GRAPHS["shipments"](spark, folder)
)
QUERIES["truss_levels_stripped_shuffled"] = lambda spark, folder: L.stripped_levels(
    spark, GRAPHS["events"](spark, folder), limits=LARGE
)


@_query("truss_level_report")
def truss_level_report(spark: SparkSession, folder: str) -> DataFrame:
    """The two lowest levels and the number of edges of all, from one decomposition."""
    return L.level_report(_levels(spark, folder, "events"), size=2)


QUERIES["level_rounds_events"] = lambda spark, folder: L.level_rounds(
    spark, GRAPHS["events"](spark, folder)
)
QUERIES["truss_levels_orders_shuffled"] = lambda spark, folder: L.truss_levels(
    spark, GRAPHS["orders"](spark, folder), limits=LARGE
)


@_query("level_histogram_per_edge")
def level_histogram_per_edge(spark: SparkSession, folder: str) -> DataFrame:
    """Triangles of each edge by their lowest support: one step's messages."""
    triangles = _Prepared(spark, folder, "users").triangles()
    return L.level_histogram_per_edge(L.attach_levels(triangles, L.support_levels(triangles)))


@_query("level_step")
def level_step(spark: SparkSession, folder: str) -> DataFrame:
    """The first h-index step from the supports."""
    graph = _Prepared(spark, folder, "shipments")
    triangles = graph.work.save(graph.triangles(), "triangles").df
    return L.refine_all(triangles, L.support_levels(triangles))


@_query("truss_level_histogram")
def truss_level_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return L.level_histogram(_levels(spark, folder, "shipments"))


@_query("truss_level_histogram_top")
def truss_level_histogram_top(spark: SparkSession, folder: str) -> DataFrame:
    return L.level_histogram(_levels(spark, folder, "users"), size=2)


@_query("truss_level_total")
def truss_level_total(spark: SparkSession, folder: str) -> DataFrame:
    return L.level_total(_levels(spark, folder, "users"))


@_query("truss_settled_below")
def truss_settled_below(spark: SparkSession, folder: str) -> DataFrame:
    return L.settled_below(_levels(spark, folder, "users"), 3)


@_query("truss_remaining")
def truss_remaining(spark: SparkSession, folder: str) -> DataFrame:
    levels = _levels(spark, folder, "users")
    return L.remaining_after(levels, L.settled_below(levels, 3))


__all__ = ["ORACLES", "QUERIES"]
