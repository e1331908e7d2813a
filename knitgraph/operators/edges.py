"""Edges, degrees, adjacency and the degree order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.functions import edge_heads_up, larger_id, smaller_id
from knitgraph.plans.ranks import ranked_rows
from knitgraph.plans.skew import DEFAULT_LIMITS, Limits, heavy_keys, lookup
from knitgraph.plans.workspace import Workspace


def canonical_edges(pairs: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Undirected edges, each once with ``src < dst``; self-loops dropped.

    Repeats are collapsed before the shuffle by the partial aggregation.
    """
    return (
        pairs.filter(F.col(src) != F.col(dst))
        .select(smaller_id(src, dst).alias("src"), larger_id(src, dst).alias("dst"))
        .distinct()
    )


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, in one pass over the edges."""
    forward = F.struct(F.col("src"), F.col("dst"))
    backward = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select(F.inline(F.array(forward, backward)))


def vertex_degrees(edges: DataFrame) -> DataFrame:
    """``(vertex, degree)``; a hub is counted map-side first. A vertex without
    edges has no row."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("vertex"))
        .groupBy("vertex")
        .agg(F.count(F.lit(1)).alias("degree"))
    )


def attach_degrees(
    edges: DataFrame,
    degrees: DataFrame,
    edge_count: int,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Edges with the degrees of both ends, safe for hubs."""
    heavy = heavy_keys(degrees, "degree", 2 * edge_count, limits)
    for end in ("src", "dst"):
        edges = lookup(
            edges,
            degrees,
            {end: "vertex"},
            {"degree": f"{end}_degree"},
            how="inner",
            heavy=heavy,
            limits=limits,
        )
    return edges


def oriented_edges(
    edges: DataFrame,
    degrees: DataFrame,
    edge_count: int,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Each edge directed from its lower to its higher end by (degree, id).

    A vertex then has at most sqrt(2 * edges) outgoing edges, however large its
    degree: each of its targets has at least as many edges as it has itself.
    """
    known = attach_degrees(edges, degrees, edge_count, limits)
    up = edge_heads_up("src", "src_degree", "dst", "dst_degree")

    def pick(if_up: str, otherwise: str, name: str):
        return F.when(up, F.col(if_up)).otherwise(F.col(otherwise)).alias(name)

    return known.select(
        pick("src", "dst", "low"),
        pick("dst", "src", "high"),
        pick("src_degree", "dst_degree", "low_degree"),
        pick("dst_degree", "src_degree", "high_degree"),
    )


def higher_neighbors(oriented: DataFrame) -> DataFrame:
    """Per vertex its higher neighbors as ``(degree, id)`` structs in order.

    The arrays are bounded by the square root of twice the edge count. The
    filter removes nothing: joins would add it to some uses of these lists only,
    and Spark shuffles the lists once just if all uses have equal plans.
    """
    return oriented.filter("low IS NOT NULL").groupBy("low", "low_degree").agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("high_degree").alias("degree"), F.col("high").alias("id")))
        ).alias("higher")
    )


def ordered_adjacency(oriented: DataFrame, degrees: DataFrame) -> DataFrame:
    """``(vertex, degree, higher)`` with higher neighbors by (degree, id);
    vertices that have none keep a row with an empty array."""
    lists = higher_neighbors(oriented).select(
        F.col("low").alias("vertex"), F.col("higher.id").alias("higher")
    )
    return degrees.join(lists, "vertex", "left").select(
        "vertex",
        "degree",
        F.coalesce("higher", F.array().cast("array<bigint>")).alias("higher"),
    )


def adjacency_lists(
    edges: DataFrame,
    degrees: DataFrame,
    edge_count: int,
    max_neighbors: int = 100_000,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(vertex, part, degree, neighbors)`` with neighbors sorted by id.

    A vertex of degree up to ``max_neighbors`` has the one part 0. The neighbors of a larger hub, which would
    not fit into one row or one task, are ranked by id: part p holds those of ranks p * max_neighbors to
    (p + 1) * max_neighbors - 1.
    """
    both = symmetric_edges(edges)
    heavy = heavy_keys(degrees, "degree", 2 * edge_count, limits)
    known = lookup(
        both,
        degrees,
        {"src": "vertex"},
        {"degree": "degree"},
        how="inner",
        heavy=heavy,
        limits=limits,
    ).select(F.col("src").alias("vertex"), "degree", "dst")
    is_hub = F.col("degree") > max_neighbors
    parts = known.filter(~is_hub).withColumn("part", F.lit(0).cast("long"))
    # A degree is at most the number of edges: a small graph has no hub.
    hub_rows = degrees.filter(is_hub).agg(F.sum("degree")).first()[0] if edge_count > max_neighbors else None
    if hub_rows:
        work = Workspace(edges.sparkSession, "lists")
        ranked = ranked_rows(work, known.filter(is_hub), ["vertex"], ["dst"], hub_rows, limits.range_rows)
        parts = parts.unionByName(ranked.select("vertex", "degree", "dst", F.expr(f"rank div {max_neighbors}").alias("part")))
    return parts.groupBy("vertex", "part", "degree").agg(
        F.sort_array(F.collect_list("dst")).alias("neighbors")
    )
