"""Rounds of h-index steps over the third vertices of every edge, which learn of lower levels by messages.

A row of the state is an edge: its level ``tau``, the third vertices of its triangles in ascending order and, in the same
order, ``lows``: the lower level of the other two edges of each triangle, as far as they have told. An edge whose
level fell tells it to the other two edges of those triangles in which it is now the lowest; in the others nothing changed for
them. So a triangle is sent when its lowest level falls, and an edge that gets no message keeps its level.

Edges are dealt to blocks by hash, and the state is two tables in buckets by block, with a row a block: the edges with their third
vertices, written once, and their levels and lows, which each round writes anew. A round shuffles the messages, not the
state. A task holds the third vertices of its block's edges, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitgraph.plans.ship import ship
from knitgraph.plans.skew import DEFAULT_LIMITS, Limits
from knitgraph.plans.squeeze import as_bytes, bytes_of, flat, squeezed
from knitgraph.plans.workspace import Staged, Workspace

#: Third vertices of a block, as a multiple of ``Limits.bucket_rows``, and the fewest that are worth a block of their own.
_BLOCK_FACTOR = 2
_LEAST_BLOCK = 20_000
_MAX_BLOCKS = 1 << 14
#: Rows that are packed at a time.
_PACK = 1 << 20
#: The level of edges that have told nothing.
_UNKNOWN = np.iinfo(np.int32).max

_FIXED = "block int, edges bigint, reach bigint, src array<bigint>, dst array<bigint>, support array<bigint>, thirds array<binary>"
_LEVELS = "block int, fallen bigint, reach bigint, tau array<bigint>, fell array<boolean>, lows array<binary>"


@dataclass(frozen=True)
class State(Staged):
    """Edges with their levels, as rows ``(block, src, dst, tau, support, fell, thirds, lows)`` of two tables."""

    fixed: Staged  # what stays: edges and their third vertices
    levels: Staged | None  # their levels; None at first, when they are the supports


@dataclass(frozen=True)
class Blocks:
    """The numbers of the blocks: as many as partitions, each of which gets one of them."""

    labels: np.ndarray

    @property
    def count(self) -> int:
        return len(self.labels)

    def of(self, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """The place of an edge's block among the labels."""
        mixed = src.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed = (mixed + dst.view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ mixed >> np.uint64(29)) >> np.uint64(20)) % np.uint64(self.count)


def edge_blocks(work: Workspace, triangles: int, limits: Limits = DEFAULT_LIMITS) -> Blocks:
    return numbered_blocks(work.spark, triangles, limits)


def numbered_blocks(spark: SparkSession, triangles: int, limits: Limits = DEFAULT_LIMITS) -> Blocks:
    thirds = 3 * triangles
    few = min(2 * spark.sparkContext.defaultParallelism, thirds // _LEAST_BLOCK)
    count = min(_MAX_BLOCKS, max(1, few, -(-thirds // (_BLOCK_FACTOR * limits.bucket_rows))))
    tried, labels = 0, []
    while len(labels) < count:
        tried += 16 * count
        numbers = spark.range(tried).select(F.col("id").cast("int").alias("label"))
        dealt = numbers.groupBy(F.expr(f"pmod(hash(label), {count})")).agg(F.min("label").alias("label"))
        labels = sorted(row.label for row in dealt.collect())
    return Blocks(np.array(labels, np.int32))


def _state(fixed: Staged, levels: Staged | None) -> State:
    if levels is None:
        edges = fixed.df.selectExpr("block", "inline(arrays_zip(src, dst, support, thirds))")
        rows = edges.selectExpr("block", "src", "dst", "support AS tau", "support", "true AS fell", "thirds", "cast(NULL AS binary) AS lows")
        edge_count = fixed.measures["edges"]
        return State(rows, fixed.path, edge_count, {"fell": edge_count, "reach": fixed.measures["reach"]}, fixed, None)
    # Both tables have a row a block, and are in buckets by it.
    both = fixed.df.drop("reach").join(levels.df.drop("reach").hint("merge"), "block")
    rows = both.selectExpr("block", "inline(arrays_zip(src, dst, tau, support, fell, thirds, lows))")
    return State(rows, levels.path, fixed.measures["edges"], levels.measures, fixed, levels)


def dealt_sides(triangles: DataFrame, blocks: Blocks) -> DataFrame:
    """The third vertices of every edge by block. A row holds many of them."""

    def sides(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        a, b, c = (batch.column(name).to_numpy() for name in "abc")
        return {"src": np.concatenate([a, a, b]), "dst": np.concatenate([b, c, c]), "third": np.concatenate([c, b, a])}

    schema = "block int, src binary, dst binary, third binary"
    rows = triangles.select("a", "b", "c").mapInArrow(lambda batches: packed_by_block(map(sides, batches), blocks, True), schema)
    return rows.repartition(blocks.count, "block")


def first_state(work: Workspace, triangles: DataFrame, blocks: Blocks) -> State:
    """Every edge at its support, none of which is told yet."""
    ship(work.spark)
    rows = dealt_sides(triangles, blocks).groupBy("block").applyInArrow(_collected, _FIXED)
    return _state(work.save_dealt(rows, "thirds", "block", blocks.count, edges=F.sum("edges"), reach=F.sum("reach")), None)


def messages(state: DataFrame, blocks: Blocks, small: bool = False) -> DataFrame:
    """What edges that fell tell to the other two of their triangles: their level, by edge and third vertex. A
    row holds many messages to a block, squeezed if ``small``."""

    def tell(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        src, dst, tau, sizes = (batch.column(name).to_numpy() for name in ("src", "dst", "tau", "support"))
        third, lows = as_bytes(batch.column("thirds"), np.int64), _lows(batch.column("lows"), sizes)
        told = np.flatnonzero(lows > np.repeat(tau, sizes))
        third, edge = third[told], np.repeat(np.arange(len(src)), sizes)[told]
        src, dst, low = src[edge], dst[edge], tau[edge].astype(np.int32)
        return {
            "src": np.concatenate([np.minimum(src, third), np.minimum(dst, third)]),
            "dst": np.concatenate([np.maximum(src, third), np.maximum(dst, third)]),
            "third": np.concatenate([dst, src]), "low": np.concatenate([low, low]),
        }

    kinds = ["binary"] * 4 if small else ["array<bigint>"] * 3 + ["array<int>"]
    schema = f"block int, src {kinds[0]}, dst {kinds[1]}, third {kinds[2]}, low {kinds[3]}"
    fell = state.filter("fell").select("src", "dst", "tau", "support", "thirds", "lows")
    return fell.mapInArrow(lambda batches: packed_by_block(map(tell, batches), blocks, small), schema)


def next_state(work: Workspace, state: State, blocks: Blocks) -> State:
    """The state after one h-index step of every edge."""
    ship(work.spark)
    sums = {"fell": F.sum("fallen"), "reach": F.sum("reach")}
    return _state(state.fixed, work.save_dealt(stepped(state.df, blocks), "levels", "block", blocks.count, **sums))


def stepped(state: DataFrame, blocks: Blocks) -> DataFrame:
    """The levels after one h-index step, a row a block."""
    told = messages(state, blocks, small=True).groupBy("block")
    return state.groupBy("block").cogroup(told).applyInArrow(_stepped, _LEVELS)


_SENT = pa.schema([("block", pa.int32())] + [(name, pa.binary()) for name in ("src", "dst", "third", "low")])


def step_all(triangles: DataFrame, levels: DataFrame, blocks: Blocks) -> DataFrame:
    """``(src, dst, level)``: one h-index step of every edge from any levels ``(src, dst, tau)``. Triangles count if all of their edges
    have a level."""
    ship(triangles.sparkSession)

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {name: batch.column(at).to_numpy() for at, name in enumerate(("src", "dst", "low"))}

    def tell(sides: pa.Table, known: pa.Table) -> pa.Table:
        parts = iter([_told_levels(sides, known)] if sides.num_rows and known.num_rows else [])
        return pa.Table.from_batches(list(packed_by_block(parts, blocks, True)), _SENT)

    rows = levels.selectExpr("src", "dst", "cast(tau AS bigint) AS tau")
    dealt = rows.mapInArrow(lambda batches: packed_by_block(map(columns, batches), blocks, True), "block int, src binary, dst binary, low binary")
    known = dealt.repartition(blocks.count, "block").groupBy("block")
    wire = "block int, src binary, dst binary, third binary, low binary"
    told = dealt_sides(triangles, blocks).groupBy("block").cogroup(known).applyInArrow(tell, wire)
    return told.repartition(blocks.count, "block").groupBy("block").applyInArrow(_h_of_told, "src bigint, dst bigint, level bigint")


def _told_levels(sides: pa.Table, known: pa.Table) -> dict[str, np.ndarray]:
    """What the edges of a block with a level tell: their level, to the other edges of their triangles, and to themselves with
    their own end as the third vertex."""
    src, dst, sizes, third = edge_lists(sides)
    at_src, at_dst, level = (flat(known.column(name)) for name in ("src", "dst", "low"))
    order = np.lexsort((at_dst, at_src))
    at_src, at_dst, level = at_src[order], at_dst[order], level[order]
    first, last = np.searchsorted(at_src, src, "left"), np.searchsorted(at_src, src, "right")
    at = np.minimum(_bisected(at_dst, first, last, dst), len(level) - 1)
    there = (at_src[at] == src) & (at_dst[at] == dst)
    third, sizes = third[np.repeat(there, sizes)], sizes[there]
    src, dst, level = src[there], dst[there], level[at[there]]
    one, other, low = np.repeat(src, sizes), np.repeat(dst, sizes), np.repeat(level, sizes)
    return {
        "src": np.concatenate([np.minimum(one, third), np.minimum(other, third), src]),
        "dst": np.concatenate([np.maximum(one, third), np.maximum(other, third), dst]),
        "third": np.concatenate([other, one, src]), "low": np.concatenate([low, low, level]),
    }


def _h_of_told(rows: pa.Table) -> pa.Table:
    src, dst, third, low = (flat(rows.column(name)) for name in ("src", "dst", "third", "low"))
    order = np.lexsort((third, dst, src))
    src, dst, third, low = src[order], dst[order], third[order], low[order]
    starts = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
    edge = np.cumsum(starts) - 1
    own = third == src
    cap = np.full(edge[-1] + 1, -1, np.int64)
    cap[edge[own]] = low[own]
    # A triangle counts if both of the other edges have told.
    pair = np.flatnonzero(~own[1:] & ~starts[1:] & (third[1:] == third[:-1]) & (cap[edge[1:]] >= 0))
    sizes = np.bincount(edge[pair], minlength=len(cap))
    asked = np.flatnonzero(sizes)
    level = h_indices(np.minimum(low[pair], low[pair + 1]), sizes[asked], cap[asked])
    first = np.flatnonzero(starts)[asked]
    return pa.table({"src": src[first], "dst": dst[first], "level": level})


def packed_by_block(parts: Iterator[dict[str, np.ndarray]], blocks: Blocks, small: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows as one array a column and block, for many parts at a time; with ``small`` squeezed, and in the order of ``src``."""
    held: list[dict[str, np.ndarray]] = []

    def packed() -> pa.RecordBatch:
        columns = {name: np.concatenate([part[name] for part in held]) for name in held[0]}
        block = blocks.of(columns["src"], columns["dst"]).astype(np.int16)
        order = np.lexsort((columns["src"], block)) if small else np.argsort(block, kind="stable")
        sizes = np.bincount(block, minlength=blocks.count)
        there = np.flatnonzero(sizes)
        ends = np.r_[0, np.cumsum(sizes[there])]
        if small:
            cut = {name: np.split(column[order], ends[1:-1]) for name, column in columns.items()}
            arrays = {name: pa.array([squeezed(part) for part in cut[name]], pa.binary()) for name in columns}
        else:
            arrays = {name: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(column[order])) for name, column in columns.items()}
        return pa.RecordBatch.from_pydict({"block": pa.array(blocks.labels[there])} | arrays)

    for part in parts:
        held.append(part)
        if sum(len(part["src"]) for part in held) >= _PACK:
            yield packed()
            held = []
    if sum(len(part["src"]) for part in held):
        yield packed()


def edge_lists(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edges of a block in order, the number of their third vertices, and these in order."""
    src, dst, third = (flat(rows.column(name), np.int64) for name in ("src", "dst", "third"))
    order = np.lexsort((third, dst, src))
    src, dst, third = src[order], dst[order], third[order]
    first = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
    return src[first], dst[first], np.diff(np.r_[first, len(src)]), third


def _collected(rows: pa.Table) -> pa.Table:
    src, dst, sizes, third = edge_lists(rows)
    return _row(
        block=rows.column("block")[0].as_py(), edges=len(src), reach=len(third),
        src=pa.array(src), dst=pa.array(dst), support=pa.array(sizes.astype(np.int64)), thirds=bytes_of(third, sizes),
    )


def _row(block: int, **columns) -> pa.Table:
    """One row: numbers, and arrays as lists."""

    def value(column) -> pa.Array:
        if isinstance(column, pa.Array):
            return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        return pa.array([column], pa.int64())

    return pa.table({"block": pa.array([block], pa.int32())} | {name: value(column) for name, column in columns.items()})


def _lows(column: pa.Array | pa.ChunkedArray, sizes: np.ndarray) -> np.ndarray:
    """The lower levels that edges were told; null for nothing."""
    return np.full(sizes.sum(), _UNKNOWN, np.int32) if column.null_count else as_bytes(column, np.int32)


def in_order(state: pa.Table) -> pa.Table:
    """The edges of a block in ascending order."""
    src, dst = state.column("src").to_numpy(), state.column("dst").to_numpy()
    if len(src) > 1 and not np.all((src[1:] > src[:-1]) | ((src[1:] == src[:-1]) & (dst[1:] > dst[:-1]))):
        state = state.take(pa.array(np.lexsort((dst, src))))
    return state


def _stepped(state: pa.Table, told: pa.Table) -> pa.Table:
    state = in_order(state)
    src, dst = state.column("src").to_numpy(), state.column("dst").to_numpy()
    tau, sizes = state.column("tau").to_numpy(), state.column("support").to_numpy()
    thirds, lows = as_bytes(state.column("thirds"), np.int64), _lows(state.column("lows"), sizes)
    fell = state.column("fell").to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    # Edges that fell have told it, and are lowest in those triangles.
    lows = np.minimum(lows, np.repeat(np.where(fell, tau, _UNKNOWN), sizes).astype(np.int32))
    level = tau.copy()
    if told.num_rows:
        edge, row = places(src, dst, starts, sizes, thirds, *(flat(told.column(name), np.int64) for name in ("src", "dst", "third")))
        low = flat(told.column("low"), np.int32)
        np.minimum.at(lows, row, low)
        reached = np.zeros(len(src), bool)
        reached[edge[low < tau[edge]]] = True
        asked = np.flatnonzero(reached)
        level[asked] = h_indices(lows[np.repeat(reached, sizes)], sizes[asked], tau[asked])
    falls = level < tau
    return _row(
        block=state.column("block")[0].as_py(), fallen=int(falls.sum()), reach=int(sizes[falls].sum()),
        tau=pa.array(level), fell=pa.array(falls), lows=bytes_of(lows, sizes),
    )


def h_indices(lows: np.ndarray, sizes: np.ndarray, at_most: np.ndarray) -> np.ndarray:
    """Of each of some lists, one after the other, the largest h, up to a limit, that h of its values reach."""
    if not len(lows):
        return np.zeros(len(sizes), np.int64)
    lists = np.repeat(np.arange(len(sizes)), sizes)
    capped = np.minimum(lows, np.repeat(at_most, sizes)).astype(np.int64)
    width = np.int64(capped.max() + 1)
    keys = lists * width + (width - 1 - capped)
    keys.sort()
    falling = width - 1 - keys % width
    rank = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.bincount(lists, falling > rank, len(sizes)).astype(np.int64)


def places(src, dst, starts, sizes, thirds, to_src, to_dst, to_third) -> tuple[np.ndarray, np.ndarray]:
    """The edge, and the place of the third vertex among all, of each message."""
    among = np.searchsorted(src, to_src, "left"), np.searchsorted(src, to_src, "right")
    edge = _bisected(dst, *among, to_dst)
    return edge, _bisected(thirds, starts[edge], starts[edge] + sizes[edge], to_third)


def _bisected(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value, which is there, in its own sorted range of ``values``."""
    while np.any(open_ := high - low > 1):
        middle = (low + high) // 2
        right = open_ & (values[middle * open_] <= wanted)
        low, high = np.where(right, middle, low), np.where(open_ & ~right, middle, high)
    return low
