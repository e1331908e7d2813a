"""Triangle listing, edge support and the third vertices of every edge."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitgraph.functions import larger_id, middle_id, smaller_id
from knitgraph.operators.edges import higher_neighbors
from knitgraph.operators.refining import numbered_blocks, packed_by_block
from knitgraph.plans.ranks import ranked_rows
from knitgraph.plans.ship import ship
from knitgraph.plans.skew import DEFAULT_LIMITS, Limits, heavy_keys, lookup
from knitgraph.plans.squeeze import flat, squeezed
from knitgraph.plans.workspace import Staged, Workspace

_SIZE = "cast(size(higher) as bigint)"
#: Candidate ids of a vertex: its i-th higher neighbor is followed by size - i - 1 others.
_IDS = f"{_SIZE} * ({_SIZE} - 1) div 2"
#: Candidate ids before those of the neighbor at `place`.
_IDS_BEFORE = f"place * (2 * {_SIZE} - place - 1) div 2"

#: So many partitions are cheap, however few ids there are.
_FEW_PARTITIONS = 200
#: Middle vertices without higher neighbors, and vertices that may be high, that are sent to every task at most.
_MAX_SINKS = 100_000
#: With more middle vertices than that, those that may be high are not looked for.
_MAX_MIDDLES = 1_000_000
#: Candidate ids of a grid cell over those that a task of the wedge stage intersects: they are not shuffled.
_CELL_FACTOR = 4
#: Candidate ids that a grid cell holds at a time.
_CHUNK_IDS = 1 << 20
#: Candidate ids that a task packs, and compares, at a time.
_PACK_IDS = 1 << 22


@dataclass(frozen=True)
class NeighborLists:
    """The higher neighbors of every vertex, and, where they are a table, its measures."""

    df: DataFrame
    table: Staged | None
    ids: int  # candidate ids of all lists
    largest: int  # candidate ids of one list at most
    sinks: np.ndarray | None = None  # middle vertices without higher neighbors, which close no candidate
    sunk: int = 0  # candidate ids for them
    highs: np.ndarray | None = None  # the higher neighbors of middle vertices: no other vertex closes a candidate
    edges: int = 0  # ids of all lists

    @property
    def closable(self) -> int:
        """Candidate ids without those for the known sinks."""
        return self.ids - self.sunk


def neighbor_lists(
    work: Workspace, oriented: DataFrame, edge_count: int, limits: Limits = DEFAULT_LIMITS
) -> NeighborLists:
    """The higher neighbors of every vertex, as a table with its measures unless the graph is small.

    A list of n neighbors has n (n - 1) / 2 candidate ids. As the ends of its edges have no fewer edges than its vertex, that is
    at most the number of edges, and the vertices above a middle vertex of degree d are at most 2 m / d, so it
    receives at most 2 m ids: with so few edges no task can get too many.
    """
    lists = higher_neighbors(oriented)
    if 2 * edge_count <= limits.wedge_ids and limits.triangle_multiplier == 1:
        return NeighborLists(lists, None, 2 * edge_count, edge_count)
    table = work.save(
        lists, "higher", ids=F.expr(f"sum({_IDS})"), largest=F.expr(f"max({_IDS})"), edges=F.expr(f"sum({_SIZE})")
    )
    ids = table.measures["ids"]
    received = _received(table.df).join(table.df.select(F.col("low").alias("mid"), F.lit(True).alias("closes")), "mid", "left").persist()
    sinks = received.filter(f"closes IS NULL AND ids > {ids // _MAX_SINKS}").toArrow()
    highs = _highs(table.df, received.filter("closes").select(F.col("mid").alias("low")))
    received.unpersist()
    known = np.sort(sinks.column("mid").to_numpy())
    sunk = int(sinks.column("ids").to_numpy().sum())
    return NeighborLists(table.df, table, ids, table.measures["largest"], known, sunk, highs, table.measures["edges"])


def _received(lists: DataFrame) -> DataFrame:
    """``(mid, ids)``: the candidate ids that each middle vertex receives.

    Of those without higher neighbors, fewer than ``_MAX_SINKS`` can each have more than that share of all ids, so these may be
    sent to every task. Hubs that are not linked with each other are such vertices, and may receive most of the ids.
    """
    placed = lists.select(F.size("higher").cast("long").alias("n"), F.posexplode("higher").alias("place", "mid"))
    return placed.groupBy(F.col("mid.id").alias("mid")).agg(F.sum(F.expr("n - place - 1")).alias("ids"))


def _highs(lists: DataFrame, middles: DataFrame) -> np.ndarray | None:
    """The higher neighbors of middle vertices, unless either are many."""
    if middles.count() > _MAX_MIDDLES:
        return None
    found = lists.join(F.broadcast(middles), "low", "left_semi").select(F.explode("higher.id").alias("high")).distinct()
    ids = found.limit(_MAX_SINKS + 1).toArrow().column("high").to_numpy()
    return np.sort(ids) if len(ids) <= _MAX_SINKS else None


def triangle_partitions(ids: int, limits: Limits = DEFAULT_LIMITS) -> int:
    """Partitions of the triangle stage for so many candidate ids, times the factor asked for.

    Each map task keeps an index entry of 8 bytes per partition, and there may be as many of them as
    partitions: at 1/16 of the square root of the ids the entries take 1/256 of the room of the ids. The ids of a
    partition are read as a stream, so more than ``limits.wedge_ids`` of them cost time only.
    """
    needed = min(-(-ids // limits.wedge_ids), max(_FEW_PARTITIONS, isqrt(ids) // 16))
    return max(1, needed) * limits.triangle_multiplier


def _open_wedges(lists: NeighborLists, limits: Limits, closable: bool = False) -> DataFrame:
    """``(low, mid, candidates)``: per edge low-mid the structs that follow ``mid`` in the list of ``low``. With
    ``closable`` the known middle vertices without higher neighbors are left out.

    A vertex with n higher neighbors has n (n - 1) / 2 candidate ids. One that has more than
    ``limits.wedge_ids`` is expanded in ranges of its places that hold about so many ids each (less than one
    list more), and the ranges are dealt out: a range carries its list once.
    """

    def expanded(rows: DataFrame, within: str) -> DataFrame:
        placed = rows.select("*", F.posexplode("higher").alias("place", "mid"))
        if closable and lists.sinks is not None:
            sinks = rows.sparkSession.createDataFrame(pa.table({"sink": lists.sinks}))
            placed = placed.join(F.broadcast(sinks), F.expr("mid.id = sink"), "left_anti")
        later = F.slice("higher", F.col("place") + 2, F.size("higher") - F.col("place") - 1)
        return placed.filter(f"place < size(higher) - 1 AND {within}").select(
            "low", F.col("mid.id").alias("mid"), later.getField("id").alias("candidates")
        )

    light, cut = _dealt_ranges(lists.df, lists, limits)
    if cut is None:
        return expanded(light, "true")
    return expanded(light, "true").unionByName(expanded(cut, f"({_IDS_BEFORE}) div {limits.wedge_ids} = range"))


def _dealt_ranges(rows: DataFrame, lists: NeighborLists, limits: Limits) -> tuple[DataFrame, DataFrame | None]:
    """Of ``rows`` (low, higher) the lists that one task expands, and a row per ``range`` of the candidate ids of the others, dealt out."""
    if lists.largest <= limits.wedge_ids:
        return rows, None
    cut = (
        rows.filter(f"{_IDS} > {limits.wedge_ids}")
        .selectExpr("low", "higher", f"explode(sequence(0, {_IDS} div {limits.wedge_ids})) AS range")
        .repartition(triangle_partitions(lists.ids, limits), "low", "range")
    )
    return rows.filter(f"{_IDS} <= {limits.wedge_ids}"), cut


def wedge_candidates(lists: NeighborLists, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """``(low, mid, candidates)``: for each edge low-mid the higher neighbors of
    ``low`` that come after ``mid``, sorted by id.

    They stay packed in one array per edge: open wedges are never rows.
    """
    return _open_wedges(lists, limits).withColumn("candidates", F.sort_array("candidates"))


def _loads(lists: NeighborLists, limits: Limits) -> DataFrame:
    """``(mid, salts)`` of the middle vertices that receive too many candidate ids for one task.

    All ids together are known, and fewer than ``limits.heavy_keys`` vertices can each have more than
    1/``heavy_keys`` of them, so the result has a proven size; below that share a vertex is no hot key.
    """
    share = max(limits.wedge_ids, lists.ids // limits.heavy_keys)
    return _received(lists.df).filter(F.col("ids") > share).selectExpr("mid", f"cast(ids div {share} AS bigint) + 1 AS salts")


def directed_triangles(lists: NeighborLists, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Each triangle once, as ``(low, mid, high)`` in the order (degree, id).

    Candidates of low-mid are compared with the higher neighbors of ``mid``, if it has any. Unless the graph is small, the stage has a
    block and a partition per ``limits.wedge_ids`` candidate ids, times
    ``limits.triangle_multiplier``. A middle vertex that receives more ids
    than that is spread over as many salts as its ids call for; its own list is repeated once per salt.

    Where whole lists sent to the cells of a grid are less than half of the candidate ids, that is done instead.
    """
    if side := grid_side(lists, limits):
        return _grid_triangles(lists, side)
    if lists.table is None:
        targets = lists.df.select(F.col("low").alias("mid"), F.col("higher.id").alias("targets"))
        closed = _open_wedges(lists, limits, closable=True).join(targets.hint("shuffle_hash"), "mid")
        return closed.select("low", "mid", F.explode(F.array_intersect("candidates", "targets")).alias("high"))
    return _packed_triangles(lists, limits)


@dataclass(frozen=True)
class _Dealing:
    """How candidates and lists find each other: by blocks of middle vertices, hot ones of which are in several."""

    blocks: int
    hot: np.ndarray  # middle vertices that receive too many candidate ids for one task
    salts: np.ndarray  # over how many salts they are spread

    def salts_of(self, mids: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(mids), np.int64)
        at = np.minimum(np.searchsorted(self.hot, mids), len(self.hot) - 1)
        return np.where(self.hot[at] == mids, self.salts[at], 1)

    def blocks_of(self, mids: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (_mixed(mids.view(np.uint64) + _mixed(salt.view(np.uint64))) % np.uint64(self.blocks)).astype(np.int64)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ keys >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)


def _packed_triangles(lists: NeighborLists, limits: Limits) -> DataFrame:
    """Directed triangles, closed in blocks of middle vertices.

    Tasks expand the lists, and send what is for one block as columns of few bytes: the candidates of an edge are sorted by id, and
    the steps between them are sent. Those that are no vertex's that is behind a middle one are left out.
    """
    ship(lists.df.sparkSession)
    partitions = triangle_partitions(lists.ids, limits)
    loads = _loads(lists, limits).orderBy("mid").toArrow()
    dealing = _Dealing(partitions, *(loads.column(name).to_numpy() for name in ("mid", "salts")))
    sinks, highs, bound = lists.sinks, lists.highs, limits.wedge_ids

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                ranges = batch.column("range").to_numpy()
                yield from expanded_wedges(*_flat_lists(batch, "low", "higher"), ranges, bound, sinks, highs)

        for low, mid, sizes, ids in _gathered(parts()):
            salt = (_mixed(low.view(np.uint64)) % dealing.salts_of(mid).view(np.uint64)).view(np.int64)
            yield _packed_lists(dealing.blocks_of(mid, salt), {"low": low, "mid": mid}, sizes, ids)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mids, sizes, ids in _gathered(_flat_lists(batch, "low", "higher") for batch in batches):
            salts = dealing.salts_of(mids)
            copies = np.repeat(np.arange(len(mids)), salts)
            salt = np.arange(len(copies)) - np.repeat(np.cumsum(salts) - salts, salts)
            starts = np.cumsum(sizes) - sizes
            _, inside = _expanded(sizes[copies])
            flat_ids = ids[np.repeat(starts[copies], sizes[copies]) + inside]
            yield _packed_lists(dealing.blocks_of(mids[copies], salt), {"mid": mids[copies]}, sizes[copies], flat_ids)

    known = lists.df.selectExpr("low", "higher.id AS higher")
    light, cut = _dealt_ranges(known, lists, limits)
    rows = light.selectExpr("low", "higher", "cast(-1 AS bigint) AS range")
    if cut is not None:
        rows = rows.unionByName(cut.selectExpr("low", "higher", "cast(range AS bigint) AS range"))
    wire = "block int, {} binary, size binary, first binary, step binary"
    asking = rows.mapInArrow(ask, wire.format("low binary, mid")).repartition(partitions, "block")
    answering = known.mapInArrow(answer, wire.format("mid")).repartition(partitions, "block")
    return asking.groupBy("block").cogroup(answering.groupBy("block")).applyInArrow(_close_packed, "low bigint, mid bigint, high bigint")


def _gathered(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same lists, their ids last, in fewer and larger parts."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for part in parts:
        if held and count + len(part[-1]) > _PACK_IDS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, count = [], 0
        held.append(part)
        count += len(part[-1])
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _expanded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row, and the place in it, of each item of rows of these sizes."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _among(sorted_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if not len(sorted_ids):
        return np.zeros(len(ids), bool)
    return sorted_ids[np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)] == ids


def expanded_wedges(
    lows: np.ndarray, sizes: np.ndarray, ids: np.ndarray, ranges: np.ndarray, range_ids: int,
    sinks: np.ndarray, highs: np.ndarray | None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(low, mid, size, ids)``: the candidates of some edges low-mid, one edge after the other, at most so many at a time.

    Of a list with a range, only the places whose candidate ids lie in it, and -1 stands for all. ``sinks`` are no middle vertices, and of the ids
    only ``highs`` are candidates.
    """
    row, place = _expanded(sizes)
    ends = np.cumsum(sizes)
    kept = np.ones(len(ids), bool) if highs is None else _among(highs, ids)
    # Candidates of the edge at a place are those kept from the next place to the end of its list.
    before = np.r_[0, np.cumsum(kept)]
    count = before[ends[row]] - before[1:]
    asks = (count > 0) & ~_among(sinks, ids)
    ranged = ranges[row] >= 0
    if ranged.any():
        asks &= ~ranged | (place * (2 * sizes[row] - place - 1) // 2 // range_ids == ranges[row])
    asks = np.flatnonzero(asks)
    values, total = ids[kept], np.cumsum(count[asks])
    cut = 0
    while cut < len(asks):
        done = total[cut - 1] if cut else 0
        upto = max(cut + 1, int(np.searchsorted(total, done + _PACK_IDS, "right")))
        edges = asks[cut:upto]
        edge, inside = _expanded(count[edges])
        yield lows[row[edges]], ids[edges], count[edges], values[before[edges + 1][edge] + inside]
        cut = upto


def _packed_lists(block: np.ndarray, keys: dict[str, np.ndarray], sizes: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Lists by block, each in ascending order: its size, its first id and the steps to the others."""
    order = np.lexsort((keys["mid"], block))
    starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    of, inside = _expanded(sizes)
    ids = ids[np.repeat(starts, sizes) + inside]
    ids = ids[np.lexsort((ids, of))] if _wide(ids, len(sizes)) else _sorted_within(ids, of)
    first = np.cumsum(sizes) - sizes
    steps = np.diff(ids, prepend=0)
    later = np.ones(len(ids), bool)
    later[first] = False
    there, begin = np.unique(block[order], return_index=True)
    edge_cuts = begin[1:]
    step_cuts = (first - np.arange(len(first)))[edge_cuts]
    columns = {name: np.split(key[order], edge_cuts) for name, key in keys.items()}
    columns |= {"size": np.split(sizes, edge_cuts), "first": np.split(ids[first], edge_cuts), "step": np.split(steps[later], step_cuts)}
    packed = {name: pa.array([squeezed(part) for part in parts], pa.binary()) for name, parts in columns.items()}
    return pa.RecordBatch.from_pydict({"block": pa.array(there.astype(np.int32))} | packed)


def _wide(ids: np.ndarray, lists: int) -> bool:
    """Whether a list's number and an id do not fit into one integer."""
    return len(ids) > 0 and (int(ids.max()) - int(ids.min()) + 1) * lists >= 1 << 62


def _sorted_within(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    least, span = (ids.min(), ids.max() - ids.min() + 1) if len(ids) else (0, 1)
    keys = of * span + (ids - least)
    keys.sort()
    return keys - of * span + least


def _opened(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sizes and the ids of packed lists."""
    sizes = flat(rows.column("size"))
    first = np.cumsum(sizes) - sizes
    ids = np.zeros(sizes.sum(), np.int64)
    later = np.ones(len(ids), bool)
    later[first] = False
    ids[later] = flat(rows.column("step"))
    begin = flat(rows.column("first"))
    # Steps are summed over all lists at once, and each list starts anew.
    ids = np.cumsum(ids)
    return sizes, ids + np.repeat(begin - ids[first], sizes)


def _close_packed(asked: pa.Table, known: pa.Table) -> pa.Table:
    found = []
    if asked.num_rows and known.num_rows:
        edges = _EdgeSet(np.repeat(flat(known.column("mid")), (lists := _opened(known))[0]), lists[1])
        at, held, rows = 0, 0, asked.num_rows
        bytes_of_row = [len(step) for step in asked.column("step").to_pylist()]
        for row in range(rows):
            held += bytes_of_row[row]
            if held >= _PACK_IDS or row + 1 == rows:
                found.append(edges.closed(asked.slice(at, row + 1 - at)))
                at, held = row + 1, 0
    none = np.zeros(0, np.int64)
    columns = [np.concatenate([none, *column]) for column in zip(*found)] or [none] * 3
    return pa.table(dict(zip(("low", "mid", "high"), columns)))


class _EdgeSet:
    """Edges mid-target, asked by one bit of their hash first."""

    def __init__(self, mids: np.ndarray, targets: np.ndarray):
        self.mids, self.targets = np.unique(mids), np.unique(targets)
        self.edges = np.sort(np.searchsorted(self.mids, mids) * len(self.targets) + np.searchsorted(self.targets, targets))
        bits = max(10, (16 * len(mids)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[self._hashed(self._start(mids), targets)] = True

    @staticmethod
    def _start(mids: np.ndarray) -> np.ndarray:
        return _mixed(mids.view(np.uint64))

    def _hashed(self, start: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (((start ^ ids.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def closed(self, asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(low, mid, high)`` of the candidates that close a triangle."""
        sizes, ids = _opened(asked)
        low, mid = flat(asked.column("low")), flat(asked.column("mid"))
        likely = np.flatnonzero(self.marks[self._hashed(np.repeat(self._start(mid), sizes), ids)])
        edge = np.searchsorted(np.cumsum(sizes), likely, "right")
        ids = ids[likely]
        there = _among(self.targets, ids) & _among(self.mids, mid)[edge]
        edge, ids = edge[there], ids[there]
        keys = np.searchsorted(self.mids, mid)[edge] * len(self.targets) + np.searchsorted(self.targets, ids)
        hit = _among(self.edges, keys)
        return low[edge[hit]], mid[edge[hit]], ids[hit]


def grid_side(lists: NeighborLists, limits: Limits = DEFAULT_LIMITS) -> int:
    """Blocks of middle vertices, and of lists, whose cells close the wedges; 0 where candidates are sent instead.

    A list goes to each block of middle vertices and a middle vertex's list to each block of lists, so a grid sends each edge
    twice its side. A cell has about ``_CELL_FACTOR * limits.wedge_ids`` candidate ids, so that is twice the square root of the
    cells, while candidates are as many as an edge has later neighbors.
    """
    if lists.table is None:
        return 0
    most = max(_FEW_PARTITIONS, isqrt(lists.closable) // 16)
    cells = min(-(-lists.closable // (_CELL_FACTOR * limits.wedge_ids)), most) * limits.triangle_multiplier
    side = max(1, isqrt(max(0, cells - 1)) + 1)
    return side if 4 * side * lists.edges <= lists.closable else 0


def _grid_triangles(lists: NeighborLists, side: int) -> DataFrame:
    """Directed triangles, closed in the cells (block of the middle vertex, block of the low one) of a grid."""
    ship(lists.df.sparkSession)
    ids = F.col("higher.id")

    def dealt(cell: str, vertex: str, name: str) -> DataFrame:
        own = F.pmod(F.xxhash64("low"), F.lit(side)).cast("int").alias("own")
        other = F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("other")
        flat = lists.df.select(F.col("low").alias(vertex), ids.alias(name), own, other)
        return flat.select(F.expr(cell).alias("cell"), vertex, name).repartition(side * side, "cell").groupBy("cell")

    # A list is asked in its own row of the grid, by the middle vertices of each column; it answers in its own column.
    asking, answering = dealt(f"own * {side} + other", "low", "higher"), dealt(f"other * {side} + own", "mid", "targets")

    names = ("low", "mid", "high")
    none = pa.table({name: pa.array([], pa.int64()) for name in names})

    def close(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return none
        found = list(close_wedges(*_flat_lists(asked, "low", "higher"), *_flat_lists(known, "mid", "targets")))
        return pa.table({name: np.concatenate(column) for name, column in zip(names, zip(*found))}) if found else none

    return asking.cogroup(answering).applyInArrow(close, "low bigint, mid bigint, high bigint")


def _flat_lists(table: pa.Table, vertex: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vertices of some lists, the sizes of the lists and their ids, one list after the other."""
    column = table.column(name)
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes = [np.diff(chunk.offsets.to_numpy()) for chunk in chunks]
    ids = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in chunks]
    none = [np.zeros(0, dtype=np.int64)]
    return table.column(vertex).to_numpy(), np.concatenate(none + sizes), np.concatenate(none + ids)


def close_wedges(
    lows: np.ndarray, sizes: np.ndarray, ids: np.ndarray, mids: np.ndarray, mid_sizes: np.ndarray, targets: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(low, mid, high)`` with ``mid`` before ``high`` in the list of ``low``, and ``high`` in that of ``mid``.

    Edges are one number, from places of their ends among the middle vertices and the targets. Most candidates are
    ruled out by one bit of their hash; the others are looked up.
    """
    if not len(mids) or not len(lows):
        return
    order = np.argsort(mids)
    values = np.unique(targets)
    width = np.int64(len(values))
    edges = np.repeat(np.argsort(order), mid_sizes) * width + np.searchsorted(values, targets)
    edges.sort()
    shift = np.uint64(64 - max(10, (16 * len(edges)).bit_length()))

    def hashed(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift

    marks = np.zeros(1 << (64 - int(shift) - 3), dtype=np.uint8)
    bits = hashed(edges)
    np.bitwise_or.at(marks, bits >> np.uint64(3), np.left_shift(np.uint8(1), (bits & np.uint64(7)).astype(np.uint8)))

    def places(sorted_ids: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_ids, ids)
        at[at == len(sorted_ids)] = 0
        return np.where(sorted_ids[at] == ids, at, -1)

    as_mid, as_target = places(mids[order]), places(values)
    ends = np.repeat(np.cumsum(sizes), sizes)
    low_of = np.repeat(lows, sizes)
    # A candidate that no middle vertex of this cell leads to closes nothing: places among those left.
    reached = np.flatnonzero(as_target >= 0)
    rank, before = as_target[reached], np.searchsorted(reached, np.arange(len(ids) + 1))
    asks = np.flatnonzero(as_mid >= 0)
    starts, counts = before[asks + 1], before[ends[asks]] - before[asks + 1]
    asks, starts, counts = asks[counts > 0], starts[counts > 0], counts[counts > 0]
    total = np.cumsum(counts)
    cut = 0
    while cut < len(asks):
        done = total[cut - 1] if cut else 0
        upto = max(cut + 1, int(np.searchsorted(total, done + _CHUNK_IDS, "right")))
        n = counts[cut:upto]
        inside = np.arange(n.sum()) - np.repeat(total[cut:upto] - n - done, n)
        later = inside + np.repeat(starts[cut:upto], n)
        keys = rank[later] + np.repeat(as_mid[asks[cut:upto]] * width, n)
        bits = hashed(keys)
        likely = np.flatnonzero(marks[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & 1)
        keys = keys[likely]
        at = np.minimum(np.searchsorted(edges, keys), len(edges) - 1)
        hit = likely[edges[at] == keys]
        place = np.repeat(asks[cut:upto], n)[hit]
        yield low_of[place], ids[place], ids[reached[later[hit]]]
        cut = upto


def triangles_by_id(directed: DataFrame, roles: bool = False) -> DataFrame:
    """Triangles as ``(a, b, c)`` with ascending ids; ``roles`` adds which of them are low and mid, as
    ``order``, from which :func:`triangles_by_role` restores the degree order."""
    by_id = directed.select(
        F.least("low", "mid", "high").alias("a"),
        middle_id("low", "mid", "high").alias("b"),
        F.greatest("low", "mid", "high").alias("c"),
        "low",
        "mid",
    )
    place = lambda v: F.when(F.col(v) == F.col("a"), 0).when(F.col(v) == F.col("b"), 1).otherwise(2)
    order = (3 * place("low") + place("mid")).cast("tinyint").alias("order")
    return by_id.select("a", "b", "c", *[order] * roles)


def triangles_by_role(cells: DataFrame) -> DataFrame:
    """``(low, mid, high)`` from ``(a, b, c, order)``."""

    def at(place: Column) -> Column:
        return F.when(place == 0, F.col("a")).when(place == 1, F.col("b")).otherwise(F.col("c"))

    low = F.floor(F.col("order") / 3).cast("int")
    mid = F.col("order") % 3
    return cells.select(at(low).alias("low"), at(mid).alias("mid"), at(3 - low - mid).alias("high"))


# Which vertex of its triangle the third vertex is.
ROLES = ("high", "mid", "low")


def _edge(one: str, other: str, **extra):
    return F.struct(
        smaller_id(one, other).alias("src"),
        larger_id(one, other).alias("dst"),
        *[column.alias(name) for name, column in extra.items()],
    )


def edge_support(triangles: DataFrame) -> DataFrame:
    """``(src, dst, support)``: triangles per edge, counted map-side first.
    Edges in no triangle have no row."""
    return (
        triangles.select(F.inline(F.array(_edge("a", "b"), _edge("a", "c"), _edge("b", "c"))))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("support"))
    )


def triangle_partners(directed: DataFrame) -> DataFrame:
    """``(src, dst, role, third)``: for each edge of each triangle the third
    vertex, and whether that is the triangle's high, mid or low one."""
    return directed.select(
        F.inline(
            F.array(
                _edge("low", "mid", role=F.lit("high"), third=F.col("high")),
                _edge("low", "high", role=F.lit("mid"), third=F.col("mid")),
                _edge("mid", "high", role=F.lit("low"), third=F.col("low")),
            )
        )
    )


def triangle_partner_sizes(directed: DataFrame) -> DataFrame:
    """``(src, dst, support, n_high, n_mid, n_low)``: third vertices by role."""
    return (
        triangle_partners(directed)
        .groupBy("src", "dst")
        .agg(
            F.count(F.lit(1)).alias("support"),
            *[
                F.count_if(F.col("role") == role).alias(f"n_{role}")
                for role in ROLES
            ],
        )
    )


def triangle_partner_lists(
    work: Workspace,
    directed: DataFrame,
    triangle_count: int,
    max_thirds: int = 100_000,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """``(src, dst, part, support, high, mid, low)``: the third vertices as one
    array per role, sorted by id.

    An edge in up to ``max_thirds`` triangles has the one part 0. The third vertices of a hotter edge are ranked
    by id, and part p holds those of ranks p * max_thirds to (p + 1) * max_thirds - 1; ``support``
    always counts all of them.

    Third vertices are dealt to blocks of edges in few bytes, and listed there; those of edges with more than ``limits.range_rows``
    that are cut are dealt by ranges of ranks instead.
    """
    spark = work.spark
    ship(spark)
    partners = triangle_partners(directed)
    bound = max(max_thirds, limits.range_rows)
    hot = None
    if triangle_count > bound:
        counted = partners.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") > bound)
        hot = work.save(counted, "support", rows_of_hot=F.sum("support"))
    listed = partners
    if hot is not None and hot.rows:
        listed = partners.join(hot.df, ["src", "dst"], "left_anti")
    blocks = numbered_blocks(spark, triangle_count, limits)
    code = F.expr(f"array_position(array({', '.join(repr(role) for role in ROLES)}), role) - 1").alias("role")

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {name: batch.column(name).to_numpy() for name in ("src", "dst", "third", "role")}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed_by_block(map(columns, batches), blocks, True)

    def lists(rows: pa.Table) -> pa.Table:
        return _listed(rows, max_thirds)

    wire = "block int, src binary, dst binary, third binary, role binary"
    dealt = listed.select("src", "dst", "third", code).mapInArrow(packed, wire).repartition(blocks.count, "block")
    roles = ", ".join(f"{role} array<bigint>" for role in ROLES)
    found = dealt.groupBy("block").applyInArrow(lists, f"src bigint, dst bigint, part bigint, support bigint, {roles}")
    if hot is None or not hot.rows:
        return found
    few = hot.rows <= limits.broadcast_rows
    known = lookup(
        partners.join(F.broadcast(hot.df.select("src", "dst")), ["src", "dst"], "left_semi") if few else partners,
        hot.df,
        {"src": "src", "dst": "dst"},
        {"support": "support"},
        how="inner",
        heavy=heavy_keys(hot.df, "support", 3 * triangle_count, limits),
        limits=limits,
    )
    ranked = ranked_rows(work, known, ["src", "dst"], ["third"], hot.measures["rows_of_hot"], limits.range_rows)
    parts = ranked.select(*known.columns, F.expr(f"rank div {max_thirds}").alias("part"))
    return found.unionByName(
        parts.groupBy("src", "dst", "part", "support").agg(
            *[F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("third")))).alias(role) for role in ROLES]
        )
    )


def _listed(rows: pa.Table, max_thirds: int) -> pa.Table:
    """The third vertices of a block's edges by role, in parts of so many."""
    src, dst, third, role = (flat(rows.column(name)) for name in ("src", "dst", "third", "role"))
    order = np.lexsort((third, dst, src))
    src, dst, third, role = src[order], dst[order], third[order], role[order]
    starts = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
    sizes = np.diff(np.r_[np.flatnonzero(starts), len(src)])
    rank = _expanded(sizes)[1]
    starts |= rank % max_thirds == 0
    first = np.flatnonzero(starts)
    part_of = np.cumsum(starts) - 1
    columns = {"src": src[first], "dst": dst[first], "part": rank[first] // max_thirds, "support": np.repeat(sizes, sizes)[first]}
    for place, name in enumerate(ROLES):
        at = role == place
        ends = np.r_[0, np.cumsum(np.bincount(part_of[at], minlength=len(first)))].astype(np.int32)
        columns[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(third[at]))
    return pa.table(columns)
