"""N-gram Jaccard join with count vectors in an R-tree.

A document is the set of its distinct 5-word shingles (A-Z lower-cased). Two documents link when
100 * |x & y| >= 75 * |x | y|. Documents with one set are a class; the join works on classes.

1. Shingles that a task finds in a share `HOT_SHARE` of its documents are counted; the hot ones (at
   most mean set size / HOT_SHARE, whatever the number of documents) are ordered last.
2. Sets that link share a shingle among the first n - ceil(0.75 n) + 1 of either in that order.
   Classes that share such a shingle form a block, cut where the sizes and the places of the shingle rule
   out a link between its sides; blocks of equal members are one block.
3. Most links are found first: each class is compared with one class of equal min-hash. Blocks whose
   members these links already connect need no further look, and no pair inside a component is
   emitted.
4. In every other block, the shingles of a class are hashed into groups; the group counts are a
   point, and the points are bulk-loaded into an R-tree. Overlap is at most the sum of coordinate minima,
   for boxes (over their upper corners) as for points. Of the pairs that may reach the needed overlap, a
   round verifies on their whole sets the nearest of each member outside its component, joins the components, and
   goes on with the blocks that still have pairs between components, each time with more pairs a member, until
   none was left out. So a group of thousands of near copies costs a few comparisons a member, and a round sends no more
   pairs than its width times the members.

Blocks beyond `BLOCK` members are dealt out as pairs of sub-blocks. Links give components by
alternating stars.

Defined cases: null and empty texts have n_shingles 0 and are their own component; fewer than five
words are one shingle; rows that repeat a document share its component; a null id takes part, and a
component's id is the smallest id that is not null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.llm import text as T
from knitgraph.llm.components import components
from knitgraph.plans import Staged, Workspace

WIDTH = 5
#: Shingles in this share of the documents are ordered last.
HOT_SHARE = 0.0005
HOT_LIMIT = 200_000
MIN_HASHES = 4
#: Members of a block that one task compares.
BLOCK = 5_000
#: Factor by which the pairs that a round sends for each member grow, and pairs of a block held before they are thinned.
WIDER = 8
HELD_PAIRS = 1 << 19
#: Members of a leaf of the R-tree, and comparisons of one star that one task makes.
LEAF = 16
STAR = 20_000
_SCALE = 7  # overlap * 7 >= 3 * (|x| + |y|) is the same as a Jaccard similarity of 0.75


def shingle_sets(x: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of all texts, and the offsets of each text's set."""
    words = x.word_hashes(lower=True)
    first, counts = x.windows(WIDTH)
    grams, doc = [T.word_window_hashes(words, first, WIDTH)], [np.repeat(np.arange(x.n), counts)]
    for k in range(1, WIDTH):
        short = np.flatnonzero(x.n_words == k)
        grams.append(T.mix(T.word_window_hashes(words, x.word_offsets[short], k) + np.uint64(k)))
        doc.append(short)
    grams, doc = np.concatenate(grams), np.concatenate(doc)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(x.n + 1))


def _hot_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of very many documents, ascending. Any choice gives the same links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = rows = 0

        def often() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            kept = counts >= max(2, HOT_SHARE * rows / 2)
            return pa.RecordBatch.from_arrays([pa.array(found[kept].view(np.int64)), pa.array(counts[kept])], ["shingle", "n"])

        for batch in batches:
            for part in T.slices(batch):
                grams, _ = shingle_sets(T.Texts(part.column("text")))
                held.append(grams)
                size, rows = size + len(grams), rows + part.num_rows
                if size > 1 << 22:
                    yield often()
                    held.clear()
                    size = rows = 0
        if held:
            yield often()

    counts = docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    least = max(20.0, HOT_SHARE * docs.count())
    hot = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "shingle").limit(HOT_LIMIT)
    return np.sort(np.array([r["shingle"] for r in hot.collect()], dtype=np.int64).view(np.uint64))


def groups_of(n: np.ndarray) -> np.ndarray:
    """Coordinates of a count vector: the next power of two of the set size, up to 4096."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 2, 12)


def class_keys(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(T.mix(grams), out=sums[1:])
    n = np.diff(offsets).astype(np.uint64)
    return T.mix(sums[offsets[1:]] - sums[offsets[:-1]] + T.mix(n)).view(np.int64)


def count_vectors(grams: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles per group of each set, one after the other; 255 stands for that or more."""
    n = np.diff(offsets)
    groups = groups_of(n)
    ends = np.cumsum(groups)
    doc = np.repeat(np.arange(len(n)), n)
    slot = (ends - groups)[doc] + (grams & (groups[doc] - 1).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(slot, minlength=int(groups.sum())), 255).astype(np.uint8), np.append(0, ends)


def _with_key(docs: DataFrame) -> DataFrame:
    row = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return docs.withColumns({"k1": F.xxhash64(*row), "k2": F.hash(*row)})


def _rows(docs: DataFrame) -> DataFrame:
    """Per row: the class (a hash of the set), its size and min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                x = T.Texts(part.column("text"))
                grams, offsets = shingle_sets(x)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                mins = np.zeros((x.n, MIN_HASHES), dtype=np.uint64)
                for j in range(MIN_HASHES):
                    if len(full):
                        hashed = T.mix(grams ^ np.uint64(0x5851F42D4C957F2D * (j + 1) & (2**64 - 1)))
                        mins[full, j] = T.mix(np.minimum.reduceat(hashed, offsets[full]) + np.uint64(j))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(x.n + 1, dtype=np.int32) * MIN_HASHES), pa.array(mins.reshape(-1).view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("doc_id", "k1", "k2")],
                        pa.array(class_keys(grams, offsets)),
                        pa.array(n.astype(np.int64)),
                        lists,
                    ],
                    ["doc_id", "k1", "k2", "cls", "n", "mins"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 int, cls bigint, n bigint, mins array<bigint>")


def _prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(value, n, reach, cls) for the prefix shingles of each class, once a task.

    A class whose first common shingle with another stands at place p shares at most n - p with it; so it
    links with no set of more than `reach` shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = shared.value, set()
        for batch in batches:
            for part in T.slices(batch):
                grams, offsets = shingle_sets(T.Texts(part.column("text")))
                n, cls = np.diff(offsets), class_keys(grams, offsets)
                fresh = np.zeros(len(n), dtype=bool)
                for i, key in enumerate(cls.tolist()):
                    fresh[i] = key not in seen
                    seen.add(key)
                late = np.zeros(len(grams), dtype=bool)
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
                order = np.lexsort((late, np.repeat(np.arange(len(n)), n)))
                prefix = np.where(fresh & (n > 0), n - (3 * n + 3) // 4 + 1, 0)
                chosen = grams[order[T.ranges(offsets[:-1], prefix)]]
                size = np.repeat(n, prefix)
                place = T.ranges(np.zeros(len(n), dtype=np.int64), prefix)
                reach = (_SCALE * (size - place) - 3 * size) // 3
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(chosen.view(np.int64)),
                        pa.array(size.astype(np.int32)),
                        pa.array(reach.astype(np.int32)),
                        pa.array(np.repeat(cls, prefix)),
                    ],
                    ["value", "n", "reach", "cls"],
                )

    return docs.select("text").mapInArrow(run, "value bigint, n int, reach int, cls bigint")


def _blocks(prefixes: DataFrame) -> DataFrame:
    """(block, cls) for the classes that share a shingle and may link; equal blocks come once a task.

    Rows arrive sorted by shingle, size and class; a block is named by the hash of its members. The members
    of one beyond BLOCK rows are emitted in parts under the name of its shingle, uncut.
    """
    columns = ("value", "n", "reach", "cls")

    def named(value: np.ndarray, cls: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(cls)], ["block", "cls"])

    def emit(rows: list[np.ndarray]) -> pa.RecordBatch:
        value, n, reach, cls = rows
        new = np.append(True, value[1:] != value[:-1])[: len(value)]
        # The farthest reach so far within the shingle: a larger size starts a block of its own.
        base = (np.cumsum(new) - 1) << 33
        far = np.maximum.accumulate(base + np.maximum(reach, 0)) - base if len(value) else reach
        new[1:] |= n[1:] > far[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(value)))
        sums = np.zeros(len(cls) + 1, dtype=np.uint64)
        np.cumsum(T.mix(cls.view(np.uint64)), out=sums[1:])
        names = T.mix(sums[start + size] - sums[start] + size.astype(np.uint64))
        kept = np.repeat(size >= 2, size)
        return named(value[kept], cls[kept], np.repeat(names, size)[kept])

    def emit_whole(rows: list[np.ndarray]) -> pa.RecordBatch:
        value, _, _, cls = rows
        return named(value, cls, T.mix(value.view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64) for _ in columns]
        whole, last = None, None
        for batch in batches:
            rows = [batch.column(c).to_numpy().astype(np.int64) for c in columns]
            if not len(rows[0]):
                continue
            # Each task that saw a copy of a class sent its rows.
            value, cls = rows[0], rows[3]
            new = np.append((value[0], cls[0]) != last, (value[1:] != value[:-1]) | (cls[1:] != cls[:-1]))
            last = (value[-1], cls[-1])
            rows = [np.append(r, column[new]) for r, column in zip(rest, rows, strict=True)]
            value = rows[0]
            if whole is not None:  # the rest of a very large block
                stop = int(np.count_nonzero(value == whole))
                if stop:
                    yield emit_whole([r[:stop] for r in rows])
                if stop < len(value):
                    whole = None
                rows = [r[stop:] for r in rows]
                value = rows[0]
            rest = rows
            if not len(value):
                continue
            tail = int(np.flatnonzero(np.append(True, value[1:] != value[:-1]))[-1])
            yield emit([r[:tail] for r in rows])
            rest = [r[tail:] for r in rows]
            if len(rest[0]) > BLOCK:
                whole = rest[0][0]
                yield emit_whole(rest)
                rest = [r[:0] for r in rest]
        yield emit(rest)

    return prefixes.mapInArrow(run, "block bigint, cls bigint")


def _fold(vectors: np.ndarray) -> np.ndarray:
    half = vectors.shape[1] // 2
    return vectors[:, :half] + vectors[:, half:]


class _Nearest:
    """The pairs of a block that are among the `width` best of either member, by the bound on their similarity."""

    def __init__(self, sizes: np.ndarray, width: int) -> None:
        self.sizes, self.width = sizes, width
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.cut = 0, False

    def add(self, x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> None:
        small = np.minimum(bound, np.minimum(self.sizes[x], self.sizes[y]))
        self.held.append((x, y, small / (self.sizes[x] + self.sizes[y] - small)))
        self.n += len(x)
        if self.n > HELD_PAIRS:
            self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        x, y, share = (np.concatenate(part) for part in zip(*self.held, strict=True))
        ends, other, pair = np.append(x, y), np.append(y, x), np.tile(np.arange(len(x)), 2)
        order = np.lexsort((other, -share[pair], ends))
        first = np.flatnonzero(np.append(True, ends[order][1:] != ends[order][:-1]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = np.zeros(len(x), dtype=bool)
        kept[pair[order[place < self.width]]] = True
        self.cut |= not kept.all()
        x, y, share = x[kept], y[kept], share[kept]
        self.held, self.n = [(x, y, share)], 0
        return x, y


def close_pairs(
    sizes: np.ndarray, vectors: list[np.ndarray], owner: np.ndarray, side: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of members whose overlap may reach the threshold, the `width` nearest of each, and whether there were more.

    Pairs of one owner are left out; of members on sides 0 and 1 only pairs across are wanted.
    """
    found = _Nearest(sizes, width)
    groups = groups_of(sizes)
    for g in np.unique(groups):
        low, high = np.flatnonzero(groups == g), np.flatnonzero(groups == 2 * g)
        mine = _bulk_load(low, _points(vectors, low, sizes), sizes)
        _tree_join(mine, mine, sizes, owner, side, found)
        if len(high):
            _tree_join(mine, _bulk_load(high, _fold(_points(vectors, high, sizes)), sizes), sizes, owner, side, found)
    x, y = found.thin()
    return x, y, found.cut


def _points(vectors: list[np.ndarray], which: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Points of members; a saturated coordinate stands for the whole set, which no count exceeds."""
    rows = np.stack([vectors[i] for i in which])
    full = rows == 255
    if not full.any():
        return rows.astype(np.uint16)
    return np.where(full, sizes[which][:, None], rows).astype(np.int32)


def _bulk_load(which: np.ndarray, rows: np.ndarray, sizes: np.ndarray):  # noqa: ANN202
    """Leaves of LEAF members: sorted by size strata, then by their largest coordinates."""
    stratum = np.floor(np.log(np.maximum(sizes[which], 1)) / np.log(1.1)).astype(int)
    tilt = rows[:, : max(1, rows.shape[1] // 2)].sum(axis=1)
    order = np.lexsort((tilt, rows.argmax(axis=1), stratum))
    which, rows = which[order], rows[order]
    cuts = np.arange(0, len(which), LEAF)
    return which, rows, cuts, np.maximum.reduceat(rows, cuts), np.minimum.reduceat(sizes[which], cuts), np.maximum.reduceat(sizes[which], cuts)


def _reach(minima: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return _SCALE * minima >= 3 * (nx + ny)


def _tree_join(a, b, sizes, owner, side, found: _Nearest) -> None:  # noqa: ANN001
    which_a, rows_a, cuts_a, top_a, small_a, large_a = a
    which_b, rows_b, cuts_b, top_b, small_b, large_b = b
    for i in range(len(cuts_a)):
        first = i if a is b else 0
        near = (4 * large_a[i] >= 3 * small_b[first:]) & (4 * large_b[first:] >= 3 * small_a[i])
        leaves = first + np.flatnonzero(near)
        box = np.minimum(top_a[i], top_b[leaves]).sum(axis=1, dtype=np.int64)
        leaves = leaves[_reach(box, small_a[i], small_b[leaves])]
        if not len(leaves):
            continue
        mine = np.arange(cuts_a[i], min(cuts_a[i] + LEAF, len(which_a)))
        theirs = T.ranges(cuts_b[leaves], np.minimum(LEAF, len(which_b) - cuts_b[leaves]))
        for p in mine:
            q = theirs[theirs > p] if a is b else theirs
            x, y = which_a[p], which_b[q]
            q = q[(owner[y] != owner[x]) & ((side[y] != side[x]) | (side[x] == 2))]
            if len(q):
                y = which_b[q]
                bound = np.minimum(rows_a[p], rows_b[q]).sum(axis=1, dtype=np.int64)
                ok = _reach(bound, sizes[x], sizes[y])
                if ok.any():
                    found.add(np.full(int(ok.sum()), x), y[ok], bound[ok])


def _candidates(members: DataFrame, width: int) -> DataFrame:
    """Surviving pairs of each block, the `width` nearest of each member; rows arrive grouped by block and part.
    `more`: pairs of the block were left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            cls = rows.column("cls").to_numpy()
            vectors = [np.frombuffer(v, dtype=np.uint8) for v in rows.column("vector").to_pylist()]
            x, y, more = close_pairs(
                rows.column("n").to_numpy(), vectors, rows.column("comp").to_numpy(), rows.column("side").to_numpy(), width
            )
            x, y = cls[x], cls[y]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(np.full(len(x), last[0])), pa.array(np.full(len(x), more))],
                ["a", "b", "block", "more"],
            )

        last = None
        for batch in batches:
            key = np.column_stack([batch.column(c).to_numpy() for c in ("block", "low", "high")])
            if not len(key):
                continue
            cuts = np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1)
            for at, stop in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if last is not None and tuple(key[at]) != last:
                    yield from close()
                last = tuple(key[at].tolist())
                held.append(batch.slice(at, stop - at))
        yield from close()

    return members.mapInArrow(run, "a bigint, b bigint, block bigint, more boolean")


def _texts(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(cls, text): one text of each of the classes `needed`. A text is smaller than its set of 64-bit hashes."""
    rows = docs.select("k1", "k2", "text").join(needed.select("k1", "k2", "cls"), ["k1", "k2"])
    # Rows that repeat a document are one.
    return rows.groupBy("cls").agg(F.first("text").alias("text"))


def _vectors(texts: DataFrame) -> DataFrame:
    """(cls, n, vector): the sizes and count vectors of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                grams, offsets = shingle_sets(T.Texts(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls"), pa.array(np.diff(offsets).astype(np.int64)), T.binary_rows(*count_vectors(grams, offsets))],
                    ["cls", "n", "vector"],
                )

    return texts.mapInArrow(run, "cls bigint, n bigint, vector binary")


def _verified(pairs: DataFrame, texts: DataFrame, work: Workspace) -> Staged:
    """The pairs (a, b) whose whole sets reach the threshold.

    Pairs are gathered as stars around a: its text is sent once a task, the others' texts stream by.
    """
    width = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    others = pairs.join(width, "a").select(
        "a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("cls")
    )
    centers = width.select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("cls")
    )
    stars = others.unionByName(centers).join(texts, "cls").select("a", "part", "role", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, own = None, None
        for batch in batches:
            for piece in T.slices(batch):
                grams, offsets = shingle_sets(T.Texts(piece.column("text")))
                a, b = [], []
                rows = zip(*(piece.column(c).to_pylist() for c in ("a", "role", "cls")), offsets[:-1], offsets[1:], strict=True)
                for key, role, cls, at, stop in rows:
                    values = grams[at:stop]
                    if role == 0:
                        center, own = key, values
                    elif key == center:
                        both = np.concatenate([own, values])
                        both.sort(kind="stable")
                        overlap = int((both[1:] == both[:-1]).sum())
                        if _SCALE * overlap >= 3 * (len(own) + len(values)):
                            a.append(key)
                            b.append(cls)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    gathered = stars.repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return work.save(gathered.mapInArrow(run, "a bigint, b bigint"), "verified")


def _open_members(members: DataFrame, roots: DataFrame, vectors: DataFrame) -> DataFrame:
    """The members of blocks with more than one component, dealt out by pairs of sub-blocks."""
    known = members.join(roots, members["cls"] == roots["node"], "left").select(
        "block", "cls", F.coalesce("root", "cls").alias("comp")
    )
    open_blocks = known.groupBy("block").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"), F.min("comp").alias("c1"), F.max("comp").alias("c2")
    ).filter("c1 <> c2")
    part = F.pmod(F.xxhash64("cls"), "parts").cast("int")
    return (
        known.join(open_blocks, "block")
        .select("block", "cls", "comp", "parts", part.alias("part"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "block", "cls", "comp", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
            # Which side of its pair of sub-blocks a member is on; 2: both sides are one.
            F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
        )
        .join(vectors, "cls")
        .repartition("block", "low", "high")
        .sortWithinPartitions("block", "low", "high")
    )


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (which tell rows apart), n_shingles and component_id of every row."""
    work = Workspace(docs.sparkSession, "jaccard")
    keyed = _with_key(docs.select("doc_id", "text"))
    rows = work.save(_rows(keyed), "rows").df
    classes = work.save(
        rows.filter("n > 0").groupBy("cls").agg(
            F.first("n").alias("n"), F.min("doc_id").alias("least"), F.min("k1").alias("k1"),
            F.min_by("k2", "k1").alias("k2"), F.first("mins").alias("mins"),
        ),
        "classes",
    ).df

    hashes = classes.select("cls", "n", F.explode("mins").alias("value"))
    center = hashes.groupBy("value").agg(F.min(F.struct("cls", "n")).alias("center"), F.count(F.lit(1)).alias("m"))
    stars = (
        hashes.join(center.filter("m > 1"), "value")
        .filter("cls > center.cls AND 4 * n >= 3 * center.n AND 4 * center.n >= 3 * n")
        .groupBy("cls")
        .agg(F.min("center.cls").alias("a"))
        .select("a", F.col("cls").alias("b"))
    )
    starred = work.save(stars, "stars")
    stars = starred.df
    prefixes = _prefixes(keyed, _hot_shingles(docs)).repartition("value").sortWithinPartitions("value", "n", "cls")
    blocks = work.save(_blocks(prefixes).distinct(), "blocks")
    members = blocks.df
    named = members.select("cls").union(stars.select("a")).union(stars.select("b")).distinct()
    texts = work.save(_texts(keyed, classes.join(named, "cls", "left_semi")), "texts")
    vectors = work.save(_vectors(texts.df), "vectors")

    links = [_verified(stars, texts.df, work)]
    roots = components(links[0].df, work)
    width, tried = 1, [starred, blocks]
    while True:
        dealt = _open_members(members, roots, vectors.df)
        survivors = work.save(_candidates(dealt, width), "survivors", more=F.count_if("more"))
        tried.append(survivors)
        if not survivors.rows:
            break
        links.append(_verified(survivors.df.select("a", "b").distinct(), texts.df, work))
        if links[-1].rows:
            roots = components(work.read(*links), work)
        if not survivors.measures["more"]:
            break
        # A block of which no pair was left out is done: all its pairs between components were verified.
        unfinished = survivors.df.filter("more").select("block").distinct()
        members = members.join(unfinished, "block", "left_semi")
        width *= WIDER
    work.drop(texts, vectors, *tried, *links)

    root_of = classes.select("cls", "least").join(roots, F.col("cls") == F.col("node"), "left").select(
        "cls", "least", F.coalesce("root", "cls").alias("root")
    )
    ids = root_of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root_of.join(ids, "root").select("cls", "component_id")
    empty = rows.filter("n = 0").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    full = rows.filter("n > 0").join(named, "cls").select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component: that with the smallest id, ties to the smallest key.

    Rows without a word are linked with nothing and all stay.
    """
    linked = link_documents(docs)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k1"), F.col("k2"))
    # A component whose rows all have null ids has no id: its rows are told apart by their keys.
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("k1"))]
    kept = (
        linked.filter("n_shingles > 0").groupBy(*group).agg(F.min(order).alias("at"))
        .select(F.col("at.k1").alias("_k1"), F.col("at.k2").alias("_k2"))
    )
    wordless = linked.filter("n_shingles = 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.lit(True).alias("_all")).distinct()
    kept = kept.select("_k1", "_k2", F.lit(False).alias("_all")).union(wordless)
    # The row travels as one column, so that no name of it can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = _with_key(docs.select("doc_id", "text", row)).select("row", "k1", "k2")
    found = marked.join(kept, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    once = found.filter("NOT _all").dropDuplicates(["k1", "k2"])
    return once.select("row.*").unionByName(found.filter("_all").select("row.*"))
