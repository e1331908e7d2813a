"""SentencePiece encoding by sampling, and lossless decoding.

A text is cut into chunks: a run of spaces and what follows up to the next space. Pieces never reach past a
chunk, so the lattice of a text is a chain of chunk lattices. Forward filtering sums, at each
character, the weights of all segmentations that end there; backward sampling then walks from the end of the
chunk to its start, taking each piece in proportion to the weight it ends. A piece weighs
(id + 1) ** -SHARPNESS, as ids of such a vocabulary follow the rank of a piece; a character that is
no piece is spelled by its bytes.

The lattices of all new chunks of a slice are built together: pieces are found by walking a trie from all
characters at once, and weights are summed place by place over all chunks. Shares are kept in units of 2**-32 and draws
are 32-bit integers, so a draw can never leave its node, whatever its value.

The draws are a hash of the row key, the seed, and the place of the chunk, so a segmentation does not
depend on partitions or retries. Chunk lattices are cached within a Python worker; the cache is bounded.

Defined cases: a null text has null ids and stays null; an empty one has none; the space mark U+2581 in a
text is spelled by bytes, so decoding is lossless for every text; rows that repeat a key and text repeat
its segmentation; a null key is a key. Control pieces are never used.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.llm import text as T

SHARPNESS = 1.0
SEED = 1
_MARK = "▁"
#: Lattice nodes that a worker keeps.
_CACHED_NODES = 2_000_000
_TINY = 1e-200
_CHUNKS = re.compile(" *[^ ]+| +")
#: Bits of a code point in a key of the trie.
_CODE = 21
_UNIT = 32

_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The vocabulary of a file, read once a worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


class _Grown:
    """An array to which blocks are added at an amortised cost."""

    def __init__(self, dtype: type) -> None:
        self._room = np.zeros(1 << 12, dtype=dtype)
        self.size = 0

    def add(self, block: np.ndarray) -> None:
        need = self.size + len(block)
        if need > len(self._room):
            room = np.zeros(max(need, 2 * len(self._room)), dtype=self._room.dtype)
            room[: self.size] = self.values
            self._room = room
        self._room[self.size : need] = block
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self._room[: self.size]


class Pieces:
    """A piece vocabulary with the chunk lattices met so far."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, tuple[int, float]] = {}
        self.byte_ids = np.zeros(256, dtype=np.int32)
        spelled: list[bytes] = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or _MARK in piece.lstrip(_MARK):
                spelled.append(b"")
            else:
                text = piece.replace(_MARK, " ")
                self.ids[text] = (i, (i + 1.0) ** -SHARPNESS)
                spelled.append(text.encode())
        self.bytes = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.byte_length = np.array([len(s) for s in spelled])
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length
        self.longest = max(map(len, self.ids), default=1)
        self._weight = (np.arange(n) + 1.0) ** -SHARPNESS
        self._spell_weight = (n + 1.0) ** -SHARPNESS / 100
        self._plant()
        self._reset()

    def _plant(self) -> None:
        """The trie: sorted keys (node, code point), the node that each leads to, and the piece that ends there."""
        nodes: dict[int, int] = {}
        ends = [-1]
        for text, (i, _) in self.ids.items():
            node = 0
            for c in text:
                key = node << _CODE | ord(c)
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            ends[node] = i
        keys = np.array(list(nodes.keys()), dtype=np.int64)
        order = np.argsort(keys)
        self._keys = np.append(keys[order], np.iinfo(np.int64).max)
        self._child = np.append(np.array(list(nodes.values()), dtype=np.int64)[order], 0)
        self._ends = np.array(ends, dtype=np.int64)

    def _reset(self) -> None:
        self._end_node: dict[str, int] = {}
        self._nodes = 0
        self._shares = _Grown(np.int64)  # node << 32 plus the share of its edges up to this one
        self._from = _Grown(np.int64)
        self._piece = _Grown(np.int64)
        self._root = _Grown(np.bool_)

    def _found(self, codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first character, character after, piece) of all pieces within the chunks that end at `stops`."""
        first, node, depth = np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(first):
            key = node << _CODE | codes[first + depth]
            place = np.searchsorted(self._keys, key)
            hit = self._keys[place] == key
            first, node = first[hit], self._child[place[hit]]
            depth += 1
            piece = self._ends[node]
            whole = piece >= 0
            out.append((first[whole], first[whole] + depth, piece[whole]))
            inside = first + depth < stops[first]
            first, node = first[inside], node[inside]
        empty = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate([empty, *part]) for part in zip(*out, strict=True)) if out else (empty,) * 3

    def _learn(self, chunks: list[str]) -> None:
        """Add the lattices of new chunks: per node its incoming pieces with cumulative shares."""
        size = np.array([len(c) for c in chunks])
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        stop = np.cumsum(size)
        owner = np.repeat(np.arange(len(chunks)), size)
        first, after, piece = self._found(codes, stop[owner])
        # A character where no piece ends is spelled.
        alone = np.flatnonzero(np.bincount(after, minlength=len(codes) + 1)[1:] == 0)
        weight = np.append(self._weight[piece], np.full(len(alone), self._spell_weight))
        first, after, piece = np.append(first, alone), np.append(after, alone + 1), np.append(piece, -1 - codes[alone])
        # A chunk of n characters has n + 1 nodes; the first is its root.
        root = stop - size + np.arange(len(chunks))
        chunk = owner[first]
        origin, node = first + chunk, after + chunk
        order = np.lexsort((origin, node))
        origin, node, piece, weight = origin[order], node[order], piece[order], weight[order]
        place = node - root[chunk[order]]
        share = np.ones(len(node))
        total = np.zeros(len(codes) + len(chunks))
        total[root] = 1.0
        by_place = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(1, int(size.max()) + 2))
        for at, to in zip(cuts, cuts[1:], strict=False):
            edge = by_place[at:to]
            value = total[origin[edge]] * weight[edge]
            starts = np.flatnonzero(np.append(True, node[edge][1:] != node[edge][:-1]))
            sums = np.add.reduceat(value, starts)
            share[edge] = value / np.repeat(sums, np.diff(np.append(starts, len(edge))))
            ends = node[edge[starts]]
            total[ends] = sums
            low = sums < _TINY
            if low.any():  # rescale the weights that later nodes look back on
                ends, scale = ends[low], 1 / sums[low]
                back = np.minimum(self.longest, ends - root[np.searchsorted(root, ends, side="right") - 1] + 1)
                total[T.ranges(ends - back + 1, back)] *= np.repeat(scale, back)
        # Shares are of the order of one, so their running sum over all nodes is exact enough for 2**-32.
        starts = np.append(True, node[1:] != node[:-1])
        running = np.cumsum(share)
        before = (running - share)[starts]
        group = np.cumsum(starts) - 1
        units = np.floor((running - before[group]) * (1 << _UNIT)).astype(np.int64)
        last = np.append(starts[1:], True)
        units = np.where(last, 1 << _UNIT, np.clip(units, 0, 1 << _UNIT))
        # The root has one edge to itself, which is never walked.
        node, origin, piece = np.append(node, root), np.append(origin, root), np.append(piece, np.zeros(len(root), np.int64))
        units = np.append(units, np.full(len(root), 1 << _UNIT))
        order = np.argsort(node, kind="stable")
        base = self._nodes
        self._shares.add(((node + base) << _UNIT)[order] + units[order])
        self._from.add(origin[order] + base)
        self._piece.add(piece[order])
        is_root = np.zeros(len(total), dtype=bool)
        is_root[root] = True
        self._root.add(is_root)
        self._end_node.update(zip(chunks, (root + size + base).tolist(), strict=True))
        self._nodes += len(total)

    def _nodes_of(self, chunks: list[str]) -> np.ndarray:
        """The last node of each chunk, whose lattices are built where they are missing."""
        new = {c for c in chunks if c not in self._end_node}
        if new:
            if self._nodes > _CACHED_NODES:
                self._reset()
                new = set(chunks)
            self._learn(sorted(new))
        return np.fromiter(map(self._end_node.__getitem__, chunks), dtype=np.int64, count=len(chunks))

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each text's ids."""
        chunks: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                found = _CHUNKS.findall(text)
                counts[i] = len(found)
                chunks += found
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        node = self._nodes_of(chunks)
        owner = np.repeat(np.arange(len(texts)), counts)
        place = T.ranges(np.zeros(len(texts), dtype=np.int64), counts)
        draw = T.mix(keys[owner] + T.mix(place.astype(np.uint64)))
        shares, origin, pieces, root = (a.values for a in (self._shares, self._from, self._piece, self._root))
        active, steps = np.arange(len(chunks)), []
        while len(active):
            draw = T.mix(draw + np.uint64(0x9E3779B97F4A7C15))
            edge = np.searchsorted(shares, (node << _UNIT) + (draw >> np.uint64(64 - _UNIT)).astype(np.int64), side="right")
            steps.append((active, pieces[edge]))
            node = origin[edge]
            left = ~root[node]
            active, node, draw = active[left], node[left], draw[left]
        chunk = np.concatenate([s[0] for s in reversed(steps)])
        piece = np.concatenate([s[1] for s in reversed(steps)])
        order = np.argsort(chunk, kind="stable")
        return self._spelled(owner[chunk[order]], piece[order], len(texts))

    def _spelled(self, owner: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        rare = np.flatnonzero(piece < 0)
        width = np.ones(len(piece), dtype=np.int64)
        spelled = [chr(-1 - c).encode() for c in piece[rare]]
        width[rare] = [len(s) for s in spelled]
        end = np.cumsum(width)
        ids = np.empty(int(end[-1]), dtype=np.int32)
        usual = piece >= 0
        ids[end[usual] - 1] = piece[usual]
        if len(rare):
            slots = T.ranges(end[rare] - width[rare], width[rare])
            ids[slots] = self.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
        per_text = np.bincount(owner, width, minlength=n).astype(np.int64)
        return ids, np.append(0, np.cumsum(per_text))

    def decode(self, ids: np.ndarray) -> str:
        return self.bytes[T.ranges(self.byte_start[ids], self.byte_length[ids])].tobytes().decode()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each text, from the ids of all of them."""
        length = self.byte_length[ids]
        whole = self.bytes[T.ranges(self.byte_start[ids], length)].tobytes()
        ends = np.append(0, np.cumsum(length))[offsets].tolist()
        return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _row_keys(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id").alias("key"), "text")


def encode_documents(docs: DataFrame, model: str, seed: int = SEED) -> DataFrame:
    """doc_id and the sampled ids (array of int) of every row; `model` is a path every executor can read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for part in T.slices(batch):
                texts = part.column("text").to_pylist()
                ids, offsets = pieces.encode(texts, part.column("key").to_numpy().view(np.uint64))
                missing = np.append(np.array([t is None for t in texts], dtype=bool), False)
                column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=missing), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _row_keys(docs, seed).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            lists = batch.column("ids")
            texts = [None if not i.is_valid else pieces.decode(i.values.to_numpy()) for i in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, model: str, seed: int = SEED) -> DataFrame:
    """Per row: pieces, checksum of the ids (32-bit little-endian), digest of the decoded text, and whether it is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for part in T.slices(batch):
                texts = part.column("text").to_pylist()
                ids, offsets = pieces.encode(texts, part.column("key").to_numpy().view(np.uint64))
                out = []
                little = ids.astype("<u4")
                for text, at, stop, decoded in zip(texts, offsets[:-1], offsets[1:], pieces.decode_all(ids, offsets), strict=True):
                    digest = None if text is None else hashlib.sha256(decoded).hexdigest()
                    out.append((stop - at, zlib.crc32(little[at:stop].tobytes()), digest, text is None or decoded == text.encode()))
                count, crc, digest, same = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(crc, pa.int64()), pa.array(digest, pa.string()), pa.array(same)],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _row_keys(docs, seed).mapInArrow(
        run, f"doc_id {kind}, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean"
    )
