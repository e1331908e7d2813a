"""Substring de-duplication with a compressed FM-index per shard.

A window of `WINDOW` words that occurs again anywhere marks its words for removal. Equal windows
hold equal anchors (the smallest hash of their `ANCHOR`-word groups, the leftmost of ties), so the
corpus is cut into runs of windows around one anchor, and only runs whose anchor occurs again go
on. Runs of equal content are one piece with a number of copies. Pieces are dealt to shards by
anchor, so that all places of a window meet in one shard. There an FM-index (wavelet matrix over
the BWT of the shard's words) is built, every piece is streamed against it by backward search,
and the span whose matches reach the threshold is reported.

An anchor that many different runs share (the edges of a passage that half of the corpus quotes)
is split further: its runs become single windows, equal ones are added up before they are dealt
out, and their shard follows the content of the window.

Defined cases: null and empty texts have no words and nothing removed; rows that repeat a document
are further copies of its windows; null ids are ids like any other; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.llm import text as T
from knitgraph.plans import Workspace

WINDOW = 35
ANCHOR = 8
_SPAN = WINDOW - ANCHOR + 1  # anchors to choose from in a window
#: Words in the index of one shard.
SHARD_WORDS = 1 << 20
#: Different runs of one anchor from which it is split by window.
HOT_RUNS = 2000
_PLACE = np.uint64((1 << 28) - 1)


def _with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash that tells apart rows of one id."""
    return docs.select("doc_id", F.xxhash64(F.col("text").isNull(), F.col("text")).alias("row_key"), "text")


def cut_runs(x: T.Texts) -> dict[str, np.ndarray]:
    """Runs of consecutive windows with one anchor: text, first window, windows, anchor, content."""
    words = x.word_hashes()
    first, counts = x.windows(ANCHOR)
    grams = T.word_window_hashes(words, first, ANCHOR)
    best = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach < _SPAN:
        step = min(reach, _SPAN - reach)
        best = np.minimum(best[: len(best) - step], best[step:]) if len(best) > step else best[:0]
        reach += step
    windows = np.maximum(x.n_words - WINDOW + 1, 0)
    base = np.cumsum(counts) - counts
    place = best[T.ranges(base, windows)] & _PLACE
    doc = np.repeat(np.arange(x.n), windows)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(place)))
    doc = doc[at]
    start = at - (np.cumsum(windows) - windows)[doc]
    begin = x.word_offsets[doc] + start
    content = T.SpanHash(words, T._WORD_BASE)(begin, begin + length + WINDOW - 1)
    return {"doc": doc, "first": start, "windows": length, "anchor": grams[place[at].astype(np.int64)], "content": content}


def _runs(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                found = cut_runs(T.Texts(part.column("text")))
                doc = pa.array(found["doc"])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(doc),
                        part.column("row_key").take(doc),
                        pa.array(found["first"].astype(np.int32)),
                        pa.array(found["windows"].astype(np.int16)),
                        pa.array(found["anchor"].view(np.int64)),
                        pa.array(found["content"].view(np.int64)),
                    ],
                    ["doc_id", "row_key", "first", "windows", "anchor", "content"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, row_key bigint, first int, windows smallint, anchor bigint, content bigint"
    )


def _pieces(located: DataFrame) -> DataFrame:
    """The words of each run that stands for its content; single windows for hot anchors.

    Rows that repeat a document follow one another, as the join sorts by its key; the first is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple | None = None
        for batch in batches:
            fresh = []
            for key in zip(batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), strict=True):
                fresh.append(key != seen)
                seen = key
            for part in T.slices(batch.filter(pa.array(fresh))):
                x = T.Texts(part.column("text"))
                words = x.word_hashes()
                spans = T.SpanHash(words, T._WORD_BASE)
                runs = part.column("runs")
                doc = np.repeat(np.arange(x.n), runs.value_lengths().to_numpy())
                flat = runs.flatten()
                field = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
                hot = field["hot"]
                each = np.where(hot, field["windows"], 1).astype(np.int64)
                owner = np.repeat(np.arange(len(doc)), each)
                place = T.ranges(np.zeros(len(doc), dtype=np.int64), each)
                begin = x.word_offsets[doc[owner]] + field["first"][owner] + place
                length = np.where(hot, 1, field["windows"])[owner].astype(np.int64) + WINDOW - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(field["anchor"][owner]),
                        pa.array(field["content"][owner]),
                        pa.array(place.astype(np.int32)),
                        pa.array(spans(begin, begin + length).view(np.int64)),
                        pa.array(hot[owner]),
                        pa.array(field["copies"][owner]),
                        T.binary_rows(words[T.ranges(begin, length)], np.append(0, np.cumsum(length))),
                    ],
                    ["anchor", "content", "place", "piece", "hot", "copies", "words"],
                )

    return located.mapInArrow(
        run, "anchor bigint, content bigint, place int, piece bigint, hot boolean, copies bigint, words binary"
    )


class FmIndex:
    """Backward search over a text of small integers, ordered by its first `depth` symbols.

    The BWT is stored as a wavelet matrix: per bit of the alphabet a bit vector of 64-bit words
    with counts of the ones before each word.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, depth: int) -> None:
        n, sigma = len(symbols), int(symbols.max()) + 1
        rank, order, reach = symbols.astype(np.int64), None, 1
        while order is None or reach < depth:
            shifted = np.zeros(n, dtype=np.int64)
            if order is not None:
                shifted[: n - reach] = rank[reach:] + 1
                reach *= 2
            keys = rank * (n + 2) + shifted
            order = np.argsort(keys, kind="stable")
            step = np.zeros(n, dtype=np.int64)
            step[1:] = keys[order[1:]] != keys[order[:-1]]
            ranks = np.cumsum(step)
            rank = np.empty(n, dtype=np.int64)
            rank[order] = ranks
            if ranks[-1] == n - 1:
                break
        bwt = symbols[order - 1]
        self.before = np.zeros(sigma + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=sigma), out=self.before[1:])
        self.weight = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(weights[order], out=self.weight[1:])
        self.levels = []
        current = bwt.astype(np.uint32)
        for shift in range(max(sigma - 1, 1).bit_length() - 1, -1, -1):
            ones = (current >> np.uint32(shift)) & np.uint32(1) == 1
            packed = np.zeros((n >> 6) + 1, dtype=np.uint64)
            packed.view(np.uint8)[: (n + 7) // 8] = np.packbits(ones, bitorder="little")
            counts = np.zeros(len(packed), dtype=np.int64)
            np.cumsum(np.bitwise_count(packed[:-1]), out=counts[1:])
            self.levels.append((shift, packed, counts, n - int(ones.sum())))
            current = np.concatenate([current[~ones], current[ones]])
        every = np.arange(sigma)
        self.base = self._descend(every, np.zeros(sigma, dtype=np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, packed, counts, zeros in self.levels:
            word = at >> 6
            inside = packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = counts[word] + np.bitwise_count(inside)
            at = np.where((symbol >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the matches with `symbol` put before them."""
        base = self.before[symbol] - self.base[symbol]
        return base + self._descend(symbol, low), base + self._descend(symbol, high)


def repeated_spans(lengths: np.ndarray, words: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per piece the first and the last window that occurs twice or more, -1 if none does.

    A piece has fewer than WINDOW windows, so all words from the first to the last window's end
    are covered.
    """
    n = len(lengths)
    _, ids = np.unique(words, return_inverse=True)
    ends = np.cumsum(lengths)
    start = ends - lengths
    symbols = np.zeros(len(words) + n, dtype=np.int64)  # 0 closes each piece
    piece = np.repeat(np.arange(n), lengths)
    symbols[np.arange(len(words)) + piece] = ids + 1
    index = FmIndex(symbols, np.repeat(copies, lengths + 1), WINDOW)
    begin = start + np.arange(n)
    windows = lengths - WINDOW + 1

    def unmatched(which: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Where the longest repeated suffix of a window is broken; -1 if all of it is repeated."""
        stop = np.full(len(which), -1, dtype=np.int64)
        active = np.arange(len(which))
        first = begin[which] + window
        low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), len(symbols))
        for back in range(WINDOW - 1, -1, -1):
            low, high = index.extend(symbols[first[active] + back], low, high)
            alive = index.weight[high] - index.weight[low] >= 2
            stop[active[~alive]] = window[active[~alive]] + back
            active, low, high = active[alive], low[alive], high[alive]
            if not len(active):
                break
        return stop

    head = np.full(n, -1, dtype=np.int64)
    which, window = np.arange(n), np.zeros(n, dtype=np.int64)
    while len(which):
        broken = unmatched(which, window)
        head[which[broken < 0]] = window[broken < 0]
        # Windows that hold the broken place and all behind it are not repeated either.
        which, window = which[broken >= 0], broken[broken >= 0] + 1
        left = window < windows[which]
        which, window = which[left], window[left]
    tail = head.copy()
    which = np.flatnonzero(head >= 0)
    window = windows[which] - 1
    while len(which):
        left = window > head[which]
        which, window = which[left], window[left]
        broken = unmatched(which, window)
        tail[which[broken < 0]] = window[broken < 0]
        which, window = which[broken >= 0], window[broken >= 0] - 1
    return head, tail


def _search(pieces: DataFrame) -> DataFrame:
    """Piece key and the repeated span of its words, for pieces that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[pa.RecordBatch]] = {}
        current = None

        def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            blob = rows.column("words").combine_chunks().cast(pa.large_binary())
            offsets = np.frombuffer(blob.buffers()[1], dtype=np.int64)[blob.offset : blob.offset + len(blob) + 1]
            data = np.frombuffer(blob.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint64)
            head, tail = repeated_spans(np.diff(offsets) // 8, data, rows.column("copies").to_numpy())
            hit = np.flatnonzero(head >= 0)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(rows.column("anchor").to_numpy()[hit]),
                    pa.array(rows.column("piece").to_numpy()[hit]),
                    pa.array(head[hit].astype(np.int32)),
                    pa.array((tail[hit] + WINDOW).astype(np.int32)),
                ],
                ["anchor", "piece", "span_start", "span_end"],
            )

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = np.append(0, np.flatnonzero(shard[1:] != shard[:-1]) + 1) if len(shard) else []
            for at, stop in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if current is not None and shard[at] != current:
                    yield close(shards.pop(current))
                current = int(shard[at])
                shards.setdefault(current, []).append(batch.slice(at, stop - at))
        if current is not None:
            yield close(shards.pop(current))

    return pieces.mapInArrow(run, "anchor bigint, piece bigint, span_start int, span_end int")


def repeated_intervals(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, row_key and the word intervals [start, end) to remove, as a list per row."""
    keyed = _with_key(docs)
    runs = work.save(_runs(keyed), "runs")
    # Written, so that both sides of the join are plain shuffles, whose hot partitions Spark splits.
    again = work.save(runs.df.groupBy("anchor").count().filter("count >= 2").select("anchor"), "again")
    flagged = work.save(runs.df.join(again.df, "anchor", "left_semi"), "flagged")
    work.drop(runs, again)
    contents = flagged.df.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row_key", "first", "windows")).alias("at")
    )
    hot = contents.groupBy("anchor").count().filter(F.col("count") > HOT_RUNS).select("anchor", F.lit(True).alias("hot"))
    located = (
        contents.join(hot, "anchor", "left")
        .groupBy(F.col("at.doc_id").alias("at_id"), F.col("at.row_key").alias("at_key"))
        .agg(
            F.collect_list(
                F.struct("at.first", "at.windows", "anchor", "content", "copies", F.coalesce("hot", F.lit(False)).alias("hot"))
            ).alias("runs")
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("row_key") == F.col("at_key"))
    found = _pieces(keyed.join(located, same).select("doc_id", "row_key", "text", "runs"))
    pieces = work.save(found, "pieces", words=F.sum(F.length("words") / 8).cast("long"))
    single = pieces.df.filter("NOT hot").select("anchor", "piece", "copies", "words")
    split = (
        pieces.df.filter("hot")
        .groupBy("piece")
        .agg(F.sum("copies").alias("copies"), F.first("words").alias("words"))
        .select(F.col("piece").alias("anchor"), "piece", "copies", "words")
    )
    count = max(1, -(-pieces.measures["words"] // SHARD_WORDS))
    dealt = single.unionByName(split).withColumn("shard", F.pmod("anchor", F.lit(count)))
    found = work.save(_search(dealt.repartition(count, "shard").sortWithinPartitions("shard")), "spans")
    spans = found.df
    whole = spans.select("anchor", F.col("piece").alias("content"), "span_start", "span_end")
    windows = (
        pieces.df.filter("hot")
        .select("anchor", "content", "place", "piece")
        .join(spans.filter("anchor = piece").select("piece"), "piece")
        .select("anchor", "content", F.col("place").alias("span_start"), (F.col("place") + WINDOW).alias("span_end"))
    )
    covered = whole.unionByName(windows)
    intervals = (
        flagged.df.join(covered, ["anchor", "content"])
        .groupBy("doc_id", "row_key")
        .agg(
            # A set, as rows that repeat an id and a text all bring the same spans.
            F.collect_set(
                F.struct((F.col("first") + F.col("span_start")).alias("start"), (F.col("first") + F.col("span_end")).alias("end"))
            ).alias("spans")
        )
    )
    intervals = work.save(intervals, "intervals").df
    work.drop(flagged, pieces, found)
    return intervals


def _joined(docs: DataFrame, spans: DataFrame) -> DataFrame:
    spans = spans.withColumnsRenamed({"doc_id": "_span_id", "row_key": "_span_key"})
    key = F.xxhash64(F.col("text").isNull(), F.col("text"))
    same = docs["doc_id"].eqNullSafe(F.col("_span_id")) & (key == F.col("_span_key"))
    return docs.join(spans, same, "left").drop("_span_id", "_span_key")


def _dropped(n_words: int, spans: list[dict]) -> np.ndarray:
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    return np.cumsum(edge)[:n_words] > 0


def removed_words(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, its words, how many are removed, and the digest of the kept ones."""
    work = Workspace(docs.sparkSession, "substrings")
    joined = _joined(docs.select("doc_id", "text"), repeated_intervals(docs, work))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept = words
                if spans:
                    kept = [w for w, gone in zip(words, _dropped(len(words), spans), strict=True) if not gone]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n_words, n_removed, digest = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def strip_documents(docs: DataFrame) -> DataFrame:
    """`docs` without the repeated words: each goes with the white space behind it.

    Texts without a repeated window stay as they are. `n_chars`, where it exists, follows the text.
    """
    work = Workspace(docs.sparkSession, "substrings")
    # The row travels as one column, so that no name of it can clash.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = _joined(docs.select("doc_id", "text", row), repeated_intervals(docs, work)).select("row", "spans")

    def strip(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            if spans:
                x = T.Texts(pa.array([text]))
                gone = np.flatnonzero(_dropped(len(x.start), spans))
                edge = np.zeros(len(x.data) + 1, dtype=np.int64)
                np.add.at(edge, x.start[gone], 1)
                np.add.at(edge, np.append(x.start[1:], len(x.data))[gone], -1)
                text = x.data[np.cumsum(edge)[:-1] == 0].tobytes().decode()
            out.append(text)
        return pa.array(out, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            at = docs_columns.index("text")
            columns[at] = strip(columns[at], batch.column("spans"))
            yield pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    stripped = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        length = F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
        stripped = stripped.withColumn("n_chars", length)
    return stripped
