"""Lexical retrieval packing of documents into token sequences.

Texts are tokenized and closed with one id. Every full window of a document is a sequence of its own; what is
left of it (or all of a short one) is a unit. Units are dealt to shards of about `SHARD_TOKENS`
tokens by content: a unit's place is `_DRAWS` of its terms, drawn by weighted min-hashing with their BM25 weights,
so two units agree in a draw as often as their weighted terms overlap. Shards are ranges of places that cut a
sample of all units evenly, so a hot term is split by the next draw and a hot text by a hash of the row.
Each shard builds an inverted index with BM25 weights over token ids; document
frequencies and the mean length are those of the whole documents. A seed's unused neighbours fill its window in the order of their
scores: those that fit stay whole, then the best of the others is cut to fill the window, and its rest is
the next seed. So all windows but the last of each shard are full.

Defined cases: a null text is an empty one and holds the closing id only; rows that repeat a document
are packed each; null ids are kept; longer texts than a shard are mostly full windows, which carry no
token ids, and a unit below one window. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.llm import text as T
from knitgraph.llm.arrays import summed_counts
from knitgraph.plans import Workspace

WINDOW = 4096
CLOSE = 2
SHARD_TOKENS = 1 << 20
#: What a unit counts besides its tokens, so that a shard of tiny units has a bounded number of them.
_UNIT_COST = 64
_DRAWS = 3
#: Units that are looked at for each shard, about, to cut the ranges.
_SAMPLED = 64
K1, B = 1.2, 0.75
#: Ids have 16 bits; the vocabulary must be smaller.
_IDS = 1 << 16
_CACHED_WORDS = 500_000
#: Runs of these before or behind letters are split off by the tokenizer.
_MARKS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


class WordTokenizer:
    """Token ids of texts, word by word: ids of a word do not depend on the words around it.

    True of tokenizers that split at white space and between letters and marks before they merge.
    New words of letters only are encoded together, as each gives one run of ids that ends
    with an end-of-word id; marks before and behind such a word are encoded apart; others go one by one.
    Words are kept in two generations, so that frequent ones stay when the rest is let go.
    """

    _kept: dict[str, WordTokenizer] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        if self._tokenizer.get_vocab_size() > _IDS:
            raise ValueError("the vocabulary has more than 65,536 entries")
        self._ends = np.zeros(_IDS, dtype=bool)
        for piece, i in self._tokenizer.get_vocab().items():
            self._ends[i] = piece.endswith("</w>")
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """The tokenizer of this process."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __call__(self, texts: list[bytes | None], closing: bytes = b"") -> list[np.ndarray]:
        """The ids of each text, with the ids `closing` (16-bit little-endian) behind them."""
        rows = [(text or b"").split() for text in texts]
        if len(self._young) > _CACHED_WORDS:
            self._old, self._young = self._young, {}
        known, old = self._young, self._old
        missing = set(chain.from_iterable(rows)).difference(known)
        again = missing.intersection(old)
        known.update((w, old[w]) for w in again)
        self._learn(missing - again)
        known[b""] = closing  # no word is empty
        return [np.frombuffer(b"".join(map(known.__getitem__, [*words, b""])), dtype=np.uint16) for words in rows]

    def _learn(self, words: set[bytes]) -> None:
        plain = [w for w in words if w.isalpha()]
        lower = [w.lower() for w in plain]
        marked, single = [], []
        for w in words.difference(plain):
            rest = w.lstrip(_MARKS)
            stem = rest.rstrip(_MARKS)
            if stem.isalpha() or (stem and not stem.isascii() and _only_letters(stem.decode())):
                marked.append((w, w[: len(w) - len(rest)], stem.lower(), rest[len(stem) :]))  # bytes: A-Z only
            else:
                single.append(w)
        stems = list(dict.fromkeys(chain(lower, (stem for _, _, stem, _ in marked))))
        lines = [stems[at : at + 512] for at in range(0, len(stems), 512)]
        ids: list[bytes] = []
        for line, found in zip(lines, self._encode([b" ".join(line).decode() for line in lines]), strict=True):
            stop = np.flatnonzero(self._ends[found]) + 1
            if len(stop) != len(line):
                raise ValueError("the tokenizer does not end each word with one end-of-word id")
            blob, cuts = found.tobytes(), (2 * stop).tolist()
            ids += [blob[a:b] for a, b in zip([0, *cuts], cuts)]
        of_stem = dict(zip(stems, ids, strict=True))
        self._young.update(zip(plain, map(of_stem.__getitem__, lower), strict=True))
        marks = list({m for _, head, _, tail in marked for m in (head, tail)})
        of = {m: e.tobytes() for m, e in zip(marks, self._encode([m.decode() for m in marks]), strict=True)}
        self._young.update((w, of[head] + of_stem[stem] + of[tail]) for w, head, stem, tail in marked)
        self._young.update((w, e.tobytes()) for w, e in zip(single, self._encode([w.decode() for w in single]), strict=True))

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint16) for e in found]


def _only_letters(word: str) -> bool:
    """Whether the word stays one run of letters when it is composed and made lower case."""
    return word.isalpha() and word.lower().isalpha() and unicodedata.is_normalized("NFC", word)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _units(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Full windows (without ids) and units (with ids) of every row; a first full window has the terms of its document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer.of(tokenizer)
        for batch in batches:
            copies: dict = {}  # rows that repeat an id within a batch go to different shards
            for part in T.slices(batch):
                out: list[tuple] = []
                encoded = encode(part.column("text").cast(pa.binary()).to_pylist(), np.uint16(CLOSE).tobytes())
                for place, (key, ids) in enumerate(zip(part.column("doc_id").to_pylist(), encoded, strict=True)):
                    copy = copies[key] = copies.get(key, -1) + 1
                    full = len(ids) // WINDOW * WINDOW
                    for at in range(0, full, WINDOW):
                        terms = None if at else np.unique(ids).tobytes()
                        out.append((place, copy, at, WINDOW, ids_crc32(ids[at : at + WINDOW]), len(ids), None, terms))
                    if full < len(ids):
                        out.append((place, copy, full, len(ids) - full, None, len(ids), ids[full:].tobytes(), None))
                place, copy, start, length, crc, total, ids, terms = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(place)),
                        pa.array(copy, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(total, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(terms, pa.binary()),
                    ],
                    ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "ids", "terms"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, copy int, start long, length long, ids_crc32 long, doc_tokens long, ids binary, terms binary"
    )


def distinct_terms(units: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, term, occurrences) of the distinct terms of each unit, in order."""
    lengths = np.array([len(u) for u in units])
    kind = np.uint32 if len(units) <= 1 << 16 else np.uint64
    keys = np.repeat(np.arange(len(units), dtype=kind), lengths) << kind(16)
    keys |= np.concatenate(units)
    keys.sort()
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[start] >> kind(16)).astype(np.int64), keys[start].astype(np.uint16), np.diff(np.append(start, len(keys)))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    counts = np.zeros(_IDS, dtype=np.int64)
    for batch in batches:
        units = [np.frombuffer(ids, dtype=np.uint16) for ids in batch.column("ids").to_pylist()]
        for at in range(0, len(units), 500):
            counts += np.bincount(distinct_terms(units[at : at + 500])[1], minlength=_IDS)
    return counts.reshape(1, -1)


def _bm25(
    units: list[np.ndarray], weight_of_term: np.ndarray, mean_length: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, term, weight) of the terms that have a weight, in order."""
    lengths = np.array([len(u) for u in units])
    unit, term, counts = distinct_terms(units)
    # Terms of half of all documents or more have no weight, so they need no postings.
    useful = weight_of_term[term] > 0
    unit, term, counts = unit[useful], term[useful], counts[useful]
    return unit, term, weight_of_term[term] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * lengths[unit] / mean_length))


def content_places(units: list[np.ndarray], weight_of_term: np.ndarray, mean_length: float) -> np.ndarray:
    """Per unit the terms drawn by weighted min-hashing, 16 bits each, above 16 free bits."""
    unit, term, weight = _bm25(units, weight_of_term, mean_length)
    out = np.zeros(len(units), dtype=np.uint64)
    if not len(unit):
        return out
    first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(unit))))
    for draw in range(_DRAWS):
        spread = T.mix(np.arange(draw * _IDS + 1, (draw + 1) * _IDS + 1, dtype=np.uint64))
        wait = -np.log((spread.astype(np.float64) + 1) / 2.0**64.0 * (1 - 1e-12))[term] / weight
        least = np.flatnonzero(wait == np.minimum.reduceat(wait, first)[owner])
        _, chosen = np.unique(owner[least], return_index=True)
        out[unit[first]] |= term[least[chosen]].astype(np.uint64) << np.uint64(16 * (_DRAWS - draw))
    return out


def _placed(units: DataFrame, weight_of_term: np.ndarray, mean_length: float, bounds: np.ndarray | None) -> DataFrame:
    """`units` with their places or, where the bounds of the shards are given, with their shards."""
    shared = units.sparkSession.sparkContext.broadcast((weight_of_term, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        for batch in batches:
            place = batch.column("row_hash").to_numpy().view(np.uint64).copy()
            blobs = batch.column("ids").to_pylist()
            whole = np.array([b is None for b in blobs], dtype=bool)
            with_ids = np.flatnonzero(~whole)
            for at in range(0, len(with_ids), 500):
                some = with_ids[at : at + 500]
                terms = content_places([np.frombuffer(blobs[i], dtype=np.uint16) for i in some], weights, mean_length)
                place[some] = terms | place[some] & np.uint64(0xFFFF)
            if cuts is None:
                yield pa.RecordBatch.from_arrays([batch.column("length"), pa.array(place.view(np.int64))], ["length", "place"])
                continue
            shard = np.searchsorted(cuts, place, side="right")
            shard[whole] = (place[whole] % np.uint64(len(cuts) + 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int64())], [*batch.schema.names, "shard"])

    if bounds is None:
        return units.select("length", "ids", "row_hash").mapInArrow(run, "length long, place long")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInArrow(run, f"{fields}, shard long")


def _shard_bounds(units: DataFrame, n: int, shards: int, weight_of_term: np.ndarray, mean_length: float) -> np.ndarray:
    """The first places of all shards but one, from a sample of bounded size that hashes of the rows choose."""
    if shards == 1:
        return np.zeros(0, dtype=np.uint64)
    share = min(1.0, max(_SAMPLED * shards, 2000) / n)
    sample = units.filter("ids IS NOT NULL").filter(F.pmod(F.xxhash64("row_hash"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = _placed(sample, weight_of_term, mean_length, None).toArrow()
    place = rows.column("place").to_numpy().view(np.uint64)
    cost = rows.column("length").to_numpy() + _UNIT_COST
    order = np.lexsort((cost, place))
    if not len(order):
        return np.zeros(0, dtype=np.uint64)
    sums = np.cumsum(cost[order])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, shards) / shards)
    return place[order][at]


class Bm25Index:
    """Postings of the units of one shard: per term the units that hold it and their weights."""

    def __init__(self, units: list[np.ndarray], weight_of_term: np.ndarray, mean_length: float) -> None:
        unit, term, weight = _bm25(units, weight_of_term, mean_length)
        order = np.argsort(term, kind="stable")
        self._unit, self._weight, self._n = unit[order], weight[order], len(units)
        self._start = np.searchsorted(term[order], np.arange(_IDS + 1))
        self._terms, self._term_start = term, np.searchsorted(unit, np.arange(len(units) + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self._terms[self._term_start[seed] : self._term_start[seed + 1]].astype(np.int64)
        at = T.ranges(self._start[terms], self._start[terms + 1] - self._start[terms])
        return np.bincount(self._unit[at], self._weight[at], minlength=self._n)


def fill_windows(units: list[np.ndarray], index: Bm25Index) -> Iterator[list[tuple[int, int, int]]]:
    """Windows as lists of (unit, from, to); every id of every unit lies in exactly one."""
    length = np.array([len(u) for u in units])
    unused = np.ones(len(units), dtype=bool)
    carried, begin, following = None, 0, 0
    while True:
        if carried is None:
            while following < len(units) and not unused[following]:
                following += 1
            if following == len(units):
                return
            seed, begin = following, 0
            unused[seed] = False
        else:
            seed = carried
        window = [(seed, begin, int(length[seed]))]
        space = WINDOW - (int(length[seed]) - begin)
        carried = None
        scores = np.where(unused, index.scores(seed), -1.0)
        ranked = np.argsort(-scores, kind="stable")[: int(unused.sum())]
        wide = length[ranked]
        best = int(ranked[np.argmax(wide > space)]) if (wide > space).any() else None
        at = 0
        while space:
            fits = wide[at:] <= space
            step = int(np.argmax(fits)) if len(fits) else 0
            if not len(fits) or not fits[step]:
                break
            unit, at = int(ranked[at + step]), at + step + 1
            window.append((unit, 0, int(length[unit])))
            unused[unit] = False
            space -= int(length[unit])
        if space and best is None:  # all that is left was passed by before the window was this full
            left = ranked[unused[ranked]]
            best = int(left[0]) if len(left) else None
        if space and best is not None:
            window.append((best, 0, space))
            unused[best] = False
            carried, begin = best, space
        yield window


def _pack(shards: DataFrame, weight_of_term: np.ndarray, mean_length: float) -> DataFrame:
    shared = shards.sparkSession.sparkContext.broadcast(weight_of_term)

    def close(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        start, total, crc, blobs = (rows.column(c).to_pylist() for c in ("start", "doc_tokens", "ids_crc32", "ids"))
        base, out = shard << 32, []
        whole = [i for i, b in enumerate(blobs) if b is None]
        for number, i in enumerate(whole):
            out.append((i, start[i], WINDOW, crc[i], total[i], base + number, 0))
        cut = [i for i, b in enumerate(blobs) if b is not None]
        if cut:
            units = [np.frombuffer(blobs[i], dtype=np.uint16) for i in cut]
            index = Bm25Index(units, shared.value, mean_length)
            for number, window in enumerate(fill_windows(units, index), len(whole)):
                offset = 0
                for unit, at, stop in window:
                    i = cut[unit]
                    out.append((i, start[i] + at, stop - at, ids_crc32(units[unit][at:stop]), total[i], base + number, offset))
                    offset += stop - at
        place, *values = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id").combine_chunks().take(pa.array(place)), *[pa.array(v, pa.int64()) for v in values]],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = np.append(0, np.flatnonzero(shard[1:] != shard[:-1]) + 1) if len(shard) else []
            for at, stop in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if held and shard[at] != current:
                    yield close(current, held)
                    held = []
                current = int(shard[at])
                held.append(batch.slice(at, stop - at))
        if held:
            yield close(current, held)

    kind = shards.schema["doc_id"].dataType.simpleString()
    return shards.mapInArrow(
        run,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece; `tokenizer` is the path of a tokenizers file that every executor can read."""
    work = Workspace(docs.sparkSession, "packing")
    units = work.save(
        _units(docs, tokenizer), "units",
        units=F.count("ids"), tokens=F.sum(F.when(F.col("ids").isNotNull(), F.col("length"))),
        documents=F.count(F.when(F.col("start") == 0, 1)), all_tokens=F.sum("length"),
    )
    n, tokens, documents = (units.measures[k] for k in ("units", "tokens", "documents"))
    terms = units.df.filter("start = 0").select(F.coalesce("terms", "ids").alias("ids"))
    df = summed_counts(terms, _document_frequencies, 1, _IDS)[0]
    weight = np.where(df > 0, np.maximum(np.log((documents - df + 0.5) / (df + 0.5)), 0), 0)
    mean_length = units.measures["all_tokens"] / max(documents, 1)
    shards = max(1, -(-(tokens + _UNIT_COST * n) // SHARD_TOKENS))
    row = [F.col("doc_id").isNull(), "doc_id", "start", "copy"]
    keyed = units.df.drop("terms").withColumn("row_hash", F.xxhash64(*row))
    # A term of one document brings no neighbours, so it is no place.
    shared_weight = np.where(df > 1, weight, 0)
    bounds = _shard_bounds(keyed, n, shards, shared_weight, mean_length)
    dealt = _placed(keyed, shared_weight, mean_length, bounds).repartition(shards, "shard")
    return _pack(dealt.sortWithinPartitions("shard", "row_hash", *row[1:]), weight, mean_length)
