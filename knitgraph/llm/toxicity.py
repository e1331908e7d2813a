"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence scores a logistic model over hashed features of its words (the word and its first 4, 5
and 6 bytes, lower-cased); a document's score is the noisy-or 1 - prod(1 - p) of its sentences. Only
document labels are known: the model is trained through the noisy-or, so the sentences that
explain a toxic label are found by training, and are returned as located sentences afterwards.

The model is trained on at most `FIT_ROWS` labelled texts, chosen by a hash; texts that rows of one id repeat
are one with a weight. Features
are the `FEATURES` hash buckets whose presence differs most between their toxic and other documents.

Defined cases: null and empty texts have no sentence and score `PRIOR`; null labels are ignored, of
several labels of one document the largest counts; repeated rows each get a score; without labels of
both kinds, or without a word that tells them apart, every text scores `PRIOR`. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knitgraph.llm import text as T
from knitgraph.llm.arrays import summed_counts
from knitgraph.plans import Staged, Workspace

BUCKETS = 1 << 18
FEATURES = 1024
#: Labelled texts used for training, at most.
FIT_ROWS = 20_000
#: Labelled training documents that must hold a feature.
MIN_DOCUMENTS = 3
PREFIXES = (4, 5, 6)
ROUNDS = 200
#: Score of a text without a sentence.
PRIOR = 0.01
#: Documents count as toxic from this score on.
CUT = 0.3

_LETTER = T.table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_STOP = T.table(b".!?\n")


class Sentences:
    """Words (runs of letters) of a slice of texts, with their sentences.

    Sentences end at . ! ? or a line break; only those with a word count.
    """

    def __init__(self, column: pa.Array) -> None:
        data, offsets = T.buffers(column)
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        inside = _LETTER[data]
        cuts = offsets[offsets < len(data)]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = cuts[cuts > 0] - 1
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        stops = np.cumsum(_STOP[data], dtype=np.int64)
        place = stops[self.start] if len(data) else np.zeros(0, dtype=np.int64)
        new = np.ones(len(self.start), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.first_word = np.flatnonzero(new)
        self.sentence = np.cumsum(new) - 1
        self.sentence_doc = self.doc[self.first_word]

    def features(self) -> list[np.ndarray]:
        """One array of hash buckets per kind of feature; -1 where a word has none."""
        hashed = T.SpanHash(T._BYTE_VALUES[T.lower(self.data)], T._BYTE_BASE)
        out = [hashed(self.start, self.end)]
        for k in PREFIXES:
            stop = np.minimum(self.start + k, self.end)
            out.append(hashed(self.start, stop) + np.uint64(k))
        found = [(T.mix(h) & np.uint64(BUCKETS - 1)).astype(np.int64) for h in out]
        for k, column in zip(PREFIXES, found[1:], strict=True):
            column[self.end - self.start <= k] = -1
        return found


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # by bucket
    bias: float
    trained: bool = True

    def sentence_scores(self, x: Sentences) -> np.ndarray:
        if not len(x.start):
            return np.zeros(0)
        words = np.zeros(len(x.start))
        for column in x.features():
            words += np.where(column >= 0, self.weights[column], 0.0)
        logits = self.bias + np.add.reduceat(words, x.first_word)
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))

    def document_scores(self, x: Sentences, sentences: np.ndarray) -> np.ndarray:
        spared = np.bincount(x.sentence_doc, np.log1p(-np.minimum(sentences, 1 - 1e-9)), minlength=x.n)
        empty = np.bincount(x.sentence_doc, minlength=x.n) == 0
        return np.where(empty | (not self.trained), PRIOR, 1 - np.exp(spared))


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; of the empty text for a null id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def _labelled(docs: DataFrame, labels: DataFrame, work: Workspace) -> Staged:
    """At most FIT_ROWS labelled texts of `docs` with their weights, those of the smallest hashes.

    The chosen ids have a proven bound and are broadcast, so that only their texts are shuffled. Rows that repeat
    an id and text are one; if an id still has many texts, the texts of the smallest hashes stay.
    """
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("label")
    )
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, 2 * FIT_ROWS / max(marked.count(), 1))
    chosen = marked.filter(place <= int(share * (1 << 40))).orderBy(place, "doc_id").limit(FIT_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    weighted = rows.groupBy("doc_id", "text", "label").agg(F.count(F.lit(1)).alias("weight"))
    staged = work.save(weighted.withColumn("place", F.xxhash64("doc_id", "text")), "labelled")
    if staged.rows <= FIT_ROWS:
        return staged
    last = staged.df.select("place").orderBy("place").limit(FIT_ROWS).agg(F.max("place")).first()[0]
    kept = work.save(staged.df.filter(F.col("place") <= last), "labelled")
    work.drop(staged)
    return kept


def _document_counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """In how many clean and toxic documents each bucket occurs, by weight."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for part in T.slices(batch):
            x = Sentences(part.column("text"))
            label = part.column("label").to_numpy().astype(np.int64)
            weight = part.column("weight").to_numpy()
            keys = [x.doc[c >= 0] * BUCKETS + c[c >= 0] for c in x.features()]
            keys = np.unique(np.concatenate(keys))
            np.add.at(counts, (label[keys // BUCKETS], keys % BUCKETS), weight[keys // BUCKETS])
    return counts


def choose_features(labelled: DataFrame) -> np.ndarray:
    counts = summed_counts(labelled, _document_counts, 2, BUCKETS)
    totals = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        return np.zeros(0, dtype=np.int64)
    gap = counts[1] / toxic - counts[0] / clean
    spread = np.sqrt((counts[0] + counts[1] + 1) / (clean + toxic) * (1 / clean + 1 / toxic))
    strength = np.abs(gap) / spread
    strength[counts.sum(axis=0) < MIN_DOCUMENTS] = 0
    best = np.argsort(-strength, kind="stable")[:FEATURES]
    return np.sort(best[strength[best] > 3])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on labelled rows of `docs`; the caller leaves out what is held out."""
    work = Workspace(docs.sparkSession, "toxicity")
    staged = _labelled(docs, labels, work)
    labelled = staged.df
    chosen = choose_features(labelled)
    if not len(chosen):
        work.drop(staged)
        return Model(np.zeros(BUCKETS), -20.0, trained=False)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chosen)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document the (sentence, feature) pairs that it holds."""
        place = np.full(BUCKETS, -1, dtype=np.int64)
        place[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            for part in T.slices(batch):
                x = Sentences(part.column("text"))
                pairs = []
                for column in x.features():
                    kept = np.flatnonzero((column >= 0) & (place[column] >= 0))
                    pairs.append(np.column_stack([x.sentence[kept], place[column[kept]]]))
                pairs = np.unique(np.concatenate(pairs), axis=0) if len(x.start) else np.zeros((0, 2), int)
                head = np.searchsorted(x.sentence_doc, np.arange(x.n + 1))
                ends = np.searchsorted(pairs[:, 0], head)
                local = pairs - np.column_stack([np.repeat(head[:-1], np.diff(ends)), np.zeros(len(pairs), int)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("place"),
                        part.column("label"),
                        part.column("weight"),
                        pa.array(np.diff(head)),
                        T.binary_rows(local.astype(np.int32).reshape(-1), ends * 2),
                    ],
                    ["place", "label", "weight", "sentences", "pairs"],
                )

    schema = "place long, label int, weight long, sentences long, pairs binary"
    # Texts are split by all tasks; the pairs of at most FIT_ROWS texts, in an order of their own, are fitted by one.
    pairs = labelled.mapInArrow(bags, schema).repartition(1).sortWithinPartitions("place", "label", "sentences", "pairs")
    fitted = pairs.mapInArrow(_fit_bags(len(chosen)), "weights binary, bias double")
    row = fitted.first()
    work.drop(staged)
    weights, bias = np.frombuffer(row["weights"]), row["bias"]
    full = np.zeros(BUCKETS)
    full[chosen] = weights
    return Model(full, bias)


def _fit_bags(width: int):  # noqa: ANN202
    """Gradient steps (with per-weight scaling) on the likelihood of the noisy-or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, weight, sentences, owner, feature, base = [], [], [], [], [], 0
        for batch in batches:
            label.append(batch.column("label").to_numpy())
            weight.append(batch.column("weight").to_numpy())
            counts = batch.column("sentences").to_numpy()
            for n, pairs in zip(counts, batch.column("pairs").to_pylist(), strict=True):
                at = np.frombuffer(pairs, dtype=np.int32).reshape(-1, 2)
                owner.append(at[:, 0] + base)
                feature.append(at[:, 1])
                base += int(n)
            sentences.append(counts)
        weights, bias = np.zeros(width), -4.0
        if label:
            y, n = np.concatenate(label).astype(float), np.concatenate(sentences)
            doc = np.repeat(np.arange(len(y)), n)
            owner, feature = np.concatenate(owner), np.concatenate(feature)
            weights, bias = _descend(y, np.concatenate(weight), doc, owner, feature, width)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [float(bias)]})

    return run


def _descend(
    y: np.ndarray, weight: np.ndarray, doc: np.ndarray, owner: np.ndarray, feature: np.ndarray, width: int
) -> tuple[np.ndarray, float]:
    weights = np.zeros(width + 1)
    weights[width] = -4.0
    moment, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, ROUNDS + 1):
        logits = weights[width] + np.bincount(owner, weights[feature], minlength=len(doc))
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        spared = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y))
        score = np.clip(-np.expm1(spared), 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: p for a clean bag, -(1 - P) / P * p for a toxic one.
        pull = np.where(y > 0, -(1 - score) / score, 1.0) * weight / weight.sum()
        slope = pull[doc] * p
        gradient = np.append(np.bincount(feature, slope[owner], minlength=width), slope.sum())
        gradient[:width] += 1e-5 * weights[:width]
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        weights -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return weights[:width], weights[width]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the score of every row, and the place (in bytes of the UTF-8 text) of its worst sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                x = Sentences(part.column("text"))
                p = shared.value.sentence_scores(x)
                score = shared.value.document_scores(x, p)
                order = np.lexsort((np.arange(len(p)), -p, x.sentence_doc))
                docs_with, at = np.unique(x.sentence_doc[order], return_index=True)
                worst = order[at]
                words = np.append(x.first_word, len(x.start))
                begin, stop = np.full(x.n, -1), np.full(x.n, -1)
                begin[docs_with] = x.start[x.first_word[worst]] - x.offsets[docs_with]
                stop[docs_with] = x.end[words[worst + 1] - 1] - x.offsets[docs_with]
                none = begin < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(score),
                        pa.array((score >= CUT).astype(np.int32)),
                        pa.array(begin, mask=none),
                        pa.array(stop, mask=none),
                    ],
                    ["doc_id", "score", "predicted", "worst_start", "worst_end"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, worst_start bigint, worst_end bigint"
    )


def offending_sentences(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """doc_id, byte span and score of every sentence that scores at least `cut`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                x = Sentences(part.column("text"))
                p = shared.value.sentence_scores(x)
                hit = np.flatnonzero(p >= cut)
                words = np.append(x.first_word, len(x.start))
                base = x.offsets[x.sentence_doc[hit]]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(x.sentence_doc[hit])),
                        pa.array(x.start[x.first_word[hit]] - base),
                        pa.array(x.end[words[hit + 1] - 1] - base),
                        pa.array(p[hit]),
                    ],
                    ["doc_id", "start", "end", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, end bigint, score double")


def keep_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` below the cut, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                x = Sentences(part.column("text"))
                score = shared.value.document_scores(x, shared.value.sentence_scores(x))
                yield part.filter(pa.array(score < CUT))

    return docs.mapInArrow(run, docs.schema)
