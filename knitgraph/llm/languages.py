"""Language identification as inference of a mixture.

A language is a distribution over hashed byte trigrams of words (A-Z lower-cased, with word
edges); it is counted on all training rows. A document is a mixture of languages: each word comes from one
language, and expectation-maximisation estimates the proportions from the words' trigram
likelihoods. The languages of a document are the prefix, in the order of proportion, of greatest
log-likelihood minus `PENALTY` * log(words) a language; the proportions are then those of a
mixture of that set, and the largest one is the prediction.

Defined cases: a null text and one without a letter is `und` with score 0; rows without a language or
text teach nothing; if nothing is learned every text is `und`; repeated rows each get a row. `lang` is
read from training rows only, other columns never.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.llm import text as T
from knitgraph.llm.arrays import summed_counts

BUCKETS = 1 << 16
#: Languages that a model can hold.
MAX_LANGUAGES = 500
ROUNDS = 12
REFITS = 4
PENALTY = 1.5
SMOOTHING = 0.2
UNDETERMINED = "und"

_LETTER = T.table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_ASCII_LETTER = T.table(bytes(range(65, 91)) + bytes(range(97, 123)))


class Trigrams:
    """Runs of letters of a slice of texts, and the trigram bucket of each of their bytes."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.offsets = T.buffers(column)
        data, self.n = T.lower(self.data), len(self.offsets) - 1
        inside = _LETTER[data]
        cuts = self.offsets[self.offsets < len(data)]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        first[cuts] = inside[cuts]
        last[:-1] &= ~inside[1:]
        last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
        before, after = np.zeros(len(data), np.uint64), np.zeros(len(data), np.uint64)
        before[1:], after[:-1] = data[:-1], data[1:]
        before[first], after[last] = 0, 0
        keys = (before << np.uint64(16) | data.astype(np.uint64) << np.uint64(8) | after)[inside]
        self.buckets = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
        place = np.cumsum(inside) - 1
        self.word_start = place[first]
        self.doc = np.searchsorted(self.offsets, np.flatnonzero(first), side="right") - 1


def _has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_ASCII_LETTER[data], out=sums[1:])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # (languages, BUCKETS), float32

    def _words(self, x: Trigrams) -> np.ndarray:
        """Likelihood of each word in each language, scaled so that the largest is 1; and the scale."""
        parts = [np.add.reduceat(row[x.buckets], x.word_start) for row in self.log_likelihood]
        logs = np.stack(parts, axis=1).astype(np.float64)
        top = logs.max(axis=1, keepdims=True)
        return np.exp(logs - top)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: place of the predicted language (-1: none), its share, size of the set."""
        x = Trigrams(column)
        k = len(self.languages)
        chosen, share, size = np.full(x.n, -1), np.zeros(x.n), np.zeros(x.n, dtype=np.int64)
        if not k or not len(x.word_start):
            return chosen, share, size
        words = self._words(x)
        docs, head, count = np.unique(x.doc, return_index=True, return_counts=True)
        inside = np.repeat(np.arange(len(docs)), count)
        mixture = _estimate(words, inside, head, count, np.full((len(docs), k), 1 / k), ROUNDS)
        order = np.argsort(-mixture, axis=1, kind="stable")
        value, best = np.full(len(docs), -np.inf), mixture.copy()
        taken = np.ones(len(docs), dtype=np.int64)
        sets = np.zeros((len(docs), k), dtype=bool)
        # Languages without the weight of a word cannot pay for themselves.
        widest = np.maximum((mixture * count[:, None] >= 0.5).sum(axis=1), 1)
        for s in range(1, int(widest.max()) + 1):
            sets[np.arange(len(docs)), order[:, s - 1]] = True
            some = np.flatnonzero(widest >= s)
            rows = np.isin(inside, some) if len(some) < len(docs) else slice(None)
            part, n = words[rows], count[some]
            base = np.cumsum(n) - n
            owner = np.repeat(np.arange(len(some)), n)
            start = np.where(sets[some], mixture[some] + 1e-12, 0)
            start /= start.sum(axis=1, keepdims=True)
            fitted = _estimate(part, owner, base, n, start, REFITS if s > 1 else 0)
            fit = np.add.reduceat(np.log((part * fitted[owner]).sum(axis=1) + 1e-300), base)
            fit -= PENALTY * np.log(n + 1) * s
            better = fit > value[some]
            value[some[better]], best[some[better]], taken[some[better]] = fit[better], fitted[better], s
        chosen[docs] = best.argmax(axis=1)
        share[docs] = np.clip(best.max(axis=1), 0, 1)
        size[docs] = taken
        none = ~_has_letter(column, x.data, x.offsets)
        chosen[none], share[none], size[none] = -1, 0, 0
        return chosen, share, size


def _estimate(words: np.ndarray, owner: np.ndarray, head: np.ndarray, count: np.ndarray, mixture: np.ndarray, rounds: int) -> np.ndarray:
    """Expectation-maximisation of the proportions of each document."""
    for _ in range(rounds):
        weighted = words * mixture[owner]
        weighted /= weighted.sum(axis=1, keepdims=True) + 1e-300
        mixture = np.add.reduceat(weighted, head, axis=0) / count[:, None]
    return mixture


def fit(docs: DataFrame) -> Model:
    """Count trigrams by `lang` on all rows of `docs` that have a text and a language."""
    taught = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    found = sorted(r["lang"] for r in taught.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return Model([], np.zeros((0, BUCKETS), dtype=np.float32))
    place = {lang: i for i, lang in enumerate(found)}

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        counts = np.zeros(len(found) * BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in T.slices(batch):
                x = Trigrams(part.column("text"))
                lang = np.array([place[v] for v in part.column("lang").to_pylist()])
                per_word = np.diff(np.append(x.word_start, len(x.buckets)))
                row = np.repeat(lang[x.doc], per_word) if len(x.doc) else np.zeros(0, np.int64)
                at, n = np.unique(row * BUCKETS + x.buckets, return_counts=True)
                counts[at] += n
        return counts.reshape(len(found), BUCKETS)

    counts = summed_counts(taught, count, len(found), BUCKETS) + SMOOTHING
    return Model(found, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and the number of languages of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, UNDETERMINED])
        for batch in batches:
            for part in T.slices(batch):
                chosen, share, size = shared.value.predict(part.column("text"))
                chosen = np.where(chosen < 0, len(names) - 1, chosen)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), names.take(pa.array(chosen)), pa.array(share), pa.array(size)],
                    ["doc_id", "lang_pred", "score", "n_languages"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, n_languages bigint"
    )
