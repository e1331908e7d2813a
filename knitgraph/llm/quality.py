"""Quality rules: rule statistics of whole texts, and an isolation forest over them.

The statistics are exact per document. A forest of random splits is grown on a bounded sample
of labelled rows (`SAMPLE_ROWS`, chosen by a hash of their ids); documents that random splits
isolate after short paths are anomalous. The score from which a document is rejected is
calibrated on the score histogram of all labelled rows.

Defined cases: a null or empty text has no words, all statistics 0 and fails the base rule; a
document that occurs twice gets two rows; labels that are null are ignored, of several labels of
one document the smallest counts; without both kinds of labels only the base rule rejects. Other
columns are neither read nor changed, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.llm import text as T
from knitgraph.plans import Workspace

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SAMPLE_ROWS = 8192
TREES = 100
TREE_ROWS = 256
DEPTH = 8
PRIOR_WORDS = 40
PRIOR_LENGTH = 6
PRIOR_LINES = 8
#: Share of the labelled good rows that calibration may reject.
MAX_GOOD_REJECTED = 0.002
_BINS = 2048

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = [
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "word_length",
    "letterless_share",
    "echo_share",
]
_STATS_SCHEMA = ", ".join(f"{c} bigint" for c in BASE) + ", " + ", ".join(f"{c} double" for c in RATIOS)

_SYMBOLS = T.table(b"#*$%&|<>")
_UPPER = T.table(bytes(range(65, 91)))
_LETTER = T.table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_HEAD = ~T.table(bytes(range(0x80, 0xC0)))


def text_statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The rule statistics of every text of a column."""
    x = T.Texts(column)
    words = x.word_hashes()
    doc = x.doc_of_word()

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[x.offsets[1:]] - sums[x.offsets[:-1]]

    def per_text_words(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=x.n)

    lines, dup_lines = _lines(x)
    repeated = _repeated_words(x, words)
    letters = np.zeros(len(x.data) + 1, dtype=np.int64)
    np.cumsum(_LETTER[x.data], out=letters[1:])
    echo = np.zeros(len(words), dtype=bool)
    echo[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    n_words = x.n_words.astype(np.int64)
    chars = per_text(x.inside & _HEAD[x.data])
    symbols = per_text(_SYMBOLS[x.data])
    # Added counts keep the shares of short texts, which a few words can move, near the usual.
    per_char, per_word = chars + PRIOR_WORDS * PRIOR_LENGTH, n_words + PRIOR_WORDS
    n_repeat = per_text_words(repeated)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols,
        "n_dup_lines": dup_lines,
        "n_repeat_words": n_repeat,
        "symbol_share": symbols / per_char,
        "dup_line_share": dup_lines / (lines + PRIOR_LINES),
        "repeat_share": n_repeat / per_word,
        "upper_share": per_text(_UPPER[x.data]) / per_char,
        "word_length": np.log(per_char / per_word),
        "letterless_share": per_text_words(letters[x.end] == letters[x.start]) / per_word,
        "echo_share": per_text_words(echo) / per_word,
    }


def _lines(x: T.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines that have a word, and those equal to an earlier line."""
    breaks = np.flatnonzero(x.data == 10)
    start = np.sort(np.concatenate([x.offsets[:-1], breaks + 1]), kind="stable")
    # A break belongs to the text that holds it; the end of a text closes its last line.
    end = np.sort(np.concatenate([breaks, x.offsets[1:]]), kind="stable")
    worded = np.searchsorted(x.start, end) > np.searchsorted(x.start, start)
    start, end = start[worded], end[worded]
    doc = np.searchsorted(x.offsets, start, side="right") - 1
    lines = np.bincount(doc, minlength=x.n)
    keys = T.mix(x.span_hashes(start, end) + T.mix(doc.astype(np.uint64)))
    _, first = np.unique(keys, return_index=True)
    return lines, lines - np.bincount(doc[first], minlength=x.n)


def _repeated_words(x: T.Texts, words: np.ndarray) -> np.ndarray:
    """Marks each word of a window that the same text holds twice or more."""
    first, counts = x.windows(WINDOW)
    doc = np.repeat(np.arange(x.n, dtype=np.uint64), counts)
    keys = T.word_window_hashes(words, first, WINDOW) + T.mix(doc)
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    edge = np.zeros(len(words) + WINDOW + 1, dtype=np.int64)
    if len(again):
        at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
        hit = first[again[at] == keys]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
    return np.cumsum(edge)[: len(words)] > 0


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    n = stats["n_words"]
    return (n < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * n)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                stats = text_statistics(part.column("text"))
                columns = [part.column("doc_id")] + [pa.array(stats[c]) for c in BASE + RATIOS]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *BASE, *RATIOS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_STATS_SCHEMA}")


@dataclass(frozen=True)
class Forest:
    """Trees as heaps: node i splits `feature[i] >= split[i]` into 2i+1 and 2i+2; the path
    length of a leaf stands in `path`."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    normal: float
    threshold: float = math.inf

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for rows that are isolated at once."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                column = feature[node]
                down = 2 * node + 1 + (rows[at, column] >= split[node])
                node = np.where(column >= 0, down, node)
            total += path[node]
        return 2.0 ** -(total / len(self.feature) / self.normal)


def _expected_path(n: int) -> float:
    if n <= 1:
        return 0.0
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow_forest(rows: np.ndarray, seed: int = 7) -> Forest:
    random = np.random.default_rng(seed)
    size = min(TREE_ROWS, len(rows))
    nodes = 2 ** (DEPTH + 1) - 1
    feature = np.full((TREES, nodes), -1, dtype=np.int64)
    split = np.zeros((TREES, nodes))
    path = np.zeros((TREES, nodes))
    for tree in range(TREES):
        stack = [(0, 0, rows[random.choice(len(rows), size, replace=False)])]
        while stack:
            node, depth, part = stack.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth == DEPTH or len(part) <= 1 or not len(wide):
                path[tree, node] = depth + _expected_path(len(part))
                continue
            column = random.choice(wide)
            cut = low[column] + (high[column] - low[column]) * (1 - random.random())
            feature[tree, node], split[tree, node] = column, cut
            right = part[:, column] >= cut
            stack.append((2 * node + 1, depth + 1, part[~right]))
            stack.append((2 * node + 2, depth + 1, part[right]))
    return Forest(feature, split, path, _expected_path(size) or 1.0)


def _ratio_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in RATIOS])


def scored(stats: DataFrame, forest: Forest, extra: str | None = None) -> DataFrame:
    """Adds the anomaly score and the verdicts to statistics of `rule_statistics`."""
    kept = ["doc_id", *BASE] + ([extra] if extra else [])
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    fields = ", ".join(f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = model.scores(_ratio_rows(batch))
            failed = base_failed({c: batch.column(c).to_numpy() for c in BASE})
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(score), pa.array(failed), pa.array(~failed & (score < model.threshold))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "anomaly", "base_failed", "kept"])

    return stats.mapInArrow(run, f"{fields}, anomaly double, base_failed boolean, kept boolean")


def fit_forest(stats: DataFrame, labels: DataFrame) -> Forest:
    """Grow on a bounded sample of labelled rows, calibrate on all of them."""
    quality = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality")
    )
    labelled = stats.join(quality, "doc_id")
    # The rows of the smallest hashes, whatever the order in which tasks deliver them; the filter, which leaves twice
    # as many as wanted, only keeps the rest out of the sort.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, 2 * SAMPLE_ROWS / max(labelled.count(), 1))
    near = labelled.filter(place <= int(share * (1 << 40)))
    sample = near.orderBy(place, "doc_id", *RATIOS).limit(SAMPLE_ROWS)
    rows = np.array([list(r) for r in sample.select(RATIOS).collect()])
    rows = rows[np.lexsort(rows.T)] if len(rows) else rows
    if not len(rows):
        rows = np.zeros((1, len(RATIOS)))
    forest = grow_forest(rows)
    histogram = np.zeros((2, _BINS + 1))
    counts = (
        scored(labelled, forest, "quality")
        .filter("NOT base_failed")
        .groupBy((F.col("quality") > 0).cast("int").alias("good"), F.floor(F.col("anomaly") * _BINS).cast("int").alias("bin"))
        .count()
    )
    for row in counts.collect():  # at most two rows a bin
        histogram[row["good"], row["bin"]] += row["count"]
    bad, good = histogram
    if not bad.sum() or not good.sum():
        return forest
    # Rows at or above each bin; reject from the lowest bin that spares the good ones.
    bad_above, good_above = bad[::-1].cumsum()[::-1], good[::-1].cumsum()[::-1]
    allowed = good_above <= max(MAX_GOOD_REJECTED * good.sum(), 0)
    gain = np.where(allowed, bad_above, -1)
    best = int(np.flatnonzero(gain == gain.max())[-1])
    threshold = best / _BINS if gain[best] > 0 else math.inf
    return Forest(forest.feature, forest.split, forest.path, forest.normal, threshold)


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, anomaly score and verdicts of every document."""
    work = Workspace(docs.sparkSession, "quality")
    stats = work.save(rule_statistics(docs), "statistics").df
    return scored(stats, fit_forest(stats, labels))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules and the forest keep, with all their columns."""
    work = Workspace(docs.sparkSession, "quality")
    staged = work.save(rule_statistics(docs), "statistics")
    forest = fit_forest(staged.df, labels)
    work.drop(staged)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in T.slices(batch):
                stats = text_statistics(part.column("text"))
                score = model.scores(np.column_stack([stats[c] for c in RATIOS]))
                yield part.filter(pa.array(~base_failed(stats) & (score < model.threshold)))

    return docs.mapInArrow(run, docs.schema)
