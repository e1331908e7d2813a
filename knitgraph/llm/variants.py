"""Spelling variants: words one edit apart, found by blocked Gram matrices of their letter counts.

1. Words are counted per task and summed by Spark; frequent ones form the vocabulary, which is written.
2. If two words are one edit apart, with L the length of the shorter one, they share their first L // 2
   code points or their last L - L // 2. So each word goes to the blocks of its first and of its last
   part, once as a word of length L and once as one of length L + 1. Blocks beyond `BLOCK` words are dealt
   out as pairs of sub-blocks.
3. In a block, one product of the letter-count matrices of adjacent lengths gives all squared distances
   |x|^2 + |y|^2 - 2 xy. One edit changes them by 1 (a letter more) or by 2 (a letter replaced), so pairs at
   most two apart are kept and their edits verified code point by code point.
4. A word's form is its most frequent near word if that is 5 times as frequent. Frequencies rise along forms, so the
   chain ends; roots are found by doubling the steps.

Defined cases: null and empty texts have no words; a null id is written as nothing before the colon; rows that
repeat a document count again; ties between near words go to the smallest in code-point order; an empty
table gives no row. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitgraph.llm import text as T
from knitgraph.plans import Workspace

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form is so many times as frequent as its word.
FORM_SHARE = 5
#: One of so many (document, run) pairs loses a code point.
SPOILED = 199
#: Words of a block that one task compares.
BLOCK = 4096
#: Elements of a Gram matrix that are held at once, and words counted by a task before they are sent.
TILE = 1 << 22
HELD_WORDS = 1 << 18
#: Code points of a text that are searched at once; longer ones are cut between words.
PIECE = 1 << 20

_RUN = re.compile("[a-zÀ-ÿ]+")
_BREAK = re.compile("[^a-zÀ-ÿ]")
_LOWER = bytes(T.lower(np.arange(256, dtype=np.uint8)))
#: Letter of a code point: a-z, then U+00C0 to U+00FF.
_LETTERS = 26 + 64


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        cut = _BREAK.search(text, min(at + PIECE, len(text)))
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


def word_counts(doc_id: object, text: str | None) -> Counter[str]:
    """Occurrences of the words of one document that are long enough."""
    out: Counter[str] = Counter()
    if not text:
        return out
    lowered = text.encode().translate(_LOWER).decode()
    runs: Counter[str] = Counter()
    for piece in _pieces(lowered):
        runs.update(_RUN.findall(piece))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % SPOILED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in T.slices(batch):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held.update(word_counts(doc_id, text))
                    if len(held) > HELD_WORDS:
                        yield sent()
        if held:
            yield sent()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _blocks(words: DataFrame) -> DataFrame:
    """Each word in its blocks: (head, base, piece) names one; low and high are its two sub-blocks."""
    size = F.length("word")
    rows = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("base"))
    half = F.floor(F.col("base") / 2).cast("int")
    ends = F.array(
        F.struct(F.lit(True).alias("head"), F.expr("left(word, cast(floor(base / 2) as int))").alias("piece")),
        F.struct(F.lit(False).alias("head"), F.expr("right(word, cast(base - floor(base / 2) as int))").alias("piece")),
    )
    rows = rows.filter(half > 0).select("word", "n", "size", "base", F.inline(ends))
    key = ["head", "base", "piece"]
    # Blocks without two words, or without one of the base length, have no pair.
    width = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("size") == F.col("base")).alias("short"))
    width = width.filter("m > 1 AND short > 0").select(*key, F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("word"), "parts").cast("int")
    return (
        rows.join(width, key)
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.xxhash64(*key).alias("block"), *key, "word", "n", "size", F.least("part", "other").alias("low"),
            F.greatest("part", "other").alias("high"),
            # Which sub-block of the two a word is in; 2: both are one.
            F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1).alias("side"),
        )
    )


def letters(words: list[str]) -> np.ndarray:
    """The code points of words of one length, as letters."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.int32)
    return np.where(codes < 0xC0, codes - ord("a"), codes - 0xC0 + 26)


def letter_counts(coded: np.ndarray) -> np.ndarray:
    n = len(coded)
    slot = coded + np.arange(n)[:, None] * _LETTERS
    return np.bincount(slot.ravel(), minlength=n * _LETTERS).reshape(n, _LETTERS).astype(np.float64)


def gram_pairs(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two count matrices at squared distances of at most two; i < j if they are one."""
    out_i, out_j = [], []
    length_x, length_y = (x * x).sum(axis=1), (y * y).sum(axis=1)
    step = max(1, TILE // max(1, len(y)))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        apart = length_x[at : at + step, None] + length_y[None, :] - 2 * (some @ y.T)
        i, j = np.nonzero(apart <= 2)
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        out_i.append(i)
        out_j.append(j)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *out_i]), np.concatenate([empty, *out_j])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of codes, of one length or the second one longer by one, are one edit apart."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    ahead = np.cumprod(a == b[:, :size], axis=1).sum(axis=1)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= size


def block_pairs(words: list[str], base: int, side: np.ndarray, head: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near words of a block. A pair that shares both parts is found in the block of the first."""
    size = np.array([len(w) for w in words])
    groups = {}
    for length in (base, base + 1):
        which = np.flatnonzero(size == length)
        if len(which):
            coded = letters([words[i] for i in which])
            groups[length] = which, coded, letter_counts(coded)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length in (base, base + 1):
        if base not in groups or length not in groups:
            continue
        (which_x, coded_x, x), (which_y, coded_y, y) = groups[base], groups[length]
        i, j = gram_pairs(x, y, length == base)
        side_i, side_j = side[which_x[i]], side[which_y[j]]
        wanted = (side_i != side_j) | (side_i == 2)
        i, j = i[wanted], j[wanted]
        near = one_edit(coded_x[i], coded_y[j])
        if not head:
            half = base // 2
            near &= (coded_x[i][:, :half] != coded_y[j][:, :half]).any(axis=1)
        found_i.append(which_x[i[near]])
        found_j.append(which_y[j[near]])
    return np.concatenate(found_i), np.concatenate(found_j)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both directions of all pairs of words of `words` (word, n) one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows = pa.Table.from_batches(held)
            held.clear()
            names, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
            i, j = block_pairs(names, rows.column("base")[0].as_py(), rows.column("side").to_numpy(), rows.column("head")[0].as_py())
            if len(i):
                both, other = np.append(i, j), np.append(j, i)
                words = pa.array(names)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(both)), words.take(pa.array(other)), pa.array(n[other])], ["word", "near", "near_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "low", "high", "base", "head")]
            piece = batch.column("piece").to_numpy(zero_copy_only=False)
            new = np.zeros(batch.num_rows, dtype=bool)
            for column in (*key, piece):
                new[1:] |= column[1:] != column[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for at, stop in zip(cuts, cuts[1:]):
                name = (*[column[at] for column in key], piece[at])
                if name != last:
                    yield from close()
                    last = name
                held.append(batch.slice(at, stop - at))
        yield from close()

    order = ["block", "head", "base", "piece", "low", "high"]
    dealt = _blocks(words).repartition("block", "low", "high").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "word string, near string, near_n bigint")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of the vocabulary."""
    work = Workspace(docs.sparkSession, "variants")
    words = work.save(vocabulary(docs), "words").df
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.less") >= FORM_SHARE * F.col("n")
    found = work.save(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"),
            F.when(is_form, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    ).df
    steps = work.save(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "steps")
    while True:
        ahead = steps.df.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.df.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        done = work.save(moved, "steps", moved=F.count_if("moved"))
        work.drop(steps)
        steps = done
        if not done.measures["moved"]:
            break
    roots = steps.df.select("word", "root")
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
