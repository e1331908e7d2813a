from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knitgraph.llm import variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(pairs, least=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 6:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= least}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, words[w], len(near[w]), form[w], form[w] and words[form[w]], root))
    return sorted(out)


def compared(documents, pairs):
    frame = documents(pairs).withColumn("word", F.lit("own")).withColumn("n", F.lit(-1)).repartition(4)
    assert sorted([tuple(r) for r in variants.spelling_variants(frame).collect()], key=lambda r: r[0]) == plain(pairs)


def made_up(seed, size=400):
    """Documents over words, misspelt forms of theirs and forms of those."""
    rng = random.Random(seed)
    letters = "abcdeéßÀ"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(40)]
    forms = list(words)
    for w in words * 3:
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        forms.append(w[:at] + [rng.choice(letters), "", rng.choice(letters) + w[at]][kind] + w[at + 1 :])
    weights = [3000] * 10 + [300] * 30 + [rng.choice([4, 20, 60]) for _ in forms[40:]]
    return [(i, rng.choice([" ", "-", ", "]).join(rng.choices(forms, weights, k=60)).upper() if i % 3 else " ".join(rng.choices(forms, weights, k=60))) for i in range(size)]


def test_forms_and_roots_equal_plain_python(documents):
    compared(documents, made_up(1))


def test_blocks_in_parts_lose_no_pair(documents, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 3)
    monkeypatch.setattr(variants, "TILE", 4)
    compared(documents, made_up(2, 150))


def test_odd_documents(documents):
    long = "wörterbuch " * 50_000 + "x" * 2_000_000 + " tiefere×÷ "
    pairs = [(1, None), (2, ""), (3, " \n7 8"), (None, "öfters öfters öfters öfters öfters"), (5, long), (5, long), (5, long), (5, long), (5, long)]
    pairs += [(6, "abcdef " * 5 + "abcdeg " * 5 + "abcdeh " * 30 + "abcdei " * 30 + "fedcba " * 9 + "bacdef " * 9)]
    compared(documents, pairs)
    compared(documents, pairs[:3])
    assert variants.spelling_variants(documents([])).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "abcdefgh Ijklmnöp " * 100 + "q" * 300
    whole = variants.word_counts(3, text)
    monkeypatch.setattr(variants, "PIECE", 7)
    assert variants.word_counts(3, text) == whole and whole["abcdefgh"] + whole["ijklmnöp"] == 200


def test_chains_of_forms_reach_the_root(documents):
    chain = ["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(5 ** (i + 1)))
    pairs = [(i, text) for i in (11, 12)]
    found = {r["word"]: r["root"] for r in variants.spelling_variants(documents(pairs)).collect()}
    assert {w: r for w, _, _, _, _, r in plain(pairs)} == found and set(found.values()) == {"aabbbb"}


@pytest.mark.parametrize("base", [6, 7])
def test_gram_pairs_hold_all_near_words(base):
    rng = random.Random(base)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice([base, base + 1]))) for _ in range(150)})
    side = np.full(len(words), 2)
    found = set()
    # Heads and tails together: every pair once, if both kinds of block held all words.
    for head in (True, False):
        i, j = variants.block_pairs(words, base, side, head)
        found |= {frozenset((words[a], words[b])) for a, b in zip(i, j)}
    short = [w for w in words if len(w) == base]
    assert found == {frozenset((a, b)) for a in short for b in words if one_edit(a, b)}


def test_one_query_over_the_smallest_table(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in variants.spelling_variants(docs).collect()], key=lambda r: r[0]) == plain(pairs)
