from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knitgraph.llm import languages, licenses


@pytest.fixture(scope="module")
def model(spark, smallest):
    docs = spark.read.parquet(f"{smallest.replace('sf0.001', 'sf0.01')}/documents.parquet")
    return languages.fit(docs.filter("crc32(CAST(doc_id AS STRING)) % 5 <> 0"))


def test_held_out_languages(spark, smallest, model):
    docs = spark.read.parquet(f"{smallest.replace('sf0.001', 'sf0.01')}/documents.parquet")
    held = docs.filter("crc32(CAST(doc_id AS STRING)) % 5 = 0")
    found = languages.predict_languages(held, model).join(docs, "doc_id")
    assert found.filter("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.filter("score < 0 OR score > 1").count() == 0


def test_mixtures_are_estimated(spark, smallest, model):
    docs = spark.read.parquet(f"{smallest.replace('sf0.001', 'sf0.01')}/documents.parquet")
    parts = {r.lang: r.text for r in docs.filter("length(text) BETWEEN 1500 AND 2500").orderBy("doc_id").collect()}
    one, two = parts["fr"].split()[:150], parts["de"].split()[:50]
    chosen, share, size = model.predict(pa.array([" ".join(one + two), " ".join(one)]))
    assert [model.languages[c] for c in chosen] == ["fr", "fr"]
    assert 0.6 < share[0] < 0.9 and size[0] >= 2
    assert share[1] > 0.95 and size[1] == 1


def test_estimate_equals_plain_expectation_maximisation():
    rng = np.random.default_rng(6)
    words = rng.random((30, 3))
    owner = np.repeat([0, 1], [10, 20])
    found = languages._estimate(words, owner, np.array([0, 10]), np.array([10, 20]), np.full((2, 3), 1 / 3), 5)
    for doc in range(2):
        p = np.full(3, 1 / 3)
        for _ in range(5):
            r = words[owner == doc] * p
            p = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(found[doc], p)


def test_odd_texts_are_undetermined(documents, model, spark):
    docs = documents([(1, None), (2, ""), (3, "12 34 — !"), (None, "the"), (4, "é"), (4, "é")]).withColumn("score", F.lit("own"))
    rows = languages.predict_languages(docs, model).collect()
    assert sorted(r.doc_id for r in rows if r.lang_pred == "und") == [1, 2, 3] and len(rows) == 6
    assert languages.predict_languages(docs.limit(0), model).count() == 0
    nothing = languages.fit(docs.limit(0))
    assert {r.lang_pred for r in languages.predict_languages(docs, nothing).collect()} == {"und"}


TEMPLATE = "Permission is hereby granted free of charge to any person obtaining a copy of this software to deal in it"


def test_licenses_are_found_with_spans(spark):
    filler = "some words before the notice that say nothing at all "
    edited = TEMPLATE.replace("obtaining", "who gets").replace("hereby ", "")
    rows = [
        (1, filler + TEMPLATE + " and after"), (2, edited.upper()), (3, TEMPLATE[:40]), (4, None), (5, ""),
        (6, TEMPLATE + ". " + filler + TEMPLATE), (6, "nothing"), (7, "x " * 5000 + TEMPLATE),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("coverage", F.lit("own"))
    found = sorted(map(tuple, licenses.scan(docs, [("T", TEMPLATE), ("none", None), (None, "a b c d")]).collect()))
    n = len(TEMPLATE.split())
    before = len(filler.split())
    assert found == [
        (1, "T", 1.0, n, before, before + n),
        (2, "T", (n - 2) / n, n - 2, 0, n),
        (6, "T", 1.0, n, 0, n),
        (6, "T", 1.0, n, n + before, 2 * n + before),
        (7, "T", 1.0, n, 5000, 5000 + n),
    ]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_alignment_equals_longest_common_subsequence():
    rng = np.random.default_rng(7)
    for _ in range(100):
        a, b = rng.integers(0, 6, 8), rng.integers(0, 6, 10)
        table = np.zeros((9, 11), dtype=int)
        for i in range(8):
            for j in range(10):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a[i] == b[j]))
        matched, start, end = licenses.align(a, b, 0)
        assert matched == table[8, 10] and 0 <= start <= end <= 10


def test_license_lines_of_the_table(spark, smallest):
    docs = spark.read.parquet(f"{smallest.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = {(r.doc_id, r.license) for r in licenses.scan(docs).collect()}
    expected = {
        (r.doc_id, name)
        for r in docs.collect()
        for name, notice in licenses.NOTICES.items()
        if notice in r.text.split("\n")
    }
    assert expected and expected <= found


def _brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_no_match_depends_on_where_a_notice_is_changed(documents):
    """One changed word at each place, and each long insertion, are judged as brute-force alignment does."""
    long = "w".join(f" {i} " for i in range(30)).replace(" ", "z").split("w")
    templates = [*((n, b) for n, b in licenses.NOTICES.items()), ("long", " ".join(long))]
    pairs = []
    for _, body in templates:
        own = "".join(c if c.isalnum() else " " for c in body).lower().split()
        for i in range(len(own)):
            pairs.append(("so it is", own[:i] + ["changed"] + own[i + 1 :]))
            pairs.append(("and", own[:i] + "A B C Holder and Many Sons of Town".lower().split() + own[i:]))
    docs = [(k, f"{head} {' '.join(words)} and more") for k, (head, words) in enumerate(pairs)]
    found = {(r.doc_id, r.license): r for r in licenses.scan(documents(docs), templates).collect()}
    expected = set()
    for k, text in docs:
        words = text.split()
        for name, body in templates:
            own = "".join(c if c.isalnum() else " " for c in body).lower().split()
            width = len(own) + licenses.extra_words(len(own))
            best = max(_brute_lcs(own, words[s : s + width]) for s in range(len(words)))
            if best >= licenses.MIN_COVERAGE * len(own):
                expected.add((k, name))
                r = found[k, name]
                assert r.matched_words == best == _brute_lcs(own, words[r.start_word : r.end_word])
    assert set(found) == expected and len(expected) >= len(pairs) * 0.9


def test_license_texts_are_templates(documents):
    mit = dict(licenses.templates())["MIT text"]
    bodies = [(name, body) for name, body in licenses.templates() if name.endswith((" text", " header", " preamble"))]
    assert len(bodies) > 30 and sum(len(body.split()) for _, body in bodies) < licenses.MAX_TEMPLATE_WORDS
    some = [b for b in bodies if b[0] in ("Apache-2.0 header", "BSD-3-Clause text", "ISC text", "GPL-3.0 preamble", "MPL-2.0 text")]
    docs = documents([(0, "The MIT License (MIT)\n\nCopyright (c) 2020 A. Person\n\n" + mit)] + [(i, b) for i, (_, b) in enumerate(some, 1)])
    found = {(r.doc_id, r.license) for r in licenses.scan(docs).collect() if r.coverage == 1}
    assert {(0, "MIT text")} | {(i, name) for i, (name, _) in enumerate(some, 1)} <= found
