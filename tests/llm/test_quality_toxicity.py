from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from knitgraph.llm import quality, toxicity
from knitgraph.plans import Workspace

TEXTS = [
    None, "", " \t\n ", "one", "a b c d e f a b c d e f", "same\nsame\n same\nsame \n\n\nsame",
    "x " * 50, "$$$ ### été 日本語 |<>|", "é è  y z\x1cw", "a b c d e a b c d e f g a b c d",
]


def test_rule_statistics_equal_plain_python(spark, documents, smallest):
    docs = documents(enumerate(TEXTS)).unionByName(spark.read.parquet(f"{smallest}/documents.parquet"))
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    found = quality.rule_statistics(docs).select("doc_id", *quality.BASE).collect()
    assert sorted(map(tuple, found)) == sorted((i, *plain.rule_statistics(t)) for i, t in texts)


def test_quality_columns_may_clash_and_tables_may_be_empty(spark, documents):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents([(1, "w " * 3), (None, None), (2, " ".join(map(str, range(40))))]).withColumn("n_words", F.lit("own"))
    kept = quality.keep_documents(docs, labels)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]
    assert quality.keep_documents(docs.limit(0), labels).count() == 0
    assert quality.judge_documents(docs, labels).count() == 3


def test_forest_isolates_what_differs():
    rows = np.random.default_rng(1).normal(0, 1, (2000, len(quality.RATIOS)))
    rows[:5] += 12
    forest = quality.grow_forest(rows)
    scores = forest.scores(rows)
    assert set(np.argsort(-scores)[:5]) == set(range(5))
    assert ((scores > 0) & (scores < 1)).all()


def test_labelled_junk_is_rejected_and_clean_text_kept(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(80))
    junk = lambda: " ".join(w + "#" * rng.randint(1, 9) for w in prose().split())
    rows = [(i, junk() if i % 50 == 0 else prose(), int(i % 50 != 0)) for i in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows if i % 4 < 2], "doc_id bigint, quality int, toxic int")
    judged = {r.doc_id: r.kept for r in quality.judge_documents(docs, labels).collect()}
    wrong = sum(judged[i] != bool(q) for i, _, q in rows)
    assert wrong <= 5


def test_noisy_or_learns_from_document_labels_and_locates_sentences(spark):
    rng = random.Random(4)
    sentence = lambda bad: " ".join(rng.choices(["sun", "rain", "wind", "tree", "road", "lamp"], k=6) + (["vilest"] if bad else []))
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        parts = [sentence(False) for _ in range(4)]
        if bad:
            parts.insert(rng.randint(0, 4), sentence(True))
        rows.append((i, ". ".join(parts) + ".", int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, None, x) for i, _, x in rows if i < 450], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    scores = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(scores[i].predicted == x for i, _, x in rows)
    found = toxicity.offending_sentences(docs, model).collect()
    texts = {i: t.encode() for i, t, _ in rows}
    assert {r.doc_id for r in found} == {i for i, _, x in rows if x}
    assert all(b"vilest" in texts[r.doc_id][r.start : r.end] and b"." not in texts[r.doc_id][r.start : r.end] for r in found)


def test_samples_do_not_depend_on_partitions(spark, monkeypatch):
    """More labelled rows than the samples hold, dealt out in two ways."""
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 100)
    monkeypatch.setattr(toxicity, "FIT_ROWS", 200)
    rng = random.Random(8)
    text = lambda bad: " ".join(rng.choices(["sun", "rain", "#tree", "road"], k=30) + (["vilest"] if bad else []))
    rows = [(i % 700, text(i % 3 == 0), 1) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 3 == 0)) for i in range(700)], "doc_id bigint, quality int, toxic int")
    stats = quality.rule_statistics(docs).persist()
    forests = [quality.fit_forest(stats.repartition(n, "n_words"), labels.repartition(n)) for n in (2, 7)]
    assert all((getattr(forests[0], f) == getattr(forests[1], f)).all() for f in ("feature", "split", "path"))
    assert forests[0].threshold == forests[1].threshold
    models = [toxicity.fit(docs.repartition(n), labels.repartition(n)) for n in (2, 7)]
    assert models[0].trained and (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias


def test_repeats_of_a_labelled_row_are_one_with_a_weight(spark):
    rng = random.Random(9)
    text = lambda bad: " ".join(rng.choices(["sun", "rain", "tree", "road"], k=12) + (["vilest"] if bad else []))
    rows = [(i, text(i % 3 == 0)) for i in range(300)]
    hot = spark.range(50_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(rows[3][1]).alias("text"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(hot)
    labels = spark.createDataFrame([(i, None, int(i % 3 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    staged = toxicity._labelled(docs, labels, Workspace(spark, "test"))
    assert staged.rows == 300 and staged.df.filter("doc_id = 3").first().weight == 50_001
    model = toxicity.fit(docs, labels)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in toxicity.score_documents(docs.limit(300), model).collect())


def test_without_both_labels_all_texts_score_the_prior(spark, documents):
    docs = documents([(i, f"some words {i}. And more") for i in range(30)])
    labels = spark.createDataFrame([(i, None, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        scores = toxicity.score_documents(docs, toxicity.fit(docs, known)).collect()
        assert {r.score for r in scores} == {toxicity.PRIOR}


def test_toxicity_of_odd_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    docs = documents([(None, None), (1, ""), (2, "?!."), (3, "é a\n\nb"), (3, "é a\n\nb")])
    model = toxicity.fit(docs, none)
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.keep_documents(docs.withColumn("score", F.lit(1)), model).count() == 5
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_held_out_toxicity(spark, smallest):
    """Rows that the model has not seen, at the next scale."""
    folder = smallest.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = toxicity.remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs.filter(~held), labels)
    scored = toxicity.score_documents(docs.filter(held), model).join(labels, "doc_id")
    table = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    recall = table[1, 1] / (table[1, 1] + table.get((1, 0), 0))
    false = table.get((0, 1), 0) / (table[0, 0] + table.get((0, 1), 0))
    assert recall > 0.8 and false < 0.02


@pytest.mark.parametrize("n, expected", [(1, 0.0), (2, 1.0)])
def test_expected_path(n, expected):
    assert quality._expected_path(n) == expected
