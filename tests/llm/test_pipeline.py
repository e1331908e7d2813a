from __future__ import annotations

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
import plain
from knitgraph.llm import jaccard, packing, quality, queries, substrings, toxicity


def test_operators_and_pipeline_are_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names and set(contract.oracle_sql()) <= set(names)


def test_stages_filter_and_change_what_they_should(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, smallest).collect(), docs.schema)
        old, new = ({r.doc_id: r for r in d.collect()} for d in (before, after))
        assert set(new) <= set(old) and len(new) > 0.6 * len(old)
        pairs = [(i, r.text) for i, r in old.items()]
        if name == "n-gram Jaccard join":
            assert set(new) == {c for _, n, c in plain.link_components(pairs) if n} | {i for i, n, _ in plain.link_components(pairs) if not n}
        if name == "substring dedup":
            kept = {i: (n - gone, digest) for i, n, gone, digest in plain.removed_words(pairs)}
            for i, r in new.items():
                assert hashlib.sha256(b" ".join(plain.words(r.text))).hexdigest() == kept[i][1]
                assert r.n_chars == len(r.text)
        else:
            assert all(new[i] == old[i] for i in new)
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, smallest)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, smallest, name):
    found = queries.QUERIES[name](spark, smallest)
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        connection.execute(f"create view {table} as select * from '{smallest}/{table}.parquet'")
    columns = sorted(found.columns)
    expected = connection.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in found.collect()) == sorted(expected)


def test_op4_and_op10_equal_plain_python(spark, smallest):
    pairs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()]
    removed = queries.QUERIES["op4_substring_dedup"](spark, smallest)
    assert sorted(map(tuple, removed.collect())) == sorted(plain.removed_words(pairs))
    linked = queries.QUERIES["op10_ngram_jaccard_join"](spark, smallest)
    assert sorted(map(tuple, linked.collect())) == sorted(plain.link_components(pairs))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)]])
def test_stages_of_empty_and_null_tables(spark, smallest, rows, tokenizers_folder):
    schema = spark.read.parquet(f"{smallest}/documents.parquet").schema
    docs = spark.createDataFrame(rows, schema)
    labels = spark.read.parquet(f"{smallest}/labels.parquet")
    assert toxicity.keep_documents(docs, toxicity.fit(docs, labels)).count() == len(rows)
    assert quality.keep_documents(docs, labels).count() == 0
    assert jaccard.keep_one_of_each(docs).count() == len(rows)
    assert substrings.strip_documents(docs).count() == len(rows)
    assert packing.pack_documents(docs, f"{tokenizers_folder}/word_bpe_49k.json").agg(F.sum("length")).first()[0] in (None, 1)
