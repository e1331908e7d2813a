"""From raw documents to packed sequences: the stages of a training-data pipeline.

Each stage takes the rows that its predecessor kept. All but the last return the columns of
`documents`; `n_chars` follows the text where a stage changes it.

For all stages: an empty table gives an empty one; columns beyond those of `documents` stay with their rows (packing
returns its own columns); rows that repeat a document are judged alike, and long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knitgraph.llm import jaccard, packing, quality, substrings, toxicity
from knitgraph.llm.queries import tokenizer_file
from knitgraph.llm.ship import ship
from knitgraph.plans import Workspace


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence scores reaches the cut go; null and empty texts have no sentence and stay."""
    ship(spark)
    return toxicity.keep_documents(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or that the forest isolates go; null and empty texts fail it."""
    ship(spark)
    return quality.keep_documents(docs, _labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id (null ids last); rows that repeat
    it go with the group, texts without a word are linked with nothing and stay."""
    ship(spark)
    return jaccard.keep_one_of_each(docs)


def strip_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur again anywhere go, also in rows that repeat a document; null texts stay null, and a text
    whose words all go stays as an empty one."""
    ship(spark)
    return substrings.strip_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, filled with lexical neighbours; null texts are empty ones, which hold the closing id,
    and rows that repeat a document are packed each."""
    ship(spark)
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", apply_quality_rules),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", strip_repeated_passages),
    ("packing", pack),
]

#: Trained models and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written and read again; null ids and texts follow the stages' rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return docs
