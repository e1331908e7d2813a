from __future__ import annotations

import os

import pytest

from knitgraph.llm.ship import ship

SMALLEST = "/root/testdata/sf0.001"
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def smallest():
    return SMALLEST


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (id, text) pairs, with the columns of the table."""

    def build(pairs):
        rows = [(i, text, "en", "src0", None if text is None else len(text)) for i, text in pairs]
        return spark.createDataFrame(rows, DOCUMENT)

    return build


@pytest.fixture(scope="session")
def tokenizers_folder():
    public = pytest.importorskip("public_tokenizers")
    return os.path.dirname(public.__file__)
