from __future__ import annotations

import gzip

import pytest

from knitgraph.catalogue import dirty_lines
from knitgraph.operators.edges import canonical_edges
from knitgraph.sources import GRAPHS, parse_edge_lines, read_edge_text

SMALLEST = "/root/testdata/sf0.001"


def lines(spark, *values):
    return spark.createDataFrame([(value,) for value in values], "value string")


def pairs(df):
    return sorted(tuple(row) for row in df.collect())


def test_text_format(spark):
    text = lines(
        spark,
        "# comment", "#1 2", "1 2", "2\t1", "3   4  ", " 5 6", "7 8 9", "7", "", "   ", "9 9", "-1 10",
        "12345678901 2",
    )
    assert pairs(parse_edge_lines(text)) == [
        (-1, 10), (1, 2), (2, 1), (3, 4), (12345678901, 2)
    ]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("line", ["1 x", "4 5.5", " 5", "9223372036854775808 1", "1e3 2"])
def test_bad_integers_fail_or_are_skipped(spark, ansi, line):
    old = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        text = lines(spark, "+1 2", line, "x y z", "# x y")
        with pytest.raises(Exception, match="not a 64-bit integer"):
            parse_edge_lines(text).collect()
        assert pairs(parse_edge_lines(text, permissive=True)) == [(1, 2)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", old)


def test_files_folders_and_compressed_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n1 2\n2 3\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as out:
        out.write("3 4\n")
    assert pairs(read_edge_text(spark, str(tmp_path))) == [(1, 2), (2, 3), (3, 4)]
    assert pairs(read_edge_text(spark, f"{tmp_path}/*.gz")) == [(3, 4)]


def test_dirty_lines_lose_exactly_the_unreadable_edges(spark, tmp_path):
    edges = GRAPHS["users"](spark, SMALLEST)
    dirty_lines(edges).write.text(f"{tmp_path}/lines")
    found = canonical_edges(read_edge_text(spark, f"{tmp_path}/lines"))
    kept = edges.filter("src % 7 <> 0 AND dst % 13 <> 0 AND dst % 11 <> 0")
    assert pairs(found) == pairs(kept)


@pytest.mark.parametrize("name", list(GRAPHS))
def test_graphs_are_canonical(spark, name):
    found = pairs(GRAPHS[name](spark, SMALLEST))
    assert found and len(found) == len(set(found)) and all(a < b for a, b in found)
