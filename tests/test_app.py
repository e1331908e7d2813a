from __future__ import annotations

from knitgraph.app import parse, run


def test_truss_and_levels_of_a_file(spark, tmp_path, capsys):
    edges = tmp_path / "edges.txt"
    edges.write_text("# two K4s that share an edge, and a tail\n" + "\n".join(
        "1 2,1 3,1 4,2 3,2 4,3 4,1 5,1 6,2 5,2 6,5 6,6 7".split(",")
    ))
    run(spark, parse(["truss", str(edges), "--output", str(tmp_path / "truss")]))
    assert "truss size: 11" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "truss")).count() == 11
    run(spark, parse(["levels", str(edges), "--min-core", "0", "--triangle-multiplier", "3"]))
    shown = capsys.readouterr().out
    assert "|2  |11   |11   |" in shown
    run(spark, parse(["core", str(edges), "--k", "2"]))
    assert "core size: 6" in capsys.readouterr().out
