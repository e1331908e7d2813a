"""Command line for spark-submit: peel or decompose an edge-list file.

    spark-submit knitgraph/app.py truss  EDGES --k 4 [--output PATH]
    spark-submit knitgraph/app.py levels EDGES --min-core 3 [--output PATH]
    spark-submit knitgraph/app.py core   EDGES --k 3 [--output PATH]

``truss`` and ``core`` print the size of the result, ``levels`` its histogram.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from knitgraph.operators.levels import level_report, truss_levels
from knitgraph.operators.peeling import core_subgraph, truss_subgraph
from knitgraph.plans import Limits
from knitgraph.sources import read_edge_text


def parse(arguments: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("task", choices=["truss", "levels", "core"])
    parser.add_argument("edges", help="edge-list text: file, folder or glob")
    parser.add_argument("--k", type=int, default=4)
    parser.add_argument("--min-core", type=int, default=3, help="core for levels; 0: whole graph")
    parser.add_argument("--prefilter-rounds", type=int, help="0: no k-core prefilter")
    parser.add_argument("--levels-shown", type=int, default=1000)
    parser.add_argument("--partitions", type=int, help="shuffle partitions of the job")
    parser.add_argument("--triangle-multiplier", type=int, default=1, help="factor on the partitions of the triangle stage")
    parser.add_argument("--permissive", action="store_true", help="skip lines with bad integers")
    parser.add_argument("--output", help="write the result here as Parquet")
    return parser.parse_args(arguments)


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    if options.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", options.partitions)
    limits = Limits(triangle_multiplier=options.triangle_multiplier)
    edges = read_edge_text(spark, options.edges, options.permissive)
    if options.task == "truss":
        result = truss_subgraph(spark, edges, options.k, options.prefilter_rounds, limits)
    elif options.task == "levels":
        result = truss_levels(spark, edges, options.min_core, options.prefilter_rounds, limits)
    else:
        result = core_subgraph(spark, edges, options.k, options.prefilter_rounds, limits)
    if options.output:
        result.write.parquet(options.output)
        result = spark.read.parquet(options.output)
    if options.task == "levels":
        level_report(result, options.levels_shown).show(options.levels_shown, truncate=False)
    else:
        print(f"{options.task} size: {result.count()}")


if __name__ == "__main__":
    run(SparkSession.builder.appName("knitgraph").getOrCreate(), parse(sys.argv[1:]))
