"""Headline queries, each written out in full inside its timed section.

Prints one JSON line. BENCH_SF_DIR names the table folder, BENCH_CPUS the number
of local threads.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from knitgraph.catalogue import QUERIES

HEADLINES = [
    "graph_shipments",
    "vertex_degree",
    "oriented_edges",
    "triangle_count",
    "edge_support",
    "triangle_partner_sizes",
    "core_subgraph_4",
    "core_subgraph_hubs",
    "truss_subgraph_4",
    "truss_subgraph_5",
    "truss_subgraph_6",
    "truss_levels_in_core",
    "truss_level_histogram",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("knitgraph-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
