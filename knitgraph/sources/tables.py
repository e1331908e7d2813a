"""Graphs derived from the test tables.

Every definition is linear in its table: a row gives a fixed number of edges,
found by projection or by an equi-join on a unique row id. No group of rows is
ever expanded into all of its pairs, so a hot order, day or user cannot blow up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knitgraph.operators.edges import canonical_edges

# Fixed values that the graph definitions share with their SQL counterparts.
SHIPMENT_KINDS = 3  # part, supplier and ship day get ids 3n, 3n + 1 and 3n + 2
USER_REACH = 3  # an event is linked with the next 3 events of the log ...
USER_WINDOW = "INTERVAL 1 MINUTE"  # ... that follow within a minute
CUSTOMER_REACH = 4  # an order is linked with the next 4 order keys


def shipment_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Each line item links its part, its supplier and its ship day.

    Suppliers and days are hubs: their number hardly grows with the table.
    """
    line = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        (F.col("l_partkey") * SHIPMENT_KINDS).alias("part"),
        (F.col("l_suppkey") * SHIPMENT_KINDS + 1).alias("supplier"),
        (F.unix_date(F.to_date("l_shipdate")).cast("long") * SHIPMENT_KINDS + 2).alias("day"),
    )
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    # A third of all lines may repeat one triple: collapse repeats map-side first.
    return canonical_edges(
        line.select(
            F.inline(F.array(pair("part", "supplier"), pair("part", "day"), pair("supplier", "day")))
        )
    )


def _linked(rows: DataFrame, *columns: str) -> DataFrame:
    """All pairs of the three given ids of a row; ids n become 3n, 3n + 1 and 3n + 2."""
    ids = rows.select(*[(F.col(c) * 3 + n).alias(c) for n, c in enumerate(columns)])
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    a, b, c = columns
    return canonical_edges(ids.select(F.inline(F.array(pair(a, b), pair(a, c), pair(b, c)))))


def order_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Each order links its customer, its day and its priority, of which there are five."""
    rows = spark.read.parquet(f"{folder}/orders.parquet").select(
        F.col("o_custkey").alias("customer"),
        F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day"),
        F.substring("o_orderpriority", 1, 1).cast("long").alias("priority"),
    )
    return _linked(rows, "customer", "day", "priority")


def event_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Each event links its user, its minute and its type, named by its first letter."""
    rows = spark.read.parquet(f"{folder}/events.parquet").select(
        F.col("user_id").alias("user"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long").alias("minute"),
        F.ascii("event_type").cast("long").alias("type"),
    )
    return _linked(rows, "user", "minute", "type")


def _followers(table: DataFrame, row_id: str, reach: int) -> DataFrame:
    """Each row once per distance 1..reach, keyed by the row id it follows."""
    return table.withColumn(
        "distance", F.explode(F.sequence(F.lit(1), F.lit(reach)))
    ).withColumn("follows", F.col(row_id) - F.col("distance"))


def user_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Users whose events are at most three log entries and one minute apart."""
    log = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts")
    later = _followers(log, "event_id", USER_REACH).select(
        F.col("follows").alias("event_id"),
        F.col("user_id").alias("next_user"),
        F.col("ts").alias("next_ts"),
    )
    near = log.join(later, "event_id").filter(
        F.col("next_ts") <= F.col("ts") + F.expr(USER_WINDOW)
    )
    return canonical_edges(near, "user_id", "next_user")


def customer_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of orders with near keys, equal priority and equal status."""
    order = spark.read.parquet(f"{folder}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"
    )
    later = _followers(order, "o_orderkey", CUSTOMER_REACH).select(
        F.col("follows").alias("o_orderkey"),
        "o_orderpriority",
        "o_orderstatus",
        F.col("o_custkey").alias("next_customer"),
    )
    near = order.join(later, ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    return canonical_edges(near, "o_custkey", "next_customer")


GRAPHS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "shipments": shipment_graph,
    "users": user_graph,
    "customers": customer_graph,
    "orders": order_graph,
    "events": event_graph,
}
