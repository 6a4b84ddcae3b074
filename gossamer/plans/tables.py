"""Graphs and tables that several queries derive from the input, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import Graph
from ..session import table

#: Site links: edges whose ends are fetched pages, by the sites (queue ids) of the pages.
PAGE_SITE = "SELECT docid, min(queue_id) AS q FROM responses WHERE docid IS NOT NULL AND queue_id IS NOT NULL GROUP BY docid"
SITE_EDGES = f"SELECT CAST(a.q AS BIGINT) AS src, CAST(b.q AS BIGINT) AS dst, count(*) AS weight FROM edges e JOIN ({PAGE_SITE}) a ON e.from_id = a.docid JOIN ({PAGE_SITE}) b ON e.to_id = b.docid WHERE a.q <> b.q GROUP BY ALL"
E = "SELECT from_id AS src, to_id AS dst, edge_id AS eid FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL"
TRADE = """SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS weight, CAST(c_nationkey * 100 + s_nationkey AS BIGINT) AS eid FROM customer JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 50 AND l_discount >= 0.09 AND l_returnflag = 'R' AND c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey"""


def links(spark, d) -> Graph:
    """The page-link graph; 0 (an unresolved link) is an id like any other, null ends are no edges."""
    return Graph.from_edges(table(spark, d, "edges").select("from_id", "to_id", "edge_id"), "from_id", "to_id", "edge_id")


def weighted_links(spark, d) -> Graph:
    g = links(spark, d)
    return Graph(g.vertices, g.edges.withColumn("weight", F.pmod("eid", F.lit(10)) + 1), True)


def trade(spark, d) -> Graph:
    """Sparse directed trade graph of the nations; its weights count line items."""
    t = lambda n: table(spark, d, n)
    items = t("lineitem").filter("l_quantity >= 50 AND l_discount >= 0.09 AND l_returnflag = 'R'").select("l_orderkey", "l_suppkey")
    j = items.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    e = j.filter("c_nationkey <> s_nationkey").groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("weight"))
    e = e.select(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"), "weight", (F.col("c_nationkey") * 100 + F.col("s_nationkey")).cast("bigint").alias("eid"))
    return Graph.from_edges(e, eid="eid")


def site_graph(spark, d) -> Graph:
    page = table(spark, d, "responses").filter("docid IS NOT NULL AND queue_id IS NOT NULL").groupBy("docid").agg(F.min("queue_id").alias("q"))
    a, b = page.withColumnsRenamed({"docid": "from_id", "q": "src"}), page.withColumnsRenamed({"docid": "to_id", "q": "dst"})
    e = table(spark, d, "edges").select("from_id", "to_id").join(a, "from_id").join(b, "to_id").filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    return Graph.from_edges(e.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "weight"))
