"""Queries of problem 4: a few keys holding most records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import skew
from ..session import table


def p4_found(spark, d):
    heavy = skew.heavy_hitters(table(spark, d, "edges"), ["from_id", "to_id"], 0.01)
    return heavy.select(F.regexp_replace("side", "_id$", "").alias("side"), F.col("key").alias("key_id"))


def p4_degrees(spark, d):
    return skew.degrees(table(spark, d, "edges"))


def p4_link_degrees(spark, d):
    """Each link with the in-degree of its target: a join on the most skewed column."""
    edges = table(spark, d, "edges").select("edge_id", "from_id", "to_id").filter("to_id IS NOT NULL")
    target = edges.groupBy("to_id").agg(F.count(F.lit(1)).alias("to_in_degree"))
    return skew.skew_join(edges, target, "to_id").select("edge_id", "from_id", "to_id", "to_in_degree")


def p4_back_links(spark, d):
    """The distinct sources of each target, heavy targets in 64 chunks."""
    return skew.chunked_lists(table(spark, d, "edges"), "to_id", "from_id")


QUERIES = {f.__name__: f for f in (p4_found, p4_degrees, p4_link_degrees, p4_back_links)}

SQL = {
    "p4_found": """
SELECT side, key_id FROM (
  SELECT 'from' AS side, from_id AS key_id, count(*) AS n FROM edges WHERE from_id IS NOT NULL GROUP BY from_id
  UNION ALL SELECT 'to', to_id, count(*) FROM edges WHERE to_id IS NOT NULL GROUP BY to_id)
WHERE n > 0.01 * (SELECT count(*) FROM edges)""",
    "p4_degrees": """
SELECT key_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (
  SELECT from_id AS key_id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT to_id, 0, 1 FROM edges)
WHERE key_id IS NOT NULL GROUP BY key_id""",
    "p4_link_degrees": """
SELECT edge_id, from_id, to_id, count(*) OVER (PARTITION BY to_id) AS to_in_degree FROM edges WHERE to_id IS NOT NULL""",
    "p4_back_links": """
WITH h AS (SELECT to_id AS k FROM edges WHERE to_id IS NOT NULL GROUP BY to_id HAVING count(*) > 0.01 * (SELECT count(*) FROM edges))
SELECT to_id, CAST(CASE WHEN to_id IN (SELECT k FROM h) THEN ((from_id % 64) + 64) % 64 ELSE 0 END AS INTEGER) AS chunk,
  list_sort(list(DISTINCT from_id)) AS "values" FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY ALL""",
}
