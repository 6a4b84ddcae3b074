"""Seeded synthetic graphs as edge DataFrames (src, dst, eid)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _coin(seed: int, *keys):
    """A uniform number in [0, 1) fixed by the keys: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def rmat(spark: SparkSession, n: int, m: int, a=0.57, b=0.19, c=0.19, d=0.05, seed: int = 1, unique: bool = False, ordered: bool = False, permute: bool = False, undirected: bool = False) -> DataFrame:
    """``m`` recursive-matrix edges over 2^floor(log2 n) vertices.

    ``unique`` drops repeated pairs and tops up until there are ``m`` (or the pairs are exhausted);
    ``undirected`` puts the smaller end first; ``permute`` relabels vertices; ``ordered`` sorts.
    """
    if abs(a + b + c + d - 1) > 1e-9:
        raise ValueError("the four shares must add up to one")
    scale = int(math.log2(max(n, 1)))

    def draw(start: int, count: int) -> DataFrame:
        u = v = F.lit(0)
        for level in range(scale):
            p = _coin(seed, F.col("id"), F.lit(level))
            u, v = u * 2 + F.when(p >= a + b, 1).otherwise(0), v * 2 + F.when(((p >= a) & (p < a + b)) | (p >= a + b + c), 1).otherwise(0)
        e = spark.range(start, start + count).select("id", u.cast("bigint").alias("src"), v.cast("bigint").alias("dst"))
        if permute:
            # a bijection of 2^scale labels: odd multiplier modulo a power of two
            mix = lambda x: F.pmod(x * F.lit(0x9E3779B1) + F.lit(seed), F.lit(1 << scale))
            e = e.select("id", mix(F.col("src")).alias("src"), mix(F.col("dst")).alias("dst"))
        if undirected:
            e = e.select("id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        return e

    out, drawn = draw(0, m), m
    if unique:
        out = out.groupBy("src", "dst").agg(F.min("id").alias("id"))
        for _ in range(12):
            lack = m - out.count()
            if lack <= 0:
                break
            out = out.unionByName(draw(drawn, 2 * lack).select("src", "dst", "id")).groupBy("src", "dst").agg(F.min("id").alias("id"))
            drawn += 2 * lack
        out = out.orderBy("id").limit(m)
    out = out.select("src", "dst", F.col("id").alias("eid"))
    return out.orderBy("src", "dst", "eid") if ordered else out


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 1, loops: bool = False) -> DataFrame:
    """Directed edges, each of the n * n pairs with probability ``p``, drawn row by row with geometric gaps."""
    if p <= 0:
        return spark.createDataFrame([], "src bigint, dst bigint, eid bigint")
    most = int(n * p + 12 * math.sqrt(n * p) + 24)
    gap = F.floor(F.log(1 - _coin(seed, F.col("id"), F.col("k"))) / math.log(1 - p)) + 1 if p < 1 else F.lit(1)
    from pyspark.sql import Window

    steps = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), F.lit(min(most, n)))).alias("k")).withColumn("gap", gap.cast("bigint"))
    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    e = steps.withColumn("dst", F.sum("gap").over(w) - 1).filter(F.col("dst") < n).select(F.col("id").alias("src"), "dst")
    if not loops:
        e = e.filter("src <> dst")
    return e.withColumn("eid", F.col("src") * n + F.col("dst"))


def small_world(spark: SparkSession, n: int, k: int, p: float, seed: int = 1) -> DataFrame:
    """A ring in which each vertex links to its next ``k`` ones, each link sent elsewhere with probability ``p``."""
    e = spark.range(n * k).select((F.col("id") / k).cast("bigint").alias("src"), F.pmod((F.col("id") / k).cast("bigint") + 1 + F.col("id") % k, F.lit(n)).alias("ring"), "id")
    other = F.floor(_coin(seed, F.col("id"), F.lit(1)) * n)
    dst = F.when(_coin(seed, F.col("id"), F.lit(0)) < p, other).otherwise(F.col("ring"))
    return e.select("src", dst.cast("bigint").alias("dst"), F.col("id").alias("eid"))


def mesh(spark: SparkSession, x: int, y: int, torus: bool = False) -> DataFrame:
    """Undirected grid edges, right and down; a torus closes the rows and columns."""
    i = spark.range(x * y).select("id", (F.col("id") % x).alias("cx"), F.floor(F.col("id") / x).alias("cy"))
    right = i.filter(F.lit(torus and x > 1) | (F.col("cx") < x - 1)).select(F.col("id").alias("src"), (F.col("cy") * x + (F.col("cx") + 1) % x).alias("dst"))
    down = i.filter(F.lit(torus and y > 1) | (F.col("cy") < y - 1)).select(F.col("id").alias("src"), (((F.col("cy") + 1) % y) * x + F.col("cx")).alias("dst"))
    e = right.unionByName(down)
    return e.withColumn("eid", F.col("src") * (x * y) + F.col("dst"))


def clique_graph(spark: SparkSession, n: int, clique: int, between: float, seed: int = 1) -> DataFrame:
    """Cliques of up to ``clique`` vertices in a row, with a share ``between`` of vertices linked to others."""
    v = spark.range(n).withColumn("c", F.floor(F.col("id") / clique))
    inside = v.select(F.col("id").alias("src"), F.explode(F.sequence(F.col("c") * clique, F.least((F.col("c") + 1) * clique, F.lit(n)) - 1)).alias("dst")).filter("src <> dst")
    across = v.filter(_coin(seed, F.col("id"), F.lit(0)) < between).select(F.col("id").alias("src"), F.floor(_coin(seed, F.col("id"), F.lit(1)) * n).cast("bigint").alias("dst")).filter("src <> dst")
    return inside.unionByName(across).withColumn("eid", F.monotonically_increasing_id())


def weighted(edges: DataFrame, low: int, high: int, seed: int = 1) -> DataFrame:
    """Uniform whole weights from ``low`` to ``high``, both included."""
    return edges.withColumn("weight", F.floor(_coin(seed, F.col("eid")) * (high - low + 1)) + low)
