"""Graphs as a pair of DataFrames: vertices ``id`` and edges ``src``, ``dst``, ``eid`` and attributes.

Parallel edges and self loops are kept.  Every operation returns a new graph; nothing is changed in
place.  Ids are BIGINT; vertices that occur only as ends of edges are added by ``from_edges``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True

    # construction -----------------------------------------------------------------------------

    @staticmethod
    def from_edges(edges: DataFrame, src: str = "src", dst: str = "dst", eid: str | None = None, n: int | None = None, directed: bool = True) -> Graph:
        """A graph of an edge table; rows with a null end are no edges.  ``n`` adds the ids 0..n-1."""
        wanted = {src: "src", dst: "dst"} | ({eid: "eid"} if eid else {})
        e = edges.drop(*({"src", "dst", "eid"} - set(wanted))).withColumnsRenamed(wanted).filter("src IS NOT NULL AND dst IS NOT NULL")
        if not eid:
            # the same on every run, unlike a row number of the plan; parallel edges by their rank
            rank = F.row_number().over(Window.partitionBy("src", "dst").orderBy(*[c for c in e.columns if c not in ("src", "dst")] or [F.lit(0)]))
            e = e.withColumn("eid", F.xxhash64("src", "dst", rank))
        v = e.select(F.explode(F.array("src", "dst")).alias("id"))
        if n is not None:
            v = v.unionByName(edges.sparkSession.range(n))
        return Graph(v.distinct(), e, directed)

    @staticmethod
    def empty(spark: SparkSession, n: int, directed: bool = True) -> Graph:
        """``n`` isolated vertices."""
        return Graph(spark.range(n), spark.createDataFrame([], "src bigint, dst bigint, eid bigint"), directed)

    def packed(self, partitions: int | None = None) -> Graph:
        """Edges stored by source, sorted inside each partition: the compressed-row layout."""
        e = self.edges.repartition(partitions, "src") if partitions else self.edges.repartition("src")
        return replace(self, edges=e.sortWithinPartitions("src", "dst", "eid"))

    def save(self, path: str) -> None:
        self.vertices.write.parquet(f"{path}/vertices")
        self.edges.write.parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str, directed: bool = True) -> Graph:
        return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), directed)

    # views ------------------------------------------------------------------------------------

    def reversed(self) -> Graph:
        return replace(self, edges=self.edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))

    def filtered(self, edge: Column | None = None, vertex: Column | None = None) -> Graph:
        """The subgraph of the edges and vertices that fulfil the predicates, evaluated lazily."""
        v = self.vertices if vertex is None else self.vertices.filter(vertex)
        e = self.edges if edge is None else self.edges.filter(edge)
        if vertex is not None:
            e = e.join(v.select(F.col("id").alias("src")), "src", "left_semi").join(v.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(v, e, self.directed)

    def local(self, owner) -> Graph:
        """Only the edges whose ends have the same owner; ``owner`` maps an id column to its owner."""
        return replace(self, edges=self.edges.filter(owner(F.col("src")) == owner(F.col("dst"))))

    def indexed(self) -> DataFrame:
        """Vertices with a dense global ``index`` by id: ranges are counted first, so no task sees them all."""
        ordered = self.vertices.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()).persist()
        sizes = sorted((r["part"], r["count"]) for r in ordered.groupBy("part").count().collect())
        base, bases = 0, []
        for p, c in sizes:
            bases.append((p, base))
            base += c
        rank = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
        starts = ordered.sparkSession.createDataFrame(bases, "part int, base bigint")
        return ordered.withColumn("rank", rank).join(F.broadcast(starts), "part").select("id", (F.col("base") + F.col("rank")).alias("index"))

    def arcs(self) -> DataFrame:
        """Edges as they are walked: both directions of an undirected edge, sharing its ``eid``."""
        if self.directed:
            return self.edges
        back = self.edges.filter("src <> dst").withColumns({"src": F.col("dst"), "dst": F.col("src")})
        return self.edges.unionByName(back)

    # counts and access ------------------------------------------------------------------------

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def edge(self, u: int, v: int) -> DataFrame:
        return self.arcs().filter((F.col("src") == u) & (F.col("dst") == v))

    def out_edges(self, u: int) -> DataFrame:
        return self.arcs().filter(F.col("src") == u)

    def in_edges(self, u: int) -> DataFrame:
        return self.arcs().filter(F.col("dst") == u)

    def adjacent(self, u: int) -> DataFrame:
        return self.out_edges(u).select(F.col("dst").alias("id"))

    def degrees(self) -> DataFrame:
        """``id``, ``out_degree``, ``in_degree``, ``degree`` of all vertices.

        Undirected: all three agree and a self loop counts two; directed: degree is out plus in.
        """
        one = lambda c, o, i: F.struct(F.col(c).alias("id"), F.lit(o).alias("o"), F.lit(i).alias("i"))
        ends = self.edges.select(F.inline(F.array(one("src", 1, 0), one("dst", 0, 1))))
        got = self.vertices.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")).unionByName(ends).groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        both = F.col("o") + F.col("i")
        return got.select("id", (F.col("o") if self.directed else both).alias("out_degree"), (F.col("i") if self.directed else both).alias("in_degree"), both.alias("degree"))

    def degree_histogram(self) -> DataFrame:
        """``out_degree``, ``n`` and ``share`` of the vertices with it."""
        h = self.degrees().groupBy("out_degree").agg(F.count(F.lit(1)).alias("n"))
        total = h.agg(F.sum("n").alias("total"))
        return h.crossJoin(F.broadcast(total)).select("out_degree", "n", (F.col("n") / F.col("total")).alias("share"))

    # changes ----------------------------------------------------------------------------------

    def add_vertices(self, more: DataFrame) -> Graph:
        return replace(self, vertices=self.vertices.unionByName(more.select("id")).distinct())

    def add_edges(self, more: DataFrame) -> Graph:
        """More edges; ends that are no vertices yet become vertices."""
        g = replace(self, edges=self.edges.unionByName(more, allowMissingColumns=True))
        return g.add_vertices(more.select(F.explode(F.array("src", "dst")).alias("id")))

    def remove_edges(self, gone: DataFrame) -> Graph:
        """Without the edges of ``gone``: by ``eid`` if it has one, else all edges between its ends."""
        key = ["eid"] if "eid" in gone.columns else ["src", "dst"]
        return replace(self, edges=self.edges.join(gone.select(*key), key, "left_anti"))

    def remove_edges_if(self, predicate: Column) -> Graph:
        return replace(self, edges=self.edges.filter(~F.coalesce(predicate, F.lit(False))))

    def clear_vertices(self, ids: DataFrame) -> Graph:
        """Without any edge at the given vertices, which stay."""
        e = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti")
        return replace(self, edges=e.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti"))

    def remove_vertices(self, ids: DataFrame) -> Graph:
        return replace(self.clear_vertices(ids), vertices=self.vertices.join(ids.select("id"), "id", "left_anti"))

    def clear(self) -> Graph:
        return Graph(self.vertices.limit(0), self.edges.limit(0), self.directed)

    # properties and placement -----------------------------------------------------------------

    def put(self, values: DataFrame, column: str, reduce=F.max) -> Graph:
        """Vertices with ``column`` from (id, value) rows; several values of an id are reduced."""
        got = values.groupBy("id").agg(reduce(column).alias(column))
        return replace(self, vertices=self.vertices.drop(column).join(got, "id", "left"))

    def get(self, ids: DataFrame, column: str, default) -> DataFrame:
        """The value of each asked id, the default for unknown ones."""
        return ids.join(self.vertices.select("id", column), "id", "left").withColumn(column, F.coalesce(column, F.lit(default)))

    def redistribute(self, owner: DataFrame, parts: int) -> Graph:
        """Vertices and out-edges placed by ``owner`` (id, part)."""
        v = self.vertices.join(owner, "id", "left").repartition(parts, "part").drop("part")
        e = self.edges.join(owner.withColumnRenamed("id", "src"), "src", "left").repartition(parts, "part").drop("part")
        return Graph(v, e, self.directed)


def named_graph(names: DataFrame, links: DataFrame, name: str, src: str, dst: str, defaults: dict) -> tuple[DataFrame, DataFrame]:
    """A graph over natural keys: known vertices, missing ends added with ``defaults``, integer ids.

    Returns (vertices with ``id``, edges with ``src`` and ``dst``); ids are hashes of the names.
    """
    ends = links.select(F.explode(F.array(src, dst)).alias(name)).filter(F.col(name).isNotNull()).distinct()
    missing = ends.join(names.select(name), name, "left_anti")
    for c in names.columns:
        if c != name:
            missing = missing.withColumn(c, F.lit(defaults.get(c)).cast(names.schema[c].dataType))
    vertices = names.unionByName(missing).withColumn("id", F.xxhash64(name))
    edges = links.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).withColumn("src", F.xxhash64(src)).withColumn("dst", F.xxhash64(dst))
    return vertices, edges


#: Ways to place ids on ``p`` parts: id column -> part column.
PLACEMENTS = {
    "block": lambda i, n, p: F.floor(i * p / n),
    "cyclic": lambda i, n, p, b=1: F.pmod(F.floor(i / b), F.lit(p)),
    "random": lambda i, n, p: F.pmod(F.xxhash64(i), F.lit(p)),
    "grid": lambda i, n, p, w=8: F.pmod(F.floor(i / w / w) * F.lit(w) + F.floor(F.pmod(i, F.lit(w * w)) / w), F.lit(p)),
}
