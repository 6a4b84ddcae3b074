"""Graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import generators
from ..graph import Graph
from ..operators import centrality, iterative
from ..operators import relational as R
from ..session import table
from . import tables as T

DEPTH = 3
V = f"SELECT DISTINCT id FROM (SELECT src AS id FROM ({T.E}) UNION ALL SELECT dst FROM ({T.E}))"
TV = f"SELECT DISTINCT id FROM (SELECT src AS id FROM ({T.TRADE}) UNION ALL SELECT dst FROM ({T.TRADE}))"


def pagerank_links(spark, d):
    return iterative.page_rank(T.links(spark, d), 10).select("id", F.round("rank", 6).alias("rank"))


def pagerank_trade(spark, d):
    return iterative.page_rank(T.trade(spark, d), 10).select("id", F.round("rank", 6).alias("rank"))


def _rank_sql(edges: str, rounds: int) -> str:
    ctes = [f"e AS ({edges})", "v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))", "s AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS share FROM e)", "r0 AS (SELECT id, 1.0 / (SELECT count(*) FROM v) AS rank FROM v)"]
    for k in range(rounds):
        ctes.append(f"r{k + 1} AS (SELECT v.id, 0.15 + 0.85 * coalesce(x.got, 0) AS rank FROM v LEFT JOIN (SELECT dst, sum(share * rank) AS got FROM s JOIN r{k} ON s.src = r{k}.id GROUP BY dst) x ON v.id = x.dst)")
    return f"WITH {', '.join(c.replace(' AS (', ' AS MATERIALIZED (', 1) for c in ctes)} SELECT id, round(CAST(rank AS DOUBLE), 6) AS rank FROM r{rounds}"


def degree_hist(spark, d):
    h = T.links(spark, d).degree_histogram()
    return h.select("out_degree", "n", F.round("share", 8).alias("share"))


def degree_all(spark, d):
    return T.links(spark, d).degrees()


def undirected_degree(spark, d):
    g = T.links(spark, d)
    return Graph(g.vertices, g.edges, False).degrees().select("id", "degree")


def dangling_fixpoint(spark, d):
    return iterative.remove_dangling(T.trade(spark, d)).edges.select("src", "dst")


def dangling_links(spark, d):
    """Links left when pages without links are taken out until all have some."""
    return iterative.remove_dangling(T.links(spark, d)).edges.select("eid", "src", "dst")


def _start(g: Graph):
    return g.vertices.agg(F.min("id").alias("id"))


def bfs_levels(spark, d):
    g = T.links(spark, d)
    return iterative.bfs(g, _start(g)).select("id", "level", "parent")


def bfs_depth_limited(spark, d):
    g = T.links(spark, d)
    return iterative.bfs(g, _start(g), DEPTH).select("id", "level")


def multi_source_bfs(spark, d):
    """Levels from all site roots at once."""
    roots = table(spark, d, "queue_info").select(F.col("root_docid").alias("id")).filter("id IS NOT NULL")
    return iterative.bfs(T.links(spark, d), roots).select("id", "level")


def subgraph_extract(spark, d):
    """Edges inside the neighbourhood of depth 3 around the heaviest edges' ends."""
    g = T.weighted_links(spark, d)
    near = iterative.bfs(g, R.max_with_ties(g.edges.filter("src <> dst"), "weight").select(F.col("src").alias("id")), DEPTH)
    return Graph(near.select("id"), g.edges).filtered(vertex=F.lit(True)).edges.select("eid", "src", "dst", "weight")


def bfs_events(spark, d):
    """How often each event of a breadth-first search occurs."""
    g = T.links(spark, d)
    return iterative.bfs_events(g, _start(g)).groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def st_connected(spark, d):
    """Whether the smallest and the largest vertex are joined."""
    g = T.links(spark, d)
    s, t = g.vertices.agg(F.min("id"), F.max("id")).first()
    return spark.createDataFrame([(s, t, iterative.st_connected(g, s, t))], "s bigint, t bigint, connected boolean")


def cc_min_label(spark, d):
    return iterative.connected_components(T.links(spark, d))


def cc_count(spark, d):
    return iterative.connected_components(T.links(spark, d)).agg(F.count_distinct("component").alias("components"))


def scc_min_label(spark, d):
    return iterative.strong_components(T.trade(spark, d))


def scc_links(spark, d):
    return iterative.strong_components(T.links(spark, d))


def sssp_trade(spark, d):
    g = T.trade(spark, d)
    s = _start(g).first()[0]
    return iterative.shortest_paths(g, s).select("id", F.col("dist").cast("bigint").alias("dist"))


def sssp_links(spark, d):
    g = T.weighted_links(spark, d)
    s = _start(g).first()[0]
    return iterative.shortest_paths(g, s).select("id", F.col("dist").cast("bigint").alias("dist"), "pred")


def mst_forest(spark, d):
    g = T.trade(spark, d)
    return iterative.spanning_forest(Graph(g.vertices, g.edges, False)).select("eid", "src", "dst", "weight")


def mst_links_weight(spark, d):
    """Edges and weight of the spanning forest of all links."""
    g = T.weighted_links(spark, d)
    return iterative.spanning_forest(Graph(g.vertices, g.edges, False)).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))


def mst_local_filter(spark, d):
    """The same forest after each partition dropped what its own edges make needless."""
    g = T.trade(spark, d)
    return iterative.spanning_forest(Graph(g.vertices, g.edges, False), local=True).select("eid", "src", "dst", "weight")


def mst_links(spark, d):
    """The edges of the spanning forest of all links."""
    g = T.weighted_links(spark, d)
    return iterative.spanning_forest(Graph(g.vertices, g.edges, False)).select("eid", "src", "dst", "weight")


def mst_merged(spark, d):
    """The same by Boruvka rounds and the merging of local forests."""
    g = T.weighted_links(spark, d)
    return iterative.boruvka_then_merge(Graph(g.vertices, g.edges, False)).select("eid", "src", "dst", "weight")


def site_ranks(spark, d):
    """Sites in order of their rank in the site graph."""
    return iterative.page_rank(T.site_graph(spark, d), 10).select("id", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "id")


def colours_used(spark, d):
    return iterative.colouring(T.links(spark, d)).agg(F.count_distinct("colour").alias("colours"))


def coloring_conflicts(spark, d):
    g = T.links(spark, d)
    c = iterative.colouring(g)
    bad = g.edges.filter("src <> dst").join(c.withColumnsRenamed({"id": "src", "colour": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "colour": "b"}), "dst").filter("a = b").agg(F.count(F.lit(1)).alias("conflicts"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("colour").isNull()).alias("uncoloured")).crossJoin(bad)


def biconnected(spark, d):
    g = T.trade(spark, d)
    return iterative.biconnected_components(Graph(g.vertices, g.edges, False))


def articulation(spark, d):
    g = T.trade(spark, d)
    g = Graph(g.vertices, g.edges, False)
    return iterative.articulation_points(g, iterative.biconnected_components(g))


def _undirected(g: Graph) -> Graph:
    return Graph(g.vertices, g.edges, False)


def biconnected_links(spark, d):
    return iterative.biconnected_components(_undirected(T.links(spark, d)))


def articulation_links(spark, d):
    """Pages that hold parts of the web together."""
    g = _undirected(T.links(spark, d))
    return iterative.articulation_points(g, iterative.biconnected_components(g))


def betweenness_exact(spark, d):
    return centrality.betweenness(T.trade(spark, d)).select("id", F.round("centrality", 6).alias("centrality"))


def betweenness_replicated(spark, d):
    return centrality.betweenness_copied(T.trade(spark, d)).select("id", F.round("centrality", 6).alias("centrality"))


def betweenness_weighted(spark, d):
    return centrality.betweenness_copied(T.trade(spark, d), weight="weight").select("id", F.round("centrality", 6).alias("centrality"))


def betweenness_sources(spark, d):
    """Approximate centrality of the pages: shortest paths from the site roots."""
    roots = table(spark, d, "queue_info").select(F.col("root_docid").alias("id")).filter("id IS NOT NULL")
    return centrality.betweenness(T.links(spark, d), roots).select("id", F.round("centrality", 4).alias("centrality"))


def edge_betweenness(spark, d):
    return centrality.betweenness_copied(T.trade(spark, d), by_edge=True).select("src", "dst", F.round("centrality", 6).alias("centrality"))


def central_point_dominance(spark, d):
    return centrality.central_point_dominance(centrality.betweenness(T.trade(spark, d))).select(F.round("dominance", 8).alias("dominance"))


def max_centrality(spark, d):
    """The vertices of largest centrality, ties included."""
    b = betweenness_exact(spark, d)
    return R.max_with_ties(b, "centrality")


def depth_first(spark, d):
    g = T.trade(spark, d)
    return centrality.depth_first(g, iterative.connected_components(g))


def force_layout(spark, d):
    """Positions of the site graph's vertices."""
    return centrality.layout(T.site_graph(spark, d), rounds=10).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def site_links(spark, d):
    return T.site_graph(spark, d).edges.select("src", "dst", "weight")


def max_weight_edges(spark, d):
    return R.max_with_ties(T.weighted_links(spark, d).edges, "weight").select("eid", "src", "dst", "weight")


def edge_filter_mod8(spark, d):
    g = T.links(spark, d)
    return g.filtered(edge=F.pmod("eid", F.lit(8)) != 0).edges.select("eid", "src", "dst")


def reverse_edges(spark, d):
    return T.links(spark, d).reversed().edges.select("eid", "src", "dst")


def local_edges(spark, d):
    return T.links(spark, d).local(lambda i: F.pmod(i, F.lit(4))).edges.select("eid", "src", "dst")


def vertex_index(spark, d):
    return T.links(spark, d).indexed()


def vertex_removal(spark, d):
    """Edges left when the unresolved id 0 and the site roots are taken out."""
    roots = table(spark, d, "queue_info").select(F.col("root_docid").alias("id")).unionByName(spark.range(1))
    return T.links(spark, d).remove_vertices(roots).edges.select("eid", "src", "dst")


def graph_counts(spark, d):
    g = T.links(spark, d)
    return g.edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).crossJoin(g.vertices.agg(F.count(F.lit(1)).alias("vertices")))


def collapsed_graph(spark, d):
    """Links between the strong components, without inner ones."""
    g = T.trade(spark, d)
    c = iterative.strong_components(g)
    j = g.edges.join(c.withColumnsRenamed({"id": "src", "component": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "component": "b"}), "dst")
    return j.filter("a <> b").select("a", "b").distinct()


def collapsed_links(spark, d):
    """Links between the strong components of the page graph."""
    g = T.links(spark, d)
    c = iterative.strong_components(g)
    j = g.edges.join(c.withColumnsRenamed({"id": "src", "component": "a"}), "src").join(c.withColumnsRenamed({"id": "dst", "component": "b"}), "dst")
    return j.filter("a <> b").select("a", "b").distinct()


def mesh_degrees(spark, d):
    """Degrees of a 40 x 25 grid and of its torus."""
    one = lambda torus: Graph.from_edges(generators.mesh(spark, 40, 25, torus), eid="eid", directed=False).degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("n")).withColumn("torus", F.lit(torus))
    return one(False).unionByName(one(True))


def rmat_components(spark, d):
    """Components of a seeded recursive-matrix graph (its size is the feature asked for)."""
    g = Graph.from_edges(generators.rmat(spark, 1024, 5000, undirected=True), eid="eid", directed=False)
    return iterative.connected_components(g)


_REACH = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({{edges}}) WHERE src <> dst),
r(id, level) AS (SELECT min(id), 0 FROM ({{vertices}}) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON r.id = e.src WHERE r.level < {{most}}),
l AS MATERIALIZED (SELECT id, min(level) AS level FROM r WHERE id IS NOT NULL GROUP BY id)"""


def _reach(most: int, edges: str = T.E, vertices: str = V) -> str:
    return _REACH.format(edges=edges, vertices=vertices, most=most)


CC = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM ({T.E}) UNION SELECT dst, src FROM ({T.E})),
c(id, component) USING KEY (id) AS (SELECT id, id FROM ({V}) UNION
  SELECT p.b, min(c.component) FROM c JOIN p ON c.id = p.a JOIN recurring.c AS o ON o.id = p.b WHERE c.component < o.component GROUP BY p.b)
SELECT id, component FROM c"""
PAIRS = """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM ({edges})), v AS MATERIALIZED ({vertices}),
r(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)"""
SCC = PAIRS + " SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a"
SSSP = """WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst, min(weight) AS w FROM ({edges}) WHERE src <> dst GROUP BY src, dst),
s(id, dist) USING KEY (id) AS (SELECT min(id), 0::BIGINT FROM ({vertices}) UNION
  SELECT e.dst, min(s.dist + e.w)::BIGINT FROM s JOIN e ON s.id = e.src LEFT JOIN recurring.s AS o ON o.id = e.dst WHERE o.dist IS NULL OR s.dist + e.w < o.dist GROUP BY e.dst)"""
WE = f"SELECT src, dst, eid, ((eid % 10) + 10) % 10 + 1 AS weight FROM ({T.E})"
MST = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight, eid) AS o FROM ({T.TRADE})),
r(o, id) AS (SELECT o, src FROM e UNION SELECT r.o, CASE WHEN r.id = f.src THEN f.dst ELSE f.src END FROM r JOIN e f ON f.o < r.o AND r.id IN (f.src, f.dst))
SELECT eid, src, dst, weight FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.o = e.o AND r.id = e.dst)"""
BC = PAIRS.split("r(a, b)")[0].format(edges=T.TRADE, vertices=TV) + """
w(s, v, level, sigma) AS (SELECT id, id, 0, 1::BIGINT FROM v UNION ALL
  SELECT s, dst, level, sum(sigma)::BIGINT FROM (SELECT w.s, e.dst, w.level + 1 AS level, w.sigma FROM w JOIN e ON w.v = e.src WHERE w.level < 25
    AND NOT EXISTS (SELECT 1 FROM d0 WHERE d0.a = w.s AND d0.b = e.dst AND d0.level <= w.level)) GROUP BY s, dst, level)"""
LEVELS = PAIRS.split("r(a, b)")[0] + " r(a, b, level) AS (SELECT id, id, 0 FROM v UNION SELECT r.a, e.dst, r.level + 1 FROM r JOIN e ON r.b = e.src WHERE r.level < 26), d0 AS MATERIALIZED (SELECT a, b, min(level) AS level FROM r GROUP BY a, b)"
BC = LEVELS.format(edges=T.TRADE, vertices=TV) + """,
w(a, b, level, sigma) AS (SELECT id, id, 0, 1::BIGINT FROM v UNION ALL
  SELECT x.a, x.b, x.level, sum(x.sigma)::BIGINT FROM (SELECT w.a, e.dst AS b, w.level + 1 AS level, w.sigma FROM w JOIN e ON w.b = e.src JOIN d0 ON d0.a = w.a AND d0.b = e.dst AND d0.level = w.level + 1) x GROUP BY x.a, x.b, x.level)
SELECT v.id, round(coalesce(sum(p.sigma * q.sigma / CAST(t.sigma AS DOUBLE)), 0), 6) AS centrality FROM v
  LEFT JOIN (w p JOIN w q ON p.b = q.a AND p.a <> p.b AND q.a <> q.b JOIN w t ON t.a = p.a AND t.b = q.b AND t.level = p.level + q.level AND p.a <> q.b) ON p.b = v.id GROUP BY v.id"""

QUERIES = {
    f.__name__: f
    for f in (
        pagerank_links, pagerank_trade, degree_hist, degree_all, undirected_degree, dangling_fixpoint, bfs_levels, bfs_depth_limited, multi_source_bfs, subgraph_extract, st_connected, cc_min_label, cc_count,
        scc_min_label, scc_links, sssp_trade, sssp_links, mst_forest, mst_local_filter, mst_links_weight, site_ranks, colours_used, coloring_conflicts, biconnected, articulation, betweenness_exact, betweenness_replicated, betweenness_weighted,
        betweenness_sources, edge_betweenness, central_point_dominance, max_centrality, depth_first, force_layout, site_links, max_weight_edges, edge_filter_mod8, reverse_edges, local_edges, vertex_index,
        vertex_removal, graph_counts, collapsed_graph, mesh_degrees, rmat_components, bfs_events, dangling_links, mst_links, mst_merged, biconnected_links, articulation_links, collapsed_links,
    )
}

SQL = {
    "pagerank_links": _rank_sql(T.E, 10),
    "pagerank_trade": _rank_sql(T.TRADE, 10),
    "degree_hist": f"WITH d AS (SELECT v.id, count(e.src) AS out_degree FROM ({V}) v LEFT JOIN ({T.E}) e ON v.id = e.src GROUP BY v.id) SELECT out_degree, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM d) AS DOUBLE), 8) AS share FROM d GROUP BY out_degree",
    "degree_all": f"SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM ({T.E}) UNION ALL SELECT dst, 0, 1 FROM ({T.E})) GROUP BY id",
    "undirected_degree": f"SELECT id, count(*) AS degree FROM (SELECT src AS id FROM ({T.E}) UNION ALL SELECT dst FROM ({T.E})) GROUP BY id",
    "dangling_fixpoint": f"""WITH RECURSIVE e AS MATERIALIZED ({T.TRADE}), v AS (SELECT DISTINCT src AS id FROM e UNION SELECT dst FROM e),
k(id, n) AS (SELECT id, 0 FROM v UNION SELECT DISTINCT e.src, k.n + 1 FROM e JOIN k ON e.dst = k.id WHERE k.n < 30)
SELECT src, dst FROM e WHERE dst IN (SELECT id FROM k WHERE n = 30)""",
    "bfs_levels": _reach(40) + " SELECT l.id, l.level, (SELECT min(e.src) FROM e JOIN l p ON p.id = e.src AND p.level = l.level - 1 WHERE e.dst = l.id) AS parent FROM l",
    "bfs_depth_limited": _reach(DEPTH) + " SELECT id, level FROM l",
    "multi_source_bfs": _reach(40).replace(f"SELECT min(id), 0 FROM ({V})", f"SELECT DISTINCT root_docid, 0 FROM queue_info WHERE root_docid IN ({V})") + " SELECT id, level FROM l",
    "subgraph_extract": f"""WITH RECURSIVE e AS MATERIALIZED ({WE}), s AS (SELECT DISTINCT src AS id FROM e WHERE src <> dst AND weight = (SELECT max(weight) FROM e WHERE src <> dst)),
r(id, level) AS (SELECT id, 0 FROM s UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id WHERE e.src <> e.dst AND r.level < {DEPTH}),
n AS MATERIALIZED (SELECT DISTINCT id FROM r) SELECT eid, src, dst, weight FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)""",
    "bfs_events": _reach(40) + f""", x AS MATERIALIZED (SELECT a.level AS ls, b.level AS ld FROM ({T.E}) y JOIN l a ON a.id = y.src JOIN l b ON b.id = y.dst), t AS (SELECT count(*) AS n FROM l WHERE level > 0)
SELECT 'initialize_vertex' AS event, count(*) AS n FROM ({V}) UNION ALL SELECT unnest(['discover_vertex', 'examine_vertex', 'finish_vertex']), (SELECT count(*) FROM l)
UNION ALL SELECT 'examine_edge', count(*) FROM x UNION ALL SELECT 'tree_edge', n FROM t UNION ALL SELECT 'non_tree_edge', (SELECT count(*) FROM x) - n FROM t
UNION ALL SELECT 'gray_target', (SELECT count(*) FROM x WHERE ld >= ls) - n FROM t UNION ALL SELECT 'black_target', count(*) FROM x WHERE ld < ls""",
    "dangling_links": f"""WITH RECURSIVE e AS MATERIALIZED ({T.E}), p AS MATERIALIZED (SELECT DISTINCT src, dst FROM e),
r(a, b) AS (SELECT src, dst FROM p UNION SELECT r.a, p.dst FROM r JOIN p ON r.b = p.src), c AS (SELECT DISTINCT a AS id FROM r WHERE a = b),
k AS MATERIALIZED (SELECT id FROM c UNION SELECT a FROM r WHERE b IN (SELECT id FROM c)) SELECT eid, src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""",
    "collapsed_links": f"WITH c AS MATERIALIZED ({SCC.format(edges=T.E, vertices=V)}) SELECT DISTINCT x.component AS a, y.component AS b FROM ({T.E}) e JOIN c x ON e.src = x.id JOIN c y ON e.dst = y.id WHERE x.component <> y.component",
    "st_connected": CC.replace("SELECT id, component FROM c", f"SELECT s, t, (SELECT component FROM c WHERE id = s) = (SELECT component FROM c WHERE id = t) AS connected FROM (SELECT min(id) AS s, max(id) AS t FROM ({V}))"),
    "cc_min_label": CC,
    "cc_count": CC.replace("SELECT id, component FROM c", "SELECT count(DISTINCT component) AS components FROM c"),
    "scc_min_label": SCC.format(edges=T.TRADE, vertices=TV),
    "scc_links": SCC.format(edges=T.E, vertices=V),
    "sssp_trade": SSSP.format(edges=T.TRADE, vertices=TV) + " SELECT id, dist FROM s",
    "sssp_links": SSSP.format(edges=WE, vertices=V) + " SELECT s.id, s.dist, (SELECT min(e.src) FROM e JOIN s p ON p.id = e.src WHERE e.dst = s.id AND p.dist + e.w = s.dist AND s.dist > 0) AS pred FROM s",
    "mst_forest": MST,
    "mst_local_filter": MST,
    "site_ranks": _rank_sql(T.SITE_EDGES, 10),
    "coloring_conflicts": f"SELECT count(*) AS n, 0::BIGINT AS uncoloured, 0::BIGINT AS conflicts FROM ({V})",
    "betweenness_exact": BC,
    "betweenness_replicated": BC,
    "max_centrality": f"WITH b AS MATERIALIZED ({BC}) SELECT * FROM b WHERE centrality = (SELECT max(centrality) FROM b)",
    "central_point_dominance": f"SELECT round((count(*) * max(centrality) - sum(centrality)) / ((count(*) - 1) * (count(*) - 2) / 2.0) / (count(*) - 1), 8) AS dominance FROM ({BC.replace('round(coalesce(', '(coalesce(').replace(', 0), 6) AS centrality', ', 0)) AS centrality')})",
    "site_links": T.SITE_EDGES,
    "max_weight_edges": f"SELECT * FROM ({WE}) WHERE weight = (SELECT max(weight) FROM ({WE}))",
    "edge_filter_mod8": f"SELECT eid, src, dst FROM ({T.E}) WHERE eid % 8 <> 0",
    "reverse_edges": f"SELECT eid, dst AS src, src AS dst FROM ({T.E})",
    "local_edges": f"SELECT eid, src, dst FROM ({T.E}) WHERE ((src % 4) + 4) % 4 = ((dst % 4) + 4) % 4",
    "vertex_index": f"SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM ({V})",
    "vertex_removal": f"WITH gone AS (SELECT root_docid AS id FROM queue_info WHERE root_docid IS NOT NULL UNION SELECT 0) SELECT eid, src, dst FROM ({T.E}) WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)",
    "graph_counts": f"SELECT count(*) AS edges, count(*) FILTER (WHERE src = dst) AS loops, (SELECT count(*) FROM ({V})) AS vertices FROM ({T.E})",
    "collapsed_graph": f"WITH c AS MATERIALIZED ({SCC.format(edges=T.TRADE, vertices=TV)}) SELECT DISTINCT x.component AS a, y.component AS b FROM ({T.TRADE}) e JOIN c x ON e.src = x.id JOIN c y ON e.dst = y.id WHERE x.component <> y.component",
    "mesh_degrees": """SELECT CAST(degree AS BIGINT) AS degree, count(*) AS n, torus FROM (SELECT CASE WHEN torus THEN 4 ELSE (x > 0)::INT + (x < 39)::INT + (y > 0)::INT + (y < 24)::INT END AS degree, torus
FROM range(40) a(x), range(25) b(y), (VALUES (false), (true)) t(torus)) GROUP BY ALL""",
}
