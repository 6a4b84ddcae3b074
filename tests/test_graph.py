"""Closed-form graphs, sequential twins and invariants."""

import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from gossamer import generators
from gossamer.graph import PLACEMENTS, Graph, named_graph
from gossamer.operators import centrality, iterative


def graph(spark, pairs, directed=True, weights=None):
    rows = [(u, v, k, (weights or [1] * len(pairs))[k]) for k, (u, v) in enumerate(pairs)]
    return Graph.from_edges(spark.createDataFrame(rows, "src bigint, dst bigint, eid bigint, weight bigint"), eid="eid", directed=directed)


def pairs_of(df, a, b):
    return {r[a]: r[b] for r in df.collect()}


def test_page_rank_of_four_pages(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)])
    got = pairs_of(iterative.page_rank(g, 50), "id", "rank")
    for i, want in enumerate((1.49011, 0.783296, 1.5766, 0.15)):
        assert got[i] == pytest.approx(want, rel=0.01)
    assert sum(got.values()) == pytest.approx(4, rel=0.01)
    same = pairs_of(iterative.page_rank(g, 12, tol=0.01, normalize=True), "id", "rank")
    assert sum(same.values()) == pytest.approx(1)


def test_forest_weight(spark):
    w = [(0, 2, 1), (1, 3, 1), (1, 4, 2), (2, 1, 7), (2, 3, 3), (3, 4, 1), (4, 0, 1), (4, 1, 1)]
    g = graph(spark, [(a, b) for a, b, _ in w], False, [x for *_, x in w])
    rows = iterative.spanning_forest(g).collect()
    assert (len(rows), sum(r.weight for r in rows)) == (4, 4)


BICOMPONENTS = [
    ([(0, 1), (0, 2), (1, 3), (2, 4), (3, 4), (4, 5), (4, 6), (5, 6)], [0, 0, 0, 0, 0, 1, 1, 1]),
    ([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 2), (3, 6), (6, 7), (7, 8), (8, 6)], [0, 0, 0, 1, 1, 1, 1, 2, 3, 3, 3]),
]


@pytest.mark.parametrize("k", [0, 1])
def test_biconnected_components(spark, k):
    pairs, want = BICOMPONENTS[k]
    got = pairs_of(iterative.biconnected_components(graph(spark, pairs, False)), "eid", "component")
    split = lambda label: {frozenset(e for e in range(len(pairs)) if label[e] == x) for x in set(label.values())}
    assert split(got) == split(dict(enumerate(want)))
    assert all(got[e] == min(x for x in got if got[x] == got[e]) for e in got)


def test_st_connected(spark):
    a = graph(spark, [(0, 0), (0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (5, 4), (5, 5)], False)
    b = graph(spark, [(0, 1), (0, 2), (0, 3), (3, 1), (4, 3), (1, 4), (2, 4), (2, 5), (5, 5)], False)
    assert not iterative.st_connected(a, 0, 5)
    assert iterative.st_connected(b, 0, 5)
    assert iterative.st_connected(b, 3, 3)


def random_pairs(spark):
    e = generators.weighted(generators.erdos_renyi(spark, 60, 0.05, 3), 1, 9)
    return [(r.src, r.dst, r.eid, r.weight) for r in e.collect()]


def reach(pairs, s):
    seen, todo = {s}, [s]
    while todo:
        u = todo.pop()
        for a, b in pairs:
            if a == u and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_components_and_paths_against_sequential(spark):
    rows = random_pairs(spark)
    pairs = [(a, b) for a, b, *_ in rows]
    g = Graph.from_edges(spark.createDataFrame(rows, "src bigint, dst bigint, eid bigint, weight bigint"), eid="eid")
    nodes = {x for p in pairs for x in p}
    both = pairs + [(b, a) for a, b in pairs]
    assert pairs_of(iterative.connected_components(g), "id", "component") == {v: min(reach(both, v)) for v in nodes}
    to = {v: reach(pairs, v) for v in nodes}
    assert pairs_of(iterative.strong_components(g), "id", "component") == {v: min(u for u in to[v] if v in to[u]) for v in nodes}
    start = min(nodes)
    dist, heap = {}, [(0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in dist:
            continue
        dist[u] = d
        for a, b, _, w in rows:
            if a == u:
                heapq.heappush(heap, (d + w, b))
    assert pairs_of(iterative.shortest_paths(g, start), "id", "dist") == dist
    with pytest.raises(ValueError):
        iterative.shortest_paths(Graph(g.vertices, g.edges.withColumn("weight", F.lit(-1))), start)
    levels = pairs_of(iterative.bfs(g, spark.createDataFrame([(start,)], "id bigint")), "id", "level")
    assert set(levels) == to[start] and all(levels[b] <= levels[a] + 1 for a, b in pairs if a in levels)
    colour = pairs_of(iterative.colouring(g), "id", "colour")
    assert all(colour[a] != colour[b] for a, b in pairs if a != b) and None not in colour.values()


def test_betweenness_against_path_counting(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (0, 4), (4, 3), (3, 5), (5, 6), (2, 6), (6, 0)]
    g = graph(spark, pairs)
    nodes = {x for p in pairs for x in p}

    def paths(s, t):
        best, todo = [], [[s]]
        while todo and not best:
            nxt = []
            for p in todo:
                for a, b in pairs:
                    if a == p[-1] and b not in p:
                        (best if b == t else nxt).append([*p, b])
            todo = nxt
        return best

    want = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        found = paths(s, t)
        for v in nodes - {s, t}:
            if found:
                want[v] += sum(v in p for p in found) / len(found)
    assert pairs_of(centrality.betweenness(g), "id", "centrality") == pytest.approx(want)
    assert pairs_of(centrality.betweenness_copied(g), "id", "centrality") == pytest.approx(want)
    assert pairs_of(centrality.betweenness_copied(g, weight="weight"), "id", "centrality") == pytest.approx(want)


def test_depth_first_and_layout(spark):
    g = graph(spark, [(0, 1), (0, 2), (0, 3), (3, 1), (4, 3), (1, 4), (2, 4), (2, 5), (5, 5)], False)
    got = pairs_of(centrality.depth_first(g, iterative.connected_components(g)), "id", "parent")
    assert got == {0: None, 1: 0, 3: 1, 4: 3, 2: 4, 5: 2}
    for r in centrality.layout(g, 50, 40, 3).collect():
        assert 0 <= r.x <= 50 and 0 <= r.y <= 40


def test_graph_changes_and_views(spark):
    g = graph(spark, [(0, 1), (1, 1), (1, 2), (1, 2)])
    deg = {r.id: (r.out_degree, r.in_degree, r.degree) for r in g.degrees().collect()}
    assert deg == {0: (1, 0, 1), 1: (3, 2, 5), 2: (0, 2, 2)}
    assert pairs_of(Graph(g.vertices, g.edges, False).degrees(), "id", "degree") == {0: 1, 1: 5, 2: 2}
    assert g.remove_edges(spark.createDataFrame([(1, 2)], "src bigint, dst bigint")).num_edges() == 2
    assert g.remove_vertices(spark.createDataFrame([(1,)], "id bigint")).num_vertices() == 2
    assert g.add_edges(spark.createDataFrame([(7, 8, 9)], "src bigint, dst bigint, eid bigint")).num_vertices() == 5
    assert g.clear().num_edges() == 0 and Graph.empty(spark, 3).num_vertices() == 3
    assert {(r["id"], r["index"]) for r in g.indexed().collect()} == {(0, 0), (1, 1), (2, 2)}
    assert iterative.remove_dangling(g).edges.filter("dst = 2").isEmpty()
    put = g.put(spark.createDataFrame([(0, 5), (0, 7)], "id bigint, x int"), "x")
    assert pairs_of(put.get(spark.createDataFrame([(0,), (9,)], "id bigint"), "x", -1), "id", "x") == {0: 7, 9: -1}
    for f in PLACEMENTS.values():
        assert spark.range(100).select(f(F.col("id"), 100, 4).alias("p")).filter("p < 0 OR p > 3").isEmpty()


def test_named_graph_adds_missing_ends(spark):
    cities = spark.createDataFrame([("Bloomington", 69291), ("Chicago", 9500000)], "name string, population int")
    roads = spark.createDataFrame([("Chicago", "Bloomington"), ("Chicago", "Cincinnati")], "a string, b string")
    v, e = named_graph(cities, roads, "name", "a", "b", {"population": -1})
    assert pairs_of(v, "name", "population")["Cincinnati"] == -1 and e.count() == 2


def test_generators(spark):
    m = Graph.from_edges(generators.mesh(spark, 7, 5, True), eid="eid", directed=False).degrees()
    assert {r.degree for r in m.collect()} == {4}
    r = generators.rmat(spark, 256, 900, unique=True, ordered=True)
    assert r.count() == r.select("src", "dst").distinct().count() == 900
    assert {x.weight for x in generators.weighted(r, 2, 4).collect()} == {2, 3, 4}
    n = generators.erdos_renyi(spark, 200, 0.1).count()
    assert 3000 < n < 5000
    assert generators.small_world(spark, 50, 3, 0.0).count() == 150
    assert generators.clique_graph(spark, 20, 5, 0.0).count() == 80


def test_empty_graph(spark):
    g = Graph.empty(spark, 0)
    assert iterative.page_rank(g, 2).isEmpty() and iterative.connected_components(g).isEmpty() and iterative.strong_components(g).isEmpty()
    assert iterative.colouring(g).isEmpty() and g.degrees().isEmpty()


def test_search_events(spark):
    e = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 3), (2, 3, 4), (3, 0, 5), (0, 1, 6), (4, 0, 7), (1, 1, 8)], "src bigint, dst bigint, eid bigint")
    g = Graph.from_edges(e, eid="eid")
    source = spark.createDataFrame([(0,)], "id bigint")
    got = iterative.bfs_events(g, source)
    n = {r["event"]: r["count"] for r in got.groupBy("event").count().collect()}
    assert n == {"initialize_vertex": 5, "discover_vertex": 4, "examine_vertex": 4, "finish_vertex": 4, "examine_edge": 7, "tree_edge": 3, "non_tree_edge": 4, "gray_target": 3, "black_target": 1}
    assert sorted(r.eid for r in got.filter("event = 'tree_edge'").collect()) == [1, 2, 3]
    shallow = iterative.bfs_events(g, source, 1)
    assert shallow.filter("event = 'examine_vertex'").count() == 1 and shallow.filter("event = 'discover_vertex'").count() == 3


def test_forests_merged_along_a_tree_are_the_same(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(60), rng.randrange(60), rng.randrange(5), k) for k in range(400)]
    g = Graph.from_edges(spark.createDataFrame(rows, "src bigint, dst bigint, weight bigint, eid bigint"), eid="eid", directed=False)
    want = {r.eid for r in iterative.spanning_forest(g).collect()}
    assert {r.eid for r in iterative.merged_local_forests(g, parts=7).collect()} == want
    assert {r.eid for r in iterative.boruvka_then_merge(g).collect()} == want == {r.eid for r in iterative.boruvka_mixed_merge(g).collect()}


def test_edge_ids_are_the_same_on_every_run(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (None, 1)], "src bigint, dst bigint")
    a, b = ({r.eid for r in Graph.from_edges(e.repartition(n)).edges.collect()} for n in (1, 3))
    assert a == b and len(a) == 3
