"""Betweenness centrality, depth-first order and force-directed layout."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import cut

#: Arcs of a graph that may be copied to every task (32 MB).
MAX_COPIED_ARCS = 2_000_000


def betweenness(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """``id`` and ``centrality`` over unweighted shortest paths from ``sources`` (all vertices if none).

    Shortest paths of all sources grow level by level in one frame keyed by (source, vertex), path
    counts forward, dependencies backward.  Parallel edges multiply path counts; undirected sums are
    halved.
    """
    arcs = cut(g.arcs().filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")))
    start = (sources if sources is not None else g.vertices).select("id").distinct()
    front = cut(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("sigma")))
    levels = [front]
    seen = front.select("s", "v")
    while True:
        step = front.join(arcs, front.v == arcs.src).groupBy("s", "dst").agg(F.sum(F.col("sigma") * F.col("m")).alias("sigma"))
        nxt = step.withColumnRenamed("dst", "v").join(seen, ["s", "v"], "left_anti").select("s", "v", F.lit(len(levels)).alias("level"), "sigma")
        nxt = cut(nxt)
        if nxt.isEmpty():
            break
        levels.append(nxt)
        seen = cut(seen.unionByName(nxt.select("s", "v")))
        front = nxt
    total = None
    below = None
    for here in reversed(levels):
        if below is None:
            delta = here.withColumn("delta", F.lit(0.0))
        else:
            b = below.select("s", F.col("v").alias("dst"), F.col("sigma").alias("sw"), F.col("delta").alias("dw"))
            got = here.join(arcs, here.v == arcs.src).join(b, ["s", "dst"]).groupBy("s", "v").agg(F.sum(F.col("sigma") * F.col("m") / F.col("sw") * (1 + F.col("dw"))).alias("delta"))
            delta = here.join(got, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))
        below = cut(delta)
        part = below.filter("s <> v").select("v", "delta")
        total = part if total is None else total.unionByName(part)
    half = 1.0 if g.directed else 0.5
    sums = total.groupBy("v").agg(F.sum("delta").alias("c"))
    return g.vertices.join(sums, F.col("id") == F.col("v"), "left").select("id", (F.coalesce("c", F.lit(0.0)) * half).alias("centrality"))


def betweenness_copied(g: Graph, sources: DataFrame | None = None, weight: str | None = None, by_edge: bool = False) -> DataFrame:
    """The same with the graph copied to the tasks and the sources shared out; also for positive weights.

    ``by_edge`` gives ``src``, ``dst``, ``centrality`` of edges.  Only for graphs within
    ``MAX_COPIED_ARCS``; a larger one raises and is served by ``betweenness``.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    table = g.arcs().filter("src <> dst").select("src", "dst", w.alias("w")).limit(MAX_COPIED_ARCS + 1).toPandas()
    if len(table) > MAX_COPIED_ARCS:
        raise ValueError("the graph is too large to be copied to the tasks")
    if len(table) and table.w.min() <= 0:
        raise ValueError("weights must be positive")
    ids = np.unique(np.concatenate([table.src.to_numpy(), table.dst.to_numpy()])) if len(table) else np.zeros(0, np.int64)
    src, dst = np.searchsorted(ids, table.src), np.searchsorted(ids, table.dst)
    order = np.lexsort((dst, src))
    sent = g.vertices.sparkSession.sparkContext.broadcast((ids, src[order], dst[order], table.w.to_numpy()[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        ids, src, dst, w = sent.value
        first = np.searchsorted(src, np.arange(len(ids) + 1))
        node, edge = np.zeros(len(ids)), np.zeros(len(src))
        for b in batches:
            for s in b.column(0).to_pylist():
                at = int(np.searchsorted(ids, s))
                if at >= len(ids) or ids[at] != s:
                    continue
                dist, sigma = {at: 0.0}, {at: 1.0}
                into: dict[int, list[int]] = {}
                heap, done, seen = [(0.0, at)], [], set()
                while heap:
                    d, u = heapq.heappop(heap)
                    if u in seen:
                        continue
                    seen.add(u)
                    done.append(u)
                    for e in range(first[u], first[u + 1]):
                        v, nd = int(dst[e]), d + w[e]
                        old = dist.get(v)
                        if old is None or nd < old - 1e-12:
                            dist[v], sigma[v], into[v] = nd, sigma[u], [e]
                            heapq.heappush(heap, (nd, v))
                        elif abs(nd - old) <= 1e-12 and v not in seen:
                            sigma[v] += sigma[u]
                            into[v].append(e)
                delta = dict.fromkeys(done, 0.0)
                for v in reversed(done):
                    for e in into.get(v, ()):
                        u = int(src[e])
                        c = sigma[u] / sigma[v] * (1 + delta[v])
                        edge[e] += c
                        delta[u] += c
                    if v != at:
                        node[v] += delta[v]
        if by_edge:
            yield pa.RecordBatch.from_arrays([pa.array(ids[src]), pa.array(ids[dst]), pa.array(edge)], ["src", "dst", "c"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(node)], ["id", "c"])

    start = (sources if sources is not None else g.vertices).select(F.col("id").cast("bigint")).distinct()
    half = 1.0 if g.directed else 0.5
    if by_edge:
        got = start.mapInArrow(run, "src bigint, dst bigint, c double")
        ends = [F.col("src"), F.col("dst")] if g.directed else [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
        return got.select(*ends, "c").groupBy("src", "dst").agg((F.sum("c") * half).alias("centrality"))
    got = start.mapInArrow(run, "id bigint, c double").groupBy("id").agg(F.sum("c").alias("c"))
    return g.vertices.join(got, "id", "left").select("id", (F.coalesce("c", F.lit(0.0)) * half).alias("centrality"))


def central_point_dominance(centrality: DataFrame) -> DataFrame:
    """One row: the mean distance of the vertices' relative centrality from the largest one."""
    n, top, total = F.count(F.lit(1)), F.max("centrality"), F.sum("centrality")
    scale = (n - 1) * (n - 2) / 2
    return centrality.agg(F.when(n > 2, (n * top - total) / scale / (n - 1)).alias("dominance"))


def depth_first(g: Graph, components: DataFrame) -> DataFrame:
    """``id``, ``parent`` and ``visit`` number of a depth-first walk of each component from its smallest
    id, neighbours in ascending order.

    The walk is sequential by nature: components are shared out, each is walked in one task.
    """
    arcs = Graph(g.vertices, g.edges, False).arcs().filter("src <> dst").select("src", "dst").distinct()
    rows = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst")).unionByName(arcs).join(components.select(F.col("id").alias("src"), "component"), "src")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {k: sorted(set(v) - {k}) for k, v in pdf.groupby("src")["dst"]}
        root = min(near)
        parent, order, stack = {root: None}, [root], [(root, iter(near[root]))]
        while stack:
            u, it = stack[-1]
            for v in it:
                if v not in parent:
                    parent[v] = u
                    order.append(v)
                    stack.append((v, iter(near[v])))
                    break
            else:
                stack.pop()
        return pd.DataFrame({"id": order, "parent": pd.array([parent[v] for v in order], "Int64"), "visit": range(len(order))})

    return rows.groupBy("component").applyInPandas(walk, "id bigint, parent bigint, visit bigint")


def layout(g: Graph, width: float = 100.0, height: float = 100.0, rounds: int = 30) -> DataFrame:
    """``id``, ``x``, ``y`` after cooling rounds of attraction along edges and repulsion between vertices
    of the same or neighbouring cells of a grid of side 2k."""
    n = max(g.vertices.count(), 1)
    k = (width * height / n) ** 0.5
    unit = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0)
    pos = cut(g.vertices.select("id", (unit(1) * width).alias("x"), (unit(2) * height).alias("y")))
    pull_edges = cut(Graph(g.vertices, g.edges, False).arcs().filter("src <> dst").select("src", "dst"))
    cell = 2 * k
    for r in range(rounds):
        heat = width / 10 * (1 - r / rounds)
        near = pos.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
        around = near.withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])))
        around = around.select(F.col("id").alias("i2"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"))
        dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
        d = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(0.01))
        push = near.join(around, ["cx", "cy"]).filter("id <> i2").filter(d <= cell).select("id", (dx / d * k * k / d).alias("fx"), (dy / d * k * k / d).alias("fy"))
        e = pull_edges.join(pos.withColumnsRenamed({"id": "src", "x": "x", "y": "y"}), "src").join(pos.withColumnsRenamed({"id": "dst", "x": "x2", "y": "y2"}), "dst")
        pull = e.select(F.col("src").alias("id"), (-dx / d * d * d / k).alias("fx"), (-dy / d * d * d / k).alias("fy"))
        force = push.unionByName(pull).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        size = F.greatest(F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2), F.lit(1e-9))
        move = F.least(size, F.lit(heat)) / size
        bound = lambda c, f, most: F.least(F.lit(most), F.greatest(F.lit(0.0), F.col(c) + F.coalesce(F.col(f) * move, F.lit(0.0))))
        pos = cut(pos.join(force, "id", "left").select("id", bound("x", "fx", width).alias("x"), bound("y", "fy", height).alias("y")))
    return pos
