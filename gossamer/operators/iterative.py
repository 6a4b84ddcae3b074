"""Graph algorithms as rounds of DataFrame plans.

Each round is one or two joins with partial aggregation; the state is cut with a reliable checkpoint
every few rounds (``session.cut``), and one small action a round decides whether to go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..session import cut

#: Rounds between two checkpoints of a fixed-round loop.
CUT_EVERY = 5


def _kept(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def page_rank(g: Graph, rounds: int = 20, damping: float = 0.85, tol: float | None = None, normalize: bool = False) -> DataFrame:
    """``id`` and ``rank`` after synchronous rounds from 1/n: r'(v) = (1 - d) + d * sum r(u) / outdegree(u).

    Ranks aren't normalised and the mass of vertices without out-edges is lost; ``normalize`` divides by
    the sum.  Parallel edges count each.  ``tol`` stops once no rank moves further than it.
    """
    n = g.vertices.count()
    out = g.arcs().groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    # parallel edges become one weighted row: fewer rows to move each round
    share = _kept(g.arcs().groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share")))
    nodes = _kept(g.vertices.select("id"))
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(rounds):
        moved = share.join(rank, share.src == rank.id).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = nodes.join(moved, nodes.id == moved.dst, "left").select("id", (F.lit(1 - damping) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if tol is not None:
            new = cut(new)
            far = new.join(rank.withColumnRenamed("rank", "old"), "id").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            rank = new
            if (far or 0) <= tol:
                break
        else:
            rank = cut(new) if (k + 1) % CUT_EVERY == 0 and k + 1 < rounds else new
    if normalize:
        total = rank.agg(F.sum("rank").alias("total"))
        rank = rank.crossJoin(F.broadcast(total)).select("id", (F.col("rank") / F.col("total")).alias("rank"))
    return rank


def remove_dangling(g: Graph) -> Graph:
    """Without vertices lacking out-edges, repeated until all have one."""
    edges = _kept(g.arcs())
    while True:
        live = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)
        live = cut(live)
        if live.count() == edges.count():
            break
        edges = live
    return Graph(edges.select(F.col("src").alias("id")).distinct(), edges, g.directed)


def bfs(g: Graph, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """``id``, ``level`` and ``parent`` (smallest id one level up, null for a source) of what is reached.

    ``sources`` has a column ``id``; ``depth`` bounds the levels.  One round a level: the frontier meets
    the edges, vertices already seen are taken out.
    """
    arcs = _kept(g.arcs().filter("src <> dst").select("src", "dst").distinct())
    frontier = cut(sources.select("id").distinct().join(g.vertices.select("id"), "id", "left_semi").select("id", F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("parent")))
    seen, level = frontier, 0
    while depth is None or level < depth:
        level += 1
        step = arcs.join(frontier.select(F.col("id").alias("src")), "src").groupBy("dst").agg(F.min("src").alias("parent"))
        frontier = cut(step.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("id"), F.lit(level).alias("level"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if level % CUT_EVERY == 0:
            seen = cut(seen)
    return seen


def bfs_events(g: Graph, sources: DataFrame, depth: int | None = None) -> DataFrame:
    """What a breadth-first search meets: ``event``, ``id`` (of a vertex) or ``eid``, ``src``, ``dst`` (of an
    edge), and ``level``.

    Vertices: initialize (all), discover, examine and finish (those reached; with ``depth`` the last level is
    discovered only).  Edges of examined vertices: examine, then tree (one for each vertex reached, from its
    parent) or non_tree, whose target is gray (of the same level or the next) or black (of one before).
    """
    seen = cut(bfs(g, sources, depth))
    nodes = g.vertices.select("id").distinct().join(seen, "id", "left")
    last = F.lit(True) if depth is None else F.col("level") < depth
    at = F.array_compact(F.array(F.lit("initialize_vertex"), *[F.when(F.col("level").isNotNull() & on, F.lit(e)) for e, on in (("discover_vertex", F.lit(True)), ("examine_vertex", last), ("finish_vertex", last))]))
    none = F.lit(None).cast("bigint")
    of_nodes = nodes.select(F.explode(at).alias("event"), "id", none.alias("eid"), none.alias("src"), none.alias("dst"), "level")
    from_ = seen.filter(last).select(F.col("id").alias("src"), F.col("level").alias("ls"))
    to = seen.select(F.col("id").alias("dst"), F.col("level").alias("ld"), "parent")
    arcs = g.arcs().select("eid", "src", "dst").join(from_, "src").join(to, "dst")
    # of parallel edges from the parent one is the tree's
    arcs = arcs.withColumn("copy", F.row_number().over(Window.partitionBy("src", "dst").orderBy("eid")))
    tree = (F.col("src") == F.col("parent")) & (F.col("copy") == 1)
    kinds = F.when(F.coalesce(tree, F.lit(False)), F.array(F.lit("examine_edge"), F.lit("tree_edge"))).otherwise(F.array(F.lit("examine_edge"), F.lit("non_tree_edge"), F.when(F.col("ld") >= F.col("ls"), "gray_target").otherwise("black_target")))
    return of_nodes.unionByName(arcs.select(F.explode(kinds).alias("event"), none.alias("id"), "eid", "src", "dst", F.col("ls").alias("level")))


def st_connected(g: Graph, s: int, t: int) -> bool:
    """Whether an undirected path joins ``s`` and ``t`` (a vertex is joined with itself); bidirectional."""
    if s == t:
        return not g.vertices.filter(F.col("id") == s).isEmpty()
    both = _kept(Graph(g.vertices, g.edges, False).arcs().select("src", "dst").distinct())
    spark = g.vertices.sparkSession
    sides = cut(spark.createDataFrame([(s, 0), (t, 1)], "id bigint, side int").join(g.vertices.select("id"), "id", "left_semi"))
    fresh = sides
    while True:
        if not sides.groupBy("id").agg(F.count_distinct("side").alias("k")).filter("k > 1").isEmpty():
            return True
        step = both.join(fresh.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.col("side")).distinct()
        fresh = cut(step.join(sides, ["id", "side"], "left_anti"))
        if fresh.isEmpty():
            return False
        sides = cut(sides.unionByName(fresh))


def shortest_paths(g: Graph, source: int, weight: str = "weight", delta: float | None = None) -> DataFrame:
    """``id``, ``dist`` and ``pred`` (smallest predecessor on a shortest path) from ``source``.

    Delta-stepping: the frontier is the bucket of the smallest tentative distances; light edges are
    relaxed until it is settled, heavy ones once.  The default ``delta`` is the largest weight by the
    largest degree, at least the mean weight, which keeps rounds few.  A negative weight raises.  The
    eager and the criteria-driven variants return the same distances and are served by this engine.
    """
    arcs = _kept(g.arcs().filter("src <> dst").groupBy("src", "dst").agg(F.min(weight).alias("w")))
    stats = arcs.agg(F.min("w"), F.max("w"), F.avg("w")).first()
    if stats[0] is None:
        return g.vertices.filter(F.col("id") == source).select("id", F.lit(0.0).alias("dist"), F.lit(None).cast("bigint").alias("pred"))
    if stats[0] < 0:
        raise ValueError("negative edge weight")
    top = arcs.groupBy("src").count().agg(F.max("count")).first()[0]
    delta = delta or max(stats[1] / max(top, 1), stats[2], 1e-12)
    dist = cut(g.vertices.filter(F.col("id") == source).select("id", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")))
    rounds = 0
    while True:
        low = dist.filter("fresh").agg(F.min("dist")).first()[0]
        if low is None:
            break
        limit = (int(low / delta) + 1) * delta
        front = dist.filter(F.col("fresh") & (F.col("dist") < limit))
        relaxed = arcs.join(front.select(F.col("id").alias("src"), F.col("dist").alias("d")), "src").groupBy("dst").agg(F.min(F.col("d") + F.col("w")).alias("new"))
        merged = dist.join(relaxed, dist.id == relaxed.dst, "full_outer")
        better = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        dist = cut(
            merged.select(
                F.coalesce("id", "dst").alias("id"),
                F.when(better, F.col("new")).otherwise(F.col("dist")).alias("dist"),
                (better | (F.coalesce("fresh", F.lit(False)) & (F.col("dist") >= limit))).alias("fresh"),
            )
        )
        rounds += 1
    final = dist.select("id", "dist")
    tight = arcs.join(final.withColumnsRenamed({"id": "src", "dist": "ds"}), "src").join(final.withColumnsRenamed({"id": "dst", "dist": "dt"}), "dst").filter(F.abs(F.col("ds") + F.col("w") - F.col("dt")) <= 1e-9 * (1 + F.abs(F.col("dt"))))
    pred = tight.filter(F.col("dst") != source).groupBy("dst").agg(F.min("src").alias("pred"))
    return final.join(pred, final.id == pred.dst, "left").select("id", "dist", "pred")


def connected_components(g: Graph) -> DataFrame:
    """``id`` and ``component`` (its smallest id), edges taken undirected.

    Alternating large-star and small-star rounds: logarithmically many, each one grouping.  Hot vertices
    shrink by partial minima before the shuffle.
    """
    nodes = g.vertices.select("id").distinct()
    pairs = g.edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = cut(pairs)
    known = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        pairs = cut(small)
        mark = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if known is not None and tuple(mark) == known:
            break
        known = tuple(mark)
    return nodes.join(pairs, nodes.id == pairs.u, "left").select("id", F.coalesce("v", "id").alias("component"))


def strong_components(g: Graph) -> DataFrame:
    """``id`` and ``component`` (its smallest id) of the strongly connected components.

    Trim vertices without in- or out-edges, then colour: the smallest id that reaches a vertex becomes
    its colour, and what reaches the colour's own vertex inside the colour is its component; repeat.
    """
    spark = g.vertices.sparkSession
    edges = cut(g.edges.filter("src <> dst").select("src", "dst").distinct())
    left = cut(g.vertices.select("id").distinct())
    done = spark.createDataFrame([], "id bigint, component bigint")
    while not left.isEmpty():
        while True:  # trim
            live = left.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            live = cut(live)
            gone = left.join(live, "id", "left_anti").select("id", F.col("id").alias("component"))
            if live.count() == left.count():
                break
            done = cut(done.unionByName(gone))
            left = live
            edges = cut(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
        if left.isEmpty():
            break
        colour = left.select("id", F.col("id").alias("c"))
        while True:  # smallest id that reaches each vertex
            new = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.min("c").alias("m"))
            nxt = cut(colour.join(new, colour.id == new.dst, "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("moved")))
            go = not nxt.filter("moved").isEmpty()
            colour = nxt.select("id", "c")
            if not go:
                break
        inside = edges.join(colour.withColumnsRenamed({"id": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"id": "dst", "c": "cd"}), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        inside = cut(inside)
        reach = colour.filter("id = c")
        front = reach
        while True:  # backwards inside the colour
            back = inside.join(front.select(F.col("id").alias("dst"), F.col("c").alias("fc")), "dst").filter("c = fc").select(F.col("src").alias("id"), "c").distinct()
            front = cut(back.join(reach, ["id", "c"], "left_anti"))
            if front.isEmpty():
                break
            reach = cut(reach.unionByName(front))
        done = cut(done.unionByName(reach.select("id", F.col("c").alias("component"))))
        left = cut(left.join(reach, "id", "left_anti"))
        edges = cut(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    return done


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition that its own minimum spanning forest keeps."""
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    a, b, w, e = (t.column(c).to_numpy() for c in ("a", "b", "w", "eid"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = list(range(len(ids)))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    keep = []
    for k in np.lexsort((e, w)).tolist():
        x, y = root(int(at[k])), root(int(at[len(a) + k]))
        if x != y:
            top[x] = y
            keep.append(k)
    yield from t.take(pa.array(keep, pa.int64())).to_batches()


def spanning_forest(g: Graph, weight: str = "weight", local: bool = False) -> DataFrame:
    """The edges of the minimum spanning forest by (weight, eid), which makes it unique.

    Boruvka rounds: the smallest edge of each component is taken, components merge, inner and dearer
    parallel edges are dropped, until no edge is left.  ``local`` lets each partition first drop the
    edges that close a cycle of its own cheaper ones, which pays on dense graphs; the forest is the same.
    """
    chosen, _ = _boruvka(g, weight, local)
    return _edges_of(g, chosen)


def _edges_of(g: Graph, chosen: DataFrame) -> DataFrame:
    """The chosen edges; rows with one ``eid`` are one edge delivered again."""
    return g.edges.join(chosen, "eid", "left_semi").dropDuplicates(["eid"])


def _boruvka(g: Graph, weight: str, local: bool, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The ids of the edges chosen by so many rounds, and the edges left between components."""
    order = F.struct(F.col("w"), F.col("eid"))
    now = cut(g.edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col(weight).alias("w"), "eid"))
    picked: list[DataFrame] = []
    while not now.isEmpty() and (rounds is None or len(picked) < rounds):
        if local:
            now = cut(now.mapInArrow(_local_forest, now.schema))
        ends = now.select(F.inline(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o"), "w", "eid"), F.struct(F.col("b").alias("c"), F.col("a").alias("o"), "w", "eid"))))
        best = cut(ends.groupBy("c").agg(F.min_by(F.struct("o", "eid"), order).alias("e")).select("c", F.col("e.o").alias("up"), F.col("e.eid").alias("eid")))
        picked.append(best.select("eid"))
        merged = _roots(best)
        a = merged.select(F.col("c").alias("a"), F.col("up").alias("ca"))
        b = merged.select(F.col("c").alias("b"), F.col("up").alias("cb"))
        nxt = now.join(a, "a").join(b, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "w", "eid")
        now = cut(nxt.groupBy("a", "b").agg(F.min(order).alias("m")).select("a", "b", "m.w", "m.eid"))
    none = g.vertices.sparkSession.createDataFrame([], "eid bigint")
    return reduce(DataFrame.unionByName, picked, none).distinct(), now


def _roots(best: DataFrame) -> DataFrame:
    """``c`` and ``up``, the vertex that stands for its tree, by pointer jumping along the chosen edges.

    In each tree just one edge is chosen by both its ends (the smallest); the smaller end is the root.
    """
    back = best.select(F.col("c").alias("up"), F.col("up").alias("there"))
    now = cut(best.join(back, "up").select("c", F.when((F.col("there") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up")))
    while True:
        over = now.select(F.col("c").alias("up"), F.col("up").alias("top"))
        new = cut(now.join(over, "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        now = new.select("c", "up")
        if new.filter("moved").isEmpty():
            return now


def merged_local_forests(g: Graph, weight: str = "weight", degree: int = 3, parts: int | None = None) -> DataFrame:
    """The minimum spanning forest by merging local forests along a tree of the given degree.

    Each partition keeps its own forest; then ``degree`` partitions at a time are put together, until one
    is left.  The last task holds at most a forest, an edge less than there are vertices: this pays on dense
    graphs and needs the vertices' number to fit a task; ``spanning_forest`` doesn't.
    """
    now = g.edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col(weight).alias("w"), "eid")
    n = parts or now.rdd.getNumPartitions()
    now = now.repartition(n, "eid").mapInArrow(_local_forest, now.schema)
    while n > 1:
        n = -(-n // degree)
        now = cut(now).repartition(n, "eid").mapInArrow(_local_forest, now.schema)
    return _edges_of(g, cut(now).select("eid"))


def boruvka_then_merge(g: Graph, weight: str = "weight", rounds: int = 1, degree: int = 3) -> DataFrame:
    """The forest by some Boruvka rounds, which shrink the vertices, and merging of local forests behind them."""
    chosen, left = _boruvka(g, weight, False, rounds)
    rest = Graph.from_edges(left.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w", "eid"), eid="eid", directed=False)
    last = merged_local_forests(rest, "w", degree)
    return _edges_of(g, cut(chosen.unionByName(last.select("eid"))))


def boruvka_mixed_merge(g: Graph, weight: str = "weight") -> DataFrame:
    """The forest by Boruvka rounds, each behind a round of local forests."""
    return spanning_forest(g, weight, local=True)


def colouring(g: Graph) -> DataFrame:
    """``id`` and ``colour`` of a proper vertex colouring (self loops aside).

    Rounds by priority, the vertices of most neighbours first, ties by hash.  A vertex with k uncoloured
    neighbours ahead of it picks the k-th colour its neighbours lack, so that a clique is coloured in
    one round; of neighbours with the same pick the first keeps it.
    """
    both = cut(Graph(g.vertices, g.edges, False).arcs().filter("src <> dst").select("src", "dst").distinct())
    near = both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    first = F.struct(F.coalesce("deg", F.lit(0)).alias("deg"), F.xxhash64("id").alias("h"))
    nodes = g.vertices.select("id").distinct()
    state = cut(nodes.join(near, nodes.id == near.src, "left").select("id", first.alias("p"), F.lit(None).cast("int").alias("colour")))
    while not state.filter("colour IS NULL").isEmpty():
        other = state.select(F.col("id").alias("dst"), F.col("p").alias("q"), F.col("colour").alias("qc"))
        mine = state.filter("colour IS NULL").select(F.col("id").alias("src"), "p")
        ahead = F.col("qc").isNull() & (F.struct("q", "dst") > F.struct("p", "src"))
        around = both.join(mine, "src").join(other, "dst").groupBy("src").agg(F.collect_set("qc").alias("taken"), F.count_if(ahead).cast("int").alias("rank"))
        free = F.element_at(F.array_except(F.sequence(F.lit(0), F.size("taken") + F.col("rank")), F.col("taken")), F.col("rank") + 1)
        picked = mine.join(around, "src", "left").select("src", "p", F.coalesce(free, F.lit(0)).alias("pick"))
        picked = cut(picked)
        rival = picked.select(F.col("src").alias("dst"), F.col("p").alias("q"), F.col("pick").alias("qp"))
        lost = both.join(picked, "src").join(rival, "dst").filter((F.col("qp") == F.col("pick")) & (F.struct("q", "dst") > F.struct("p", "src"))).select("src").distinct()
        won = picked.join(lost, "src", "left_anti").select(F.col("src").alias("id"), F.col("pick").alias("new"))
        state = cut(state.join(won, "id", "left").select("id", "p", F.coalesce("colour", "new").alias("colour")))
    return state.select("id", "colour")


def biconnected_components(g: Graph) -> DataFrame:
    """``eid`` and ``component`` (smallest eid of the class) of every edge but self loops, undirected.

    Over a breadth-first forest, a further edge joins all forest edges on the cycle it closes: its two
    ends climb to their meeting point together, and the climbed edges fall into one class by connected
    components.  Rounds are bounded by the forest's depth.
    """
    edges = cut(g.edges.filter("src <> dst").select("eid", "src", "dst"))
    roots = cut(connected_components(Graph(g.vertices, edges, False)))
    tree = bfs(Graph(g.vertices, edges, False), roots.select(F.col("component").alias("id")).distinct())
    tree = cut(tree)
    deep = tree.filter("parent IS NOT NULL").select(F.col("id").alias("child"), "parent")
    used = edges.select("eid", F.explode(F.array(F.struct(F.col("src").alias("child"), F.col("dst").alias("parent")), F.struct(F.col("dst").alias("child"), F.col("src").alias("parent")))).alias("x")).select("eid", "x.*")
    used = cut(used.join(deep, ["child", "parent"]).groupBy("child").agg(F.min("eid").alias("eid")))
    lev = tree.select("id", "level", "parent")
    walk = edges.join(used.select("eid"), "eid", "left_anti").select("eid", F.col("src").alias("u"), F.col("dst").alias("v"))
    walk = cut(walk)
    met = g.vertices.sparkSession.createDataFrame([], "eid bigint, child bigint")
    while not walk.isEmpty():
        up = walk.join(lev.select(F.col("id").alias("u"), F.col("level").alias("lu"), F.col("parent").alias("pu")), "u").join(lev.select(F.col("id").alias("v"), F.col("level").alias("lv"), F.col("parent").alias("pv")), "v")
        up = cut(up)
        met = cut(met.unionByName(up.filter("lu >= lv").select("eid", F.col("u").alias("child"))).unionByName(up.filter("lv >= lu").select("eid", F.col("v").alias("child"))))
        walk = cut(up.select("eid", F.when(F.col("lu") >= F.col("lv"), F.col("pu")).otherwise(F.col("u")).alias("u"), F.when(F.col("lv") >= F.col("lu"), F.col("pv")).otherwise(F.col("v")).alias("v")).filter("u <> v"))
    links = met.join(used.withColumnRenamed("eid", "tree_eid"), "child").select(F.col("eid").alias("src"), F.col("tree_eid").alias("dst"))
    classes = connected_components(Graph.from_edges(links))
    return edges.select("eid").join(classes, edges.eid == classes.id, "left").select("eid", F.coalesce("component", "eid").alias("component"))


def articulation_points(g: Graph, bicomponents: DataFrame) -> DataFrame:
    """Vertices whose edges belong to more than one biconnected component."""
    ends = g.edges.filter("src <> dst").select("eid", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(bicomponents, "eid").groupBy("id").agg(F.count_distinct("component").alias("n")).filter("n > 1").select("id")
