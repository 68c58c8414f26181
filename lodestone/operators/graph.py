"""Closure, cycles and layers of a caller's edge table, as joins of what a round has found with what is known.

Rounds double the length of the paths they know, so a chain of n edges takes log2(n) of them; there is no limit on
depth. Every round is written to the shared folder, which cuts the plan and survives lost executors.

Defined results: rows with a null end are left out; repeated edges count once; an edge from a node to itself is a cycle
of that node; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, staged
from . import pairing


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    made = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return staged(made.where("src is not null and dst is not null").distinct(), "edges")


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """src, dst, depth: all that each node reaches, with the fewest edges on the way. Cycles end where nothing new is met.

    Where most edges are the only one out of their source and the only one into their end, the runs of such edges are one node
    each while paths double, and the pairs within and between runs are written out from blocks of their nodes as they are read.
    """
    flat = _edges(edges, src, dst)
    alone = lambda end: flat.groupBy(end).agg(F.count("*").alias("_n")).where("_n = 1").select(end)
    links = staged(flat.where("src <> dst").join(alone("src"), "src", "left_semi").join(alone("dst"), "dst", "left_semi"), "links")
    if 2 * links.count() <= flat.count():
        discard(links)
        one = F.lit(1).cast("long")
        return _reached(flat.withColumns({"depth": one, "hops": one}), False).drop("hops")
    # a run is named by its last node; rings have none and stay as they are
    inner = staged(subsumed(links).where("root is not null").select("node", F.col("root").alias("run"), F.col("depth").alias("after")), "runs")
    nodes = flat.select(F.col("src").alias("node")).union(flat.select("dst")).distinct()
    ends = nodes.join(inner, "node", "left_anti").select("node", F.col("node").alias("run"), F.lit(0).cast("long").alias("after"))
    runs = staged(inner.union(ends), "runs")
    # only ends have other edges, and these lead to the first node of a run; a path is as long as from end to end
    between = flat.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(runs.withColumnRenamed("node", "dst"), "dst")
    between = staged(between.select("src", F.col("run").alias("dst"), (F.col("after") + 1).alias("depth"), F.lit(1).cast("long").alias("hops")), "paths")
    ways = _reached(between, True).select("src", "dst", "depth", F.lit(False).alias("own"))
    ways = ways.union(inner.select("run", "run", F.lit(0).cast("long"), F.lit(True)).distinct())
    place = F.floor(F.col("after") / pairing.BLOCK)
    block = runs.groupBy("run", place.alias("k")).agg(F.sort_array(F.collect_list(F.struct("after", "node"))).alias("ns")).select("run", "k", F.transform("ns", lambda x: x["node"]).alias("ns"))
    met = ways.join(block.toDF("src", "_k", "a"), "src").join(block.toDF("dst", "_l", "b"), "dst").where("not own or _k >= _l")
    each = pairing.spread(met, "a", "b", ["src", "dst", "own", "_k", "_l"])
    left, right = F.col("_k") * pairing.BLOCK + F.col("_i"), F.col("_l") * pairing.BLOCK + F.col("_j")
    # within a run the way along it is the shortest one; a way round is for what lies before
    each = each.where(F.when(F.col("own"), left > right).otherwise((F.col("src") != F.col("dst")) | (left <= right)))
    return each.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("depth") + left - right).cast("long").alias("depth"))


def _reached(known: DataFrame, weighted: bool) -> DataFrame:
    """src, dst, depth, hops: the least depth of a path, and the fewest edges of such a path. Edges have a depth, 1 if not weighted."""
    length = 1
    while True:
        # of a best path of more than `length` edges, the first `length` end where a best path of that length does
        last = known.where(F.col("hops") == length).select("src", F.col("dst").alias("_mid"), "depth", "hops")
        on = known.select(F.col("src").alias("_mid"), "dst", F.col("depth").alias("_more"), F.col("hops").alias("_on"))
        best = F.min(F.struct((F.col("depth") + F.col("_more")).alias("depth"), (F.col("hops") + F.col("_on")).alias("hops")))
        met = last.join(on, "_mid").groupBy("src", "dst").agg(best.alias("_new"))
        old = known.select("src", "dst", F.struct("depth", "hops").alias("_old"))
        new = staged(met.join(old, ["src", "dst"], "left").where("_old is null or _new < _old").select("src", "dst", "_new.depth", "_new.hops"), "paths")
        if new.isEmpty():
            discard(new)
            return known
        rest = known.join(new.select("src", "dst"), ["src", "dst"], "left_anti") if weighted else known
        before, known, length = known, staged(rest.unionByName(new), "closure"), 2 * length
        discard(new)
        if length > 2:
            discard(before)


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, cycle, length: the nodes on cycles, the smallest node of the group that reach each other, and the shortest way round."""
    return _cycles(closure(edges, src, dst))


def _cycles(reach: DataFrame) -> DataFrame:
    there, back = reach.select("src", "dst"), reach.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    group = there.join(back, ["src", "dst"]).groupBy("src").agg(F.min("dst").alias("cycle"))
    loops = reach.where("src = dst").select("src", F.col("depth").alias("length"))
    return group.join(loops, "src").select(F.col("src").alias("node"), "cycle", "length")


def layers(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, depth: the most edges from a node down to one without prerequisites (src needs dst). By depth it is a topological order.

    Edges inside a cycle are left out first, so every node has a depth.
    """
    reach = closure(edges, src, dst)
    group = _cycles(reach).select("node", "cycle")
    flat = _edges(edges, src, dst)
    same = flat.join(group.select(F.col("node").alias("src"), F.col("cycle").alias("_a")), "src", "left").join(group.select(F.col("node").alias("dst"), F.col("cycle").alias("_b")), "dst", "left")
    flat = staged(same.where("_a is null or _b is null or _a <> _b").select("src", "dst"), "acyclic")
    nodes = reach.select(F.col("src").alias("node")).union(reach.select("dst")).distinct()
    # the longest way: a path's first part is a longest one too, as there are no cycles
    known, length = flat.withColumn("depth", F.lit(1).cast("long")), 1
    while True:
        last = known.where(F.col("depth") == length).select("src", F.col("dst").alias("_mid"), "depth")
        if last.isEmpty():
            break
        on = known.select(F.col("src").alias("_mid"), "dst", F.col("depth").alias("_more"))
        met = last.join(on, "_mid").select("src", "dst", (F.col("depth") + F.col("_more")).alias("depth"))
        known, length = staged(known.unionByName(met).groupBy("src", "dst").agg(F.max("depth").alias("depth")), "longest"), 2 * length
    deepest = known.groupBy(F.col("src").alias("node")).agg(F.max("depth").alias("depth"))
    return nodes.join(deepest, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"))


def subsumed(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, root, depth: the furthest parent of each node in a table of one parent a node (of several, the smallest counts).

    Pointers double: each round every node looks where the node it points to points, so n nodes take log2(n) rounds over n rows.
    A node that leads into a cycle has no root: root and depth are null.
    """
    one = edges.select(F.col(src).alias("node"), F.col(dst).alias("up")).where("node is not null and up is not null").groupBy("node").agg(F.min("up").alias("up"))
    now = staged(one.withColumn("depth", F.lit(1).cast("long")), "parents")
    n, length = now.count(), 1
    while length <= n:
        on = now.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_more"))
        joined = now.join(on, "up", "left").select("node", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("_went"))
        before, now, length = now, staged(joined, "parents"), 2 * length
        discard(before)
        if now.where("_went").isEmpty():
            break
    ends = now.join(now.select(F.col("node").alias("up"), F.lit(True).alias("_on")), "up", "left")
    return ends.select("node", F.when(F.col("_on").isNull(), F.col("up")).alias("root"), F.when(F.col("_on").isNull(), F.col("depth")).alias("depth"))
