"""Communities of a weighted graph by local moves on DataFrames, and what they are worth.

A sweep joins edges with the labels of their ends, adds up each node's weight to every community
around it, and moves nodes to where they gain most. Neighbours whose moves would undo each other, as
one goes to the community that the other leaves, never move together: the one whose turn, a hash,
comes first goes. When no move pays any more, communities become the nodes of the next, smaller graph.
Nothing but a few sums reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.plans.order import ranked


def _both_ways(edges: DataFrame) -> DataFrame:
    """(v, u, w) in both directions, without loops."""
    one = edges.where("a <> b").groupBy(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).agg(F.sum("w").alias("w"))
    return one.union(one.select(F.col("u").alias("v"), F.col("v").alias("u"), "w"))


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def quality(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity, codelength, clusters) of (cell, cluster) on an undirected (a, b, w).

    Codelength, in bits, is that of a random walk described by communities (the map equation): on an
    undirected graph a node is visited in proportion to its weight, and a community left in
    proportion to the weight of its outgoing edges. Loops count twice for their node.
    """
    of = lambda c: labels.select(F.col("cell").alias(c), F.col("cluster").alias(f"c_{c}"))
    e = edges.join(of("a"), "a").join(of("b"), "b")
    ends = e.select(F.col("a").alias("v"), F.col("c_a").alias("c"), "w", (F.col("c_a") == F.col("c_b")).alias("same"))
    ends = ends.union(e.select("b", "c_b", "w", F.col("c_a") == F.col("c_b")))
    total = ends.agg(F.sum("w").alias("m2"))
    node = ends.groupBy("v").agg(F.sum("w").alias("d")).crossJoin(F.broadcast(total)).agg(F.sum(_plogp(F.col("d") / F.col("m2"))).alias("node"))
    group = ends.groupBy("c").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("same"), F.col("w")).otherwise(0.0)).alias("inside")).crossJoin(F.broadcast(total))
    p, q = F.col("d") / F.col("m2"), (F.col("d") - F.col("inside")) / F.col("m2")
    sums = group.agg(F.sum(F.col("inside") / F.col("m2") - p * p).alias("modularity"), F.sum(q).alias("q"), F.sum(_plogp(q)).alias("ql"), F.sum(_plogp(p + q)).alias("pl"), F.count("*").alias("clusters"))
    return sums.crossJoin(node).select("modularity", (_plogp(F.col("q")) - 2 * F.col("ql") - F.col("node") + F.col("pl")).alias("codelength"), "clusters")


def _scored(near: DataFrame, state: DataFrame, groups: DataFrame, m2: float, left: float, method: str, resolution: float) -> DataFrame:
    """(v, own, to, gain): what each node would gain by each community around it.

    ``near``: (v, c, w), a node's weight to a community; ``state``: (v, c, d, out), its community, weight and
    weight to other nodes; ``groups``: (c, d, cut); ``left``: the sum of all cuts.
    """
    own = state.select("v", F.col("c").alias("own"), F.col("d").alias("dv"), F.col("out").alias("ov"))
    of = lambda c: groups.select(F.col("c").alias(c), F.col("d").alias(f"d_{c}"), F.col("cut").alias(f"cut_{c}"))
    rows = near.withColumnRenamed("c", "to").join(own, "v")
    home = F.coalesce(F.sum(F.when(F.col("to") == F.col("own"), F.col("w"))).over(W.partitionBy("v")), F.lit(0.0))
    rows = rows.withColumn("home", home).where("to <> own").join(of("own"), "own").join(of("to"), "to")
    if method == "modularity":
        gain = (F.col("w") - F.col("home") - resolution * F.col("dv") * (F.col("d_to") - F.col("d_own") + F.col("dv")) / m2) * 2 / m2
    else:
        # a community's cut grows by what the node has outside of it and shrinks by what it has within
        cut_a, cut_b = F.col("cut_own") - F.col("ov") + 2 * F.col("home"), F.col("cut_to") + F.col("ov") - 2 * F.col("w")
        term = lambda cut, d: -2 * _plogp(cut / m2) + _plogp((cut + d) / m2)
        before = _plogp(F.lit(left / m2)) + term(F.col("cut_own"), F.col("d_own")) + term(F.col("cut_to"), F.col("d_to"))
        now = (F.lit(left) - F.col("cut_own") - F.col("cut_to") + cut_a + cut_b) / m2
        after = _plogp(now) + term(cut_a, F.col("d_own") - F.col("dv")) + term(cut_b, F.col("d_to") + F.col("dv"))
        gain = before - after
    return rows.select("v", "own", "to", gain.alias("gain"))


def communities(edges: DataFrame, scratch, method: str = "modularity", resolution: float = 1.0, seed: int = 1, least_gain: float = 1e-3, max_sweeps: int = 40) -> DataFrame:
    """(cell, cluster) of an undirected (a, b, w), clusters numbered by falling size.

    ``method``: "modularity", or "codelength" for the map equation. A level ends when a sweep gains less than
    ``least_gain``, all levels when contraction changes nothing. Cells without an edge are absent. Equal
    input and seed give equal clusters.
    """
    graph = scratch.table(_both_ways(edges), "graph0")
    loops = scratch.table(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().join(edges.where("a = b").groupBy(F.col("a").alias("v")).agg((2 * F.sum("w")).alias("loop")), "v", "left").select("v", F.coalesce("loop", F.lit(0.0)).alias("loop")), "loops0")
    members = None
    m2 = float((graph.agg(F.sum("w")).first()[0] or 0.0) + (loops.agg(F.sum("loop")).first()[0] or 0.0))
    level = 0
    while m2:
        out = graph.groupBy("v").agg(F.sum("w").alias("out"))
        nodes = loops.join(out, "v", "left").select("v", (F.coalesce("out", F.lit(0.0)) + F.col("loop")).alias("d"), F.coalesce("out", F.lit(0.0)).alias("out"))
        state = scratch.table(nodes.select("v", F.col("v").alias("c"), "d", "out"), f"state{level}-0")
        moved_any = False
        for sweep in range(1, max_sweeps + 1):
            met = graph.join(state.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u")
            near = met.groupBy("v", F.col("cu").alias("c")).agg(F.sum("w").alias("w"))
            groups, left = state.groupBy("c").agg(F.sum("d").alias("d"), F.sum("out").alias("out")), 0.0
            if method == "modularity":
                groups = groups.select("c", "d", F.lit(0.0).alias("cut"))
            else:  # what a community's nodes have outside of them, less what they have among each other
                inner = near.join(state.select("v", "c"), ["v", "c"]).groupBy("c").agg(F.sum("w").alias("inner"))
                groups = scratch.table(groups.join(inner, "c", "left").select("c", "d", (F.col("out") - F.coalesce("inner", F.lit(0.0))).alias("cut")), f"groups{level}-{sweep}")
                left = float(groups.agg(F.sum("cut")).first()[0] or 0.0)
            scored = _scored(near, state, groups, m2, left, method, resolution).where("gain > 1e-12")
            wish = scored.groupBy("v").agg(F.max_by(F.struct("own", "to", "gain"), F.struct("gain", -F.xxhash64("to"))).alias("b")).select("v", "b.own", "b.to", "b.gain")
            wish = scratch.table(wish.withColumn("turn", F.xxhash64("v", F.lit(seed), F.lit(sweep))), f"wish{level}-{sweep}")
            if (wish.agg(F.sum("gain")).first()[0] or 0.0) < least_gain:
                break
            one, other = wish.select("v", "own", "to", "turn"), wish.select(F.col("v").alias("u"), F.col("own").alias("own_u"), F.col("to").alias("to_u"), F.col("turn").alias("turn_u"))
            clash = ((F.col("to") == F.col("own_u")) | (F.col("to_u") == F.col("own"))) & (F.col("turn_u") < F.col("turn"))
            waits = graph.join(one, "v").join(other, "u").where(clash).select("v").distinct()
            goes = wish.join(waits, "v", "left_anti").select("v", "to")
            after = scratch.table(state.join(goes, "v", "left").select("v", F.coalesce("to", "c").alias("c"), "d", "out"), f"state{level}-{sweep}")
            state, moved_any = after, True
            scratch.drop(f"state{level}-{sweep - 1}", f"groups{level}-{sweep}", f"wish{level}-{sweep}")
        step = state.select("v", "c")
        members = scratch.table(step if members is None else members.join(step.toDF("c", "next"), "c").select("v", F.col("next").alias("c")), f"members{level}")
        if not moved_any:
            break
        label = lambda k: state.select(F.col("v").alias(k), F.col("c").alias(f"c_{k}"))
        merged = graph.join(label("v"), "v").join(label("u"), "u").groupBy(F.col("c_v").alias("v"), F.col("c_u").alias("u")).agg(F.sum("w").alias("w"))
        merged = scratch.table(merged, f"merged{level}")
        inside = merged.where("v = u").select("v", F.col("w").alias("inner"))
        own = loops.join(label("v"), "v").groupBy(F.col("c_v").alias("v")).agg(F.sum("loop").alias("loop"))
        loops = scratch.table(own.join(inside, "v", "left").select("v", (F.col("loop") + F.coalesce("inner", F.lit(0.0))).alias("loop")), f"loops{level + 1}")
        graph = scratch.table(merged.where("v <> u"), f"graph{level + 1}")
        scratch.drop(f"graph{level}", f"loops{level}", f"merged{level}")
        level += 1
    if members is None:
        members = loops.select("v", F.col("v").alias("c"))
    return numbered(members, scratch)


def numbered(members: DataFrame, scratch) -> DataFrame:
    """(cell, cluster): communities of (v, c) by falling size, ties by their least member, from 1."""
    sizes = members.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("least"))
    number = ranked(sizes, [F.desc("n"), F.asc("least")], scratch, "sizes").select("c", F.col("rank").cast("int").alias("cluster"))
    return members.join(number, "c").select(F.col("v").alias("cell"), "cluster")
