"""Force-directed layout of cells by where walks visited them, and its graph.

The graph's stages are DataFrames throughout: profiles, neighbours, fences, distances in the tree,
peeling. The layout moves all cells at once; pulls are a join of edges and places, pushes come
from a grid of fixed size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators import field, tree
from trellis.plans.order import quantile


def visit_profiles(visits: DataFrame, pt: DataFrame, least: float = 1.0, unique: bool = True) -> DataFrame:
    """(cell, vec): visits from each tip and the pseudotime, as shares of their sum.

    ``visits``: (tip, cell, v). Cells without pseudotime are left out, and those whose sum is below
    ``least``; of cells with the same profile the first stays, if ``unique``. Tips are few.
    """
    tips = sorted(r["tip"] for r in visits.select("tip").distinct().collect())
    wide = visits.groupBy("cell").agg(*[F.coalesce(F.sum(F.when(F.col("tip") == t, F.col("v"))), F.lit(0)).cast("double").alias(f"t{i}") for i, t in enumerate(tips)])
    rows = pt.where("pseudotime is not null").select("cell", F.col("pseudotime").cast("double").alias("pseudotime")).join(wide, "cell", "left")
    parts = [F.coalesce(f"t{i}", F.lit(0.0)) for i in range(len(tips))] + [F.col("pseudotime")]
    total = sum(parts[1:], parts[0])
    out = rows.withColumn("_s", total).where((F.col("_s") >= least) & (F.col("_s") != 0)).select("cell", F.array(*[p / F.col("_s") for p in parts]).alias("vec"))
    return out.groupBy("vec").agg(F.min("cell").alias("cell")).select("cell", "vec") if unique else out


def fence(rows: DataFrame, value: str, factor: float, scratch) -> DataFrame:
    """Rows whose ``value`` is at most the upper quartile plus ``factor`` times its distance to the least."""
    upper, low = quantile(rows, value, 0.75, scratch), rows.agg(F.min(value)).first()[0]
    return rows if upper is None else rows.where(F.col(value) <= upper + factor * (upper - low))


def tree_distance(joins: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``tree_dist``, the number of joins between their segments; none where the tree lacks one.

    A segment's way to the root is an array as long as the tree is deep; two ways part where they
    have nothing more in common.
    """
    own = joins.select(F.col("child").alias("s")).union(joins.select("parent")).distinct()
    up = tree.ancestors(joins).groupBy("segment").agg(F.collect_set("ancestor").alias("up"))
    way = own.join(up, own["s"] == up["segment"], "left").select("s", F.array_append(F.coalesce("up", F.array().cast(up.schema["up"].dataType)), F.col("s")).alias("way"))
    met = pairs.join(way.toDF(a, "_wa"), a).join(way.toDF(b, "_wb"), b)
    return met.withColumn("tree_dist", F.size("_wa") + F.size("_wb") - 2 * F.size(F.array_intersect("_wa", "_wb"))).drop("_wa", "_wb")


def peel(edges: DataFrame, least: int, scratch) -> DataFrame:
    """(a, b, dist, ...) without the cells that have fewer than ``least`` edges of their own at a distance above
    zero, at either end, again and again until all cells with edges of their own have enough. A round
    is written before the next begins."""
    now, step = scratch.table(edges, "peel0"), 0
    while True:
        counted = scratch.table(now.groupBy("a").agg(F.count_if(F.col("dist") > 0).alias("k")), f"counts{step}")
        if counted.where(F.col("k") < least).isEmpty():
            return now
        enough = counted.where(F.col("k") >= least).select("a")
        after = now.join(enough, "a", "left_semi").join(enough.toDF("b"), "b", "left_semi").select(*edges.columns)
        now = scratch.table(after, f"peel{step + 1}")
        scratch.drop(f"peel{step}", f"counts{step}")
        step += 1


def neighbor_edges(knn: DataFrame, pt: DataFrame, scratch, cell_segment: DataFrame | None = None, joins: DataFrame | None = None, cut_cells: float | None = None, cut_edges: float | None = None, max_pt_diff: float | None = None, max_tree_dist: int = 2) -> DataFrame:
    """(a, b, dist, weight) of neighbours that are near in all ways asked for; weight is one over distance.

    ``cut_cells``: leaves out cells whose second neighbour is beyond a fence, as starts of edges;
    ``cut_edges``: edges beyond a fence; ``max_pt_diff``: too far in pseudotime; with ``joins`` and
    ``cell_segment``: between segments more than ``max_tree_dist`` joins apart.
    """
    e = knn.select(F.col("cell").alias("a"), F.col("nbr").alias("b"), "dist", "rank")
    if cut_cells is not None:
        e = e.join(fence(e.where("rank = 2"), "dist", cut_cells, scratch).select("a"), "a", "left_semi")
    if cut_edges is not None:
        e = fence(e, "dist", cut_edges, scratch)
    if max_pt_diff is not None:
        at = lambda c: pt.select(F.col("cell").alias(c), F.col("pseudotime").alias(f"pt_{c}"))
        e = e.join(at("a"), "a").join(at("b"), "b").where(F.abs(F.col("pt_a") - F.col("pt_b")) <= max_pt_diff)
    if joins is not None:
        of = lambda c: cell_segment.select(F.col("cell").alias(c), F.col("segment").alias(f"s_{c}"))
        e = tree_distance(joins, e.join(of("a"), "a").join(of("b"), "b"), "s_a", "s_b").where(F.col("tree_dist") <= max_tree_dist)
    return e.select("a", "b", "dist", F.try_divide(F.lit(1.0), "dist").alias("weight"))


def neighbor_time(knn: DataFrame, pt: DataFrame) -> DataFrame:
    """(cell, neighbor_pt): mean pseudotime of a cell's neighbours, weighted by one over distance; neighbours at
    distance zero weigh as much as all others together."""
    w = F.try_divide(F.lit(1.0), "dist")
    rows = knn.join(pt.select(F.col("cell").alias("nbr"), "pseudotime"), "nbr").withColumn("w", w)
    rest = rows.groupBy("cell").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("rest"))
    rows = rows.join(rest, "cell").withColumn("w", F.coalesce("w", "rest"))
    return rows.groupBy("cell").agg(F.try_divide(F.sum(F.col("w") * F.col("pseudotime")), F.sum("w")).alias("neighbor_pt"))


def undirected(edges: DataFrame) -> DataFrame:
    """(i, j, w) in both directions from (a, b, weight): what two cells have between them is added up."""
    one = edges.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("weight").alias("w")).where("i <> j")
    return one.union(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def start_places(graph: DataFrame, seed: int = 1) -> DataFrame:
    """(cell, x, y) on a disc whose area grows with the cells, by a hash of the cell."""
    u = lambda k: (F.pmod(F.xxhash64("cell", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    cells = graph.select(F.col("i").alias("cell")).distinct()
    n = cells.agg(F.sqrt(F.count("*")).alias("_r"))
    r, t = F.col("_r") * F.sqrt(u(0)), 2 * math.pi * u(1)
    return cells.crossJoin(F.broadcast(n)).select("cell", (r * F.cos(t)).alias("x"), (r * F.sin(t)).alias("y"))


def _push(grid: field.Box, mass: np.ndarray) -> dict[str, np.ndarray]:
    """Pushes of one over distance from all nodes; within a node's width they are softened."""
    soft = grid.step**2
    return {"fx": grid.convolve(mass, lambda x, y: x / (x * x + y * y + soft)), "fy": grid.convolve(mass, lambda x, y: y / (x * x + y * y + soft))}


def _pulls(graph: DataFrame, places: DataFrame) -> DataFrame:
    """(cell, gx, gy): weight times squared distance, towards each neighbour."""
    e = graph.join(places.select(F.col("cell").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")), "i")
    e = e.join(places.select(F.col("cell").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")), "j")
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    pull = F.col("w") * F.sqrt(dx * dx + dy * dy)
    return e.groupBy(F.col("i").alias("cell")).agg(F.sum(pull * dx).alias("gx"), F.sum(pull * dy).alias("gy"))


def energy(graph: DataFrame, places: DataFrame, grid_size: int = 64) -> float:
    """What the layout lowers: a third of weight times cubed distance over edges, less the logarithm of the
    distance over all pairs, which the grid adds up."""
    grid = field.Box.around(places, grid_size)
    mass = field.masses(places, grid)
    soft = grid.step**2
    push = field.read(places, grid, {"e": grid.convolve(mass, lambda x, y: np.log(x * x + y * y + soft) / 2)}).agg(F.sum("e")).first()[0]
    e = graph.where("i < j").join(places.toDF("i", "xi", "yi"), "i").join(places.toDF("j", "xj", "yj"), "j")
    d = F.hypot(F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj"))
    return float(e.agg(F.sum(F.col("w") * d * d * d / 3)).first()[0] or 0.0) - (push or 0.0) / 2


def force_layout(graph: DataFrame, scratch, places: DataFrame | None = None, rounds: int = 50, start_temp: float | None = None, grid_size: int = 64, seed: int = 1) -> DataFrame:
    """(cell, x, y) of (i, j, w) in both directions.

    In each round a cell goes where pulls and pushes add up to, by at most the temperature, which
    falls in equal steps to zero; it starts at the square root of the number of cells. Starts from
    ``places``, or a disc. Equal input and seed give the same places up to rounding.
    """
    graph = scratch.table(graph, "graph")
    now = start_places(graph, seed) if places is None else places.join(graph.select(F.col("i").alias("cell")).distinct(), "cell", "left_semi")
    now = scratch.table(now.select("cell", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "places0")
    temp = start_temp or math.sqrt(max(now.count(), 1))
    for r in range(1, rounds + 1):
        grid = field.Box.around(now, grid_size)
        pushed = field.read(now, grid, _push(grid, field.masses(now, grid)))
        moved = pushed.join(_pulls(graph, now), "cell", "left")
        dx, dy = F.col("fx") + F.coalesce("gx", F.lit(0.0)), F.col("fy") + F.coalesce("gy", F.lit(0.0))
        far = F.hypot(dx, dy)
        share: Column = F.when(far > temp * (1 - (r - 1) / rounds), temp * (1 - (r - 1) / rounds) / far).otherwise(1.0)
        now = scratch.table(moved.select("cell", (F.col("x") + dx * share).alias("x"), (F.col("y") + dy * share).alias("y")), f"places{r}")
        scratch.drop(f"places{r - 1}")
    return now


def telescope(places: DataFrame, times: DataFrame) -> DataFrame:
    """(cell, x, y, telescope_pt): the third coordinate is the neighbours' pseudotime, stretched so that its
    largest value is the mean of the largest x and y."""
    met = places.join(times, "cell", "left")
    top = met.agg(((F.max("x") + F.max("y")) / 2).alias("_t"), F.max("neighbor_pt").alias("_p"))
    return met.crossJoin(F.broadcast(top)).select("cell", "x", "y", (F.col("neighbor_pt") * F.try_divide("_t", "_p")).alias("telescope_pt"))
