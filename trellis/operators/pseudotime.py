"""Floods, biased walks, and what is read off them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.expr import combine_probs, logistic
from trellis.operators import pivots
from trellis.plans import order


def flood_matrix(edges: DataFrame) -> DataFrame:
    """Weights over the largest row sum."""
    top = edges.groupBy("i").agg(F.sum("w").alias("s")).agg(F.max("s").alias("top"))
    return edges.crossJoin(F.broadcast(top)).select("i", "j", (F.col("w") / F.col("top")).alias("w"))


def _uniform(*cols) -> Column:
    """A uniform number of a key, the same however rows are dealt."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _into(edges: DataFrame) -> DataFrame:
    """(from, cell, miss): the logarithm of the chance that an edge (i, j, w) does not lead from visited j to i."""
    return edges.where("w > 0").select(F.col("j").alias("from"), F.col("i").alias("cell"), F.when(F.col("w") < 1, F.log1p(-F.col("w"))).otherwise(float("-inf")).alias("miss"))


def flood_chances(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """(cell, chance): with which chance a flood goes on from the ``visited`` cells to each other cell."""
    met = visited.select(F.col("cell").alias("from")).distinct().join(_into(edges), "from")
    return met.groupBy("cell").agg((1 - F.exp(F.sum("miss"))).alias("chance")).join(visited, "cell", "left_anti")


def flood(edges: DataFrame, roots: list, n: int, scratch, seed: int = 1, least_new: int = 2) -> DataFrame:
    """(sim, cell, step) of ``n`` probabilistic floods, all in one table.

    A cell i not yet visited is reached with one minus the product of (1 - w) over its edges (i, j, w) to
    visited cells j. A flood ends when all but one cell are visited or a step visits fewer than
    ``least_new``; there is no other limit. What a cell has escaped so far is kept as a sum of
    logarithms, so a step joins only the cells of the step before to their edges.
    """
    spark = edges.sparkSession
    kind = edges.schema["i"].dataType.simpleString()
    into = scratch.table(_into(edges), "into")
    total = edges.select("i").union(edges.select("j")).distinct().count()
    start = spark.range(n).select(F.col("id").cast("int").alias("sim")).crossJoin(F.broadcast(spark.createDataFrame([(r,) for r in roots], f"cell {kind}").distinct()))
    seen = scratch.table(start.select("sim", "cell", F.lit(0.0).alias("miss"), F.lit(0).alias("step")), "flood0")
    step = 0
    while True:
        going = seen.where("step is not null").groupBy("sim").agg(F.count("*").alias("k"), F.count_if(F.col("step") == step).alias("new")).where((F.col("k") < total - 1) & ((F.col("new") >= least_new) | F.lit(step == 0))).select("sim")
        front = seen.where(F.col("step") == step).join(going, "sim", "left_semi").select("sim", F.col("cell").alias("from"))
        if front.isEmpty():
            break
        step += 1
        more = front.join(into, "from").groupBy("sim", "cell").agg(F.sum("miss").alias("_more"))
        both = seen.join(more, ["sim", "cell"], "full").withColumn("miss", F.coalesce("miss", F.lit(0.0)) + F.coalesce("_more", F.lit(0.0)))
        live = both.join(going.withColumn("live", F.lit(True)), "sim", "left")
        drawn = F.col("step").isNull() & F.col("live") & (_uniform(F.lit(seed), "sim", F.lit(step), "cell") < 1 - F.exp("miss"))
        after = live.select("sim", "cell", "miss", F.when(drawn, step).otherwise(F.col("step")).cast("int").alias("step"))
        seen = scratch.table(after, f"flood{step}")
        scratch.drop(f"flood{step - 1}")
    return seen.where("step is not null").select("sim", "cell", "step")


def process_floods(floods: DataFrame, max_missing: float = 0.4, divisions: int = 10, fun=F.avg) -> tuple[DataFrame, DataFrame]:
    """(pseudotime, stability): each flood over its largest step; cells that too many missed are dropped."""
    sims = floods.select("sim").distinct().count()
    ok = floods.groupBy("cell").agg(F.count("step").alias("k")).where(1 - F.col("k") / sims <= max_missing).select("cell")
    top = floods.groupBy("sim").agg(F.max("step").alias("top"))
    rel = floods.join(top, "sim").join(ok, "cell", "left_semi").select("sim", "cell", F.try_divide("step", "top").alias("t"))
    pt = rel.groupBy("cell").agg(fun("t").alias("pseudotime"), F.count("t").alias("visits")).withColumn("visits_log", F.log10(F.col("visits") + 1))
    cuts = sorted({math.ceil(i / divisions * sims) for i in range(1, divisions + 1)})
    place = rel.withColumn("at", F.col("sim") + 1)
    stab = place.withColumn("n_sims", F.explode(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("at")))).groupBy("cell", "n_sims").agg(fun("t").alias("pseudotime"), F.count("t").alias("visits"))
    return pt, stab


def logistic_params(pt: DataFrame, forward: int, back: int, scratch) -> DataFrame:
    """One row (back, forward, x0, k): mean distances to the cells so far back and forward in
    decreasing pseudotime, the midpoint, and the slope that leaves one per cent at the far end."""
    rows = order.ranked(pt.where("pseudotime is not null").select("cell", "pseudotime"), [F.desc("pseudotime"), "cell"], scratch, "by_time")
    gap = lambda k: order.shifted(rows, k, {"pseudotime": "other"})
    b = gap(back).agg(F.avg(F.col("pseudotime") - F.col("other")).alias("back"))
    m = b.crossJoin(gap(forward).agg(F.avg(F.col("other") - F.col("pseudotime")).alias("forward")))
    return m.withColumn("x0", (F.col("back") + F.col("forward")) / 2).withColumn("k", F.ln(F.lit(0.01)) / (F.col("x0") - F.col("forward")))


def weighted_edges(edges: DataFrame, pt: DataFrame, params: DataFrame) -> DataFrame:
    """Transitions times the logistic of the pseudotime difference; stays sparse."""
    p = pt.where("pseudotime is not null").select("cell", "pseudotime")
    e = edges.join(p.toDF("i", "pi"), "i").join(p.toDF("j", "pj"), "j").crossJoin(F.broadcast(params.select("x0", "k")))
    return e.select("i", "j", (F.col("w") * logistic(F.col("pj") - F.col("pi"), F.col("x0"), F.col("k"))).alias("w"))


def process_walks(walks: DataFrame, keys: list[str] | None = None, fun=F.avg) -> DataFrame:
    """Visits and mean relative position of each cell over (keys, walk, pos, cell)."""
    keys = keys or []
    length = walks.groupBy(*keys, "walk").agg(F.max("pos").alias("len"))
    hop = walks.join(length, [*keys, "walk"]).withColumn("hop", F.col("pos") / F.col("len"))
    out = hop.groupBy(*keys, "cell").agg(F.count("*").alias("visits"), fun("hop").alias("pseudotime"))
    return out.withColumn("visits_log", F.log10(F.col("visits") + 1))


def walk_prefixes(walks: DataFrame, scratch, divisions: int = 10, fun=F.avg) -> DataFrame:
    """The same over the first tenth of the walks, the first two tenths, and so on to all of them; walks are
    numbered by their id and cut at the upward rounded parts of their number."""
    number = order.ranked(walks.select("walk").distinct(), ["walk"], scratch, "numbers").select("walk", F.col("rank").alias("nr"))
    n = number.count()
    cuts = sorted({math.ceil(i / divisions * n) for i in range(1, divisions + 1)} - {0})
    length = walks.groupBy("walk").agg(F.max("pos").alias("len"))
    hop = walks.join(length, "walk").join(number, "walk").withColumn("hop", F.col("pos") / F.col("len"))
    part = hop.withColumn("n_walks", F.explode(F.filter(F.array(*[F.lit(c).cast("int") for c in cuts]), lambda c: c >= F.col("nr"))))
    return part.groupBy("n_walks", "cell").agg(F.count("*").alias("visits"), fun("hop").alias("pseudotime"))


def stability_change(prefixes: DataFrame, n: str = "n_walks") -> DataFrame:
    """Sum over cells of how far estimates move from one prefix to the next."""
    w = W.partitionBy("cell").orderBy(n)
    return prefixes.withColumn("d", F.abs(F.col("pseudotime") - F.lag("pseudotime").over(w))).groupBy(n).agg(F.sum("d").alias("change"))


def tip_potential(vectors: DataFrame, pt: DataFrame, low: float, high: float, scratch) -> DataFrame:
    """(cell, tip_potential): share of the cells at distances of ``low`` to ``high`` whose pseudotime is not later.
    Exact; pivots tell which cells need not be compared."""
    v = scratch.table(vectors.join(pt.where("pseudotime is not null").select("cell", F.col("pseudotime").cast("double").alias("t")), "cell").select(F.col("cell").alias("id"), "vec", "t"), "timed")
    found = pivots.Index(v, scratch).earlier_within(v, low, high)
    return found.where("n > 0").select(F.col("id").alias("cell"), (F.col("earlier") / F.col("n")).alias("tip_potential"))


def cluster_tip_potential(edges: DataFrame, groups: DataFrame, pt: DataFrame) -> DataFrame:
    """For each group: weighted share of outside cells that are earlier than its mean."""
    p = pt.select("cell", "pseudotime")
    mean = groups.join(p, "cell").groupBy("grp").agg(F.avg("pseudotime").alias("mean"))
    inside = edges.join(groups.toDF("i", "grp"), "i").join(groups.toDF("j", "other"), "j").where("grp <> other")
    near = inside.groupBy("grp", F.col("j").alias("cell")).agg(combine_probs("w").alias("p")).join(p, "cell").join(mean, "grp")
    return near.groupBy("grp").agg(F.try_divide(F.sum(F.when(F.col("pseudotime") < F.col("mean"), F.col("p")).otherwise(0.0)), F.sum("p")).alias("tip_potential"))
