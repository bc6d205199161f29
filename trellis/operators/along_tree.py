"""Differential expression along a lineage: each segment from a tip to the root against its siblings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.operators import markers, tree


def comparisons(joins: DataFrame, limits: DataFrame, cell_segment: DataFrame, pt: DataFrame, tip, root=None, skip: list | None = None) -> DataFrame:
    """(depth, segment, opposing, cell, side) of every comparison from ``tip`` upwards.

    Side 1 are the cells of a segment on the way up, side 2 those of one sibling and of all below it
    whose pseudotime is within the limits of the segment; depth counts from the tip. Segments from
    ``root`` on are left out, and those in ``skip``.
    """
    up = tree.ancestors(joins)
    own = joins.where(F.col("child") == F.lit(tip)).select(F.col("child").alias("segment"), F.lit(0).alias("depth"))
    path = own.union(up.where(F.col("segment") == F.lit(tip)).select(F.col("ancestor").alias("segment"), "depth"))
    if root is not None:
        end = path.where(F.col("segment") == F.lit(root)).agg(F.min("depth").alias("end"))
        path = path.join(F.broadcast(end), F.col("end").isNull() | (F.col("depth") < F.col("end"))).drop("end")
    if skip:
        path = path.where(~F.col("segment").isin(skip))
    # only of what lies on the way: all siblings of a wide tree are quadratic in its leaves
    parents = path.join(joins.select(F.col("child").alias("segment"), "parent"), "segment")
    pairs = parents.join(joins.select("parent", F.col("child").alias("opposing")), "parent").where("segment <> opposing").drop("parent")
    below = up.select(F.col("ancestor").alias("opposing"), F.col("segment").alias("at")).union(joins.select(F.col("child").alias("opposing"), F.col("child").alias("at")))
    first = pairs.join(cell_segment, "segment").select("depth", "segment", "opposing", "cell", F.lit(1).alias("side"))
    other = pairs.join(below, "opposing").join(cell_segment.toDF("cell", "at"), "at").join(limits, "segment").join(pt.select("cell", "pseudotime"), "cell")
    other = other.where(F.col("pseudotime").between(F.col("start"), F.col("end"))).select("depth", "segment", "opposing", "cell", F.lit(2).alias("side"))
    return first.distinct().union(other.distinct())


def _named(compared: DataFrame) -> DataFrame:
    return compared.withColumn("cmp", F.concat_ws("-", F.col("segment").cast("string"), F.col("opposing").cast("string")))


def _chain(found: DataFrame, against: DataFrame, names: DataFrame, must_beat: float) -> DataFrame:
    """Of (cmp, gene, ...) what no segment farther down has against it, and what enough siblings are beaten in."""
    of = found.join(names, "cmp")
    lowest = against.join(names, "cmp").groupBy("gene").agg(F.min("depth").alias("low"))
    kept = of.join(lowest, "gene", "left").where(F.col("low").isNull() | (F.col("low") >= F.col("depth"))).drop("low")
    siblings = names.groupBy("segment").agg(F.count("*").alias("siblings"))
    beaten = F.count("*").over(W.partitionBy("segment", "gene"))
    return kept.join(siblings, "segment").withColumn("beaten", beaten).where(F.col("beaten") >= F.col("siblings") * must_beat).drop("beaten", "siblings")


def _summary(kept: DataFrame, every: DataFrame, by: str) -> DataFrame:
    """Both the strongest and the weakest branch of a gene beside its figures over all cells."""
    order = F.struct(F.col(by), -F.col("depth"), F.col("cmp"))
    best = kept.groupBy("gene").agg(F.max_by(F.struct("cmp", by), order).alias("x"), F.min_by(F.struct("cmp", by), F.struct(by, "depth", "cmp")).alias("n"))
    out = best.select("gene", F.col("x.cmp").alias("segment_max"), F.col(f"x.{by}").alias(f"{by}_max"), F.col("n.cmp").alias("segment_min"), F.col(f"n.{by}").alias(f"{by}_min"))
    return every.drop("cmp").join(out, "gene")


def auc_pr(expr: DataFrame, compared: DataFrame, scratch, effect: float = 0.25, min_frac: float = 0.1, min_diff: float = 0.1, factor: float = 1.0, cap: float = 1.0, must_beat: float = 0.5, only_global: bool = False) -> DataFrame:
    """Markers along a lineage by precision and recall. All comparisons run at once, in both directions,
    since a marker of the other side farther down rules a gene out."""
    compared = scratch.table(_named(compared), "compared")
    sides = compared.select("cmp", "cell", "side")
    names = compared.select("cmp", "segment", "depth").distinct()
    options = {"effect": effect, "min_frac": min_frac, "min_diff": min_diff, "factor": factor, "cap": cap}
    both = sides.withColumn("cmp", F.concat(F.lit("+"), "cmp")).union(sides.select(F.concat(F.lit("-"), "cmp"), "cell", 3 - F.col("side")))
    tested = scratch.table(markers.markers_auc_pr(expr, both, **options).where("exp_fc > 0"), "tested")
    one = lambda sign: tested.where(F.col("cmp").startswith(sign)).withColumn("cmp", F.substr("cmp", F.lit(2)))
    kept = scratch.table(_chain(one("+"), one("-"), names, must_beat), "kept")
    if not only_global:
        options = {"effect": 0.0, "min_frac": 0.0, "min_diff": 0.0}
    genes = expr.join(kept.select("gene").distinct(), "gene", "left_semi")
    every = markers.markers_auc_pr(genes, sides.withColumn("cmp", F.lit("all")), **options)
    return _summary(kept, every, "ratio")


def binom(expr: DataFrame, counts: DataFrame, compared: DataFrame, scratch, effect: float = 0.6931471805599453, p_max: float = 0.01, min_frac: float = 0.1, must_beat: float = 0.5, only_global: bool = False) -> DataFrame:
    """Markers along a lineage by the binomial test; a gene depleted farther down is none."""
    compared = scratch.table(_named(compared), "compared")
    sides = compared.select("cmp", "cell", "side")
    names = compared.select("cmp", "segment", "depth").distinct()
    genes = expr.select("gene").distinct()
    tested = scratch.table(markers.markers_binom(expr, counts, sides, effect, p_max, min_frac, genes=genes), "tested")
    kept = scratch.table(_chain(tested, tested.where("log_effect < 0"), names, must_beat), "kept")
    options = (effect, p_max, min_frac) if only_global else (0.0, 1.0, 0.0)
    remain = kept.select("gene").distinct()
    every = markers.markers_binom(expr.join(remain, "gene", "left_semi"), counts.join(remain, "gene", "left_semi"), sides.withColumn("cmp", F.lit("all")), *options)
    return _summary(kept, every, "log_effect")


def modules(values: DataFrame, cells: DataFrame, compared: DataFrame, scratch, effect: float = 0.6931471805599453, p_max: float = 0.01, least: float = 0.1, beat_all: bool = True) -> DataFrame:
    """(name, state) of (name, cell, v): "up" where a segment on the way beats all its siblings (any, if
    not ``beat_all``), "down" where some comparison shows it lower, on either side with enough of it. Only
    ``cells`` that have data are compared; those without a row of a name are zeros."""
    compared = scratch.table(_named(compared.join(cells.select("cell"), "cell", "left_semi")), "compared")
    names = compared.select("cmp", "segment").distinct()
    tested = scratch.table(markers.welch(values, compared.select("cmp", "cell", "side"), p_max, effect), "tested")
    up = tested.where((F.col("log_fc") > 0) & (F.col("m1") >= least)).join(names, "cmp")
    if beat_all:
        siblings = names.groupBy("segment").agg(F.count("*").alias("n"))
        up = up.groupBy("segment", "name").agg(F.count("*").alias("k")).join(siblings, "segment").where("k = n")
    down = tested.where((F.col("log_fc") < 0) & (F.col("m2") >= least))
    return up.select("name").distinct().withColumn("state", F.lit("up")).union(down.select("name").distinct().withColumn("state", F.lit("down")))


def module_genes(states: DataFrame, members: DataFrame) -> DataFrame:
    """Genes of the modules that go up, without those of any that goes down; ``members``: (name, gene)."""
    of = lambda s: members.join(states.where(F.col("state") == s), "name", "left_semi").select("gene").distinct()
    return of("up").join(of("down"), "gene", "left_anti")


def auc_pr_by_factor(expr: DataFrame, sets: DataFrame, groups: DataFrame, scratch, effect: float = 0.25, factor: float = 1.0, least_auc: float = 0.1, most_auc: float = float("inf"), min_frac: float = 0.1, min_diff: float = 0.0, min_groups: int = 1) -> DataFrame:
    """Genes that mark one set of cells against several others within each value of a factor.

    ``sets``: (name, cell), the set called "one" against all others; ``groups``: (cell, grp). A gene
    marks a group where it passes against every other set there. One row a gene: how many groups
    it marks, and its best comparison.
    """
    placed = sets.join(groups, "cell")
    others = sets.where("name <> 'one'").select(F.col("name").alias("other")).distinct()
    one = placed.where("name = 'one'").crossJoin(F.broadcast(others)).select("grp", "other", "cell", F.lit(1).alias("side"))
    rest = placed.where("name <> 'one'").select("grp", F.col("name").alias("other"), "cell", F.lit(2).alias("side"))
    sides = scratch.table(one.union(rest).withColumn("cmp", F.concat_ws("|", "grp", "other")), "sides")
    raw = scratch.table(markers.markers_auc_pr(expr, sides.select("cmp", "cell", "side"), effect, min_frac, 0.0, min_diff, 1.0, float("inf")), "raw")
    sizes = sides.groupBy("cmp", "grp").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))
    bound = F.least(F.greatest(F.lit(least_auc), F.col("n1") / (F.col("n1") + F.col("n2")) * factor), F.lit(most_auc))
    passed = raw.join(sizes, "cmp").where((F.col("auc") >= bound) & (F.col("exp_fc") > 0))
    k = others.agg(F.count("*").alias("k"))
    marked = passed.groupBy("gene", "grp").agg(F.count("*").alias("beaten")).join(F.broadcast(k), F.col("beaten") == F.col("k"))
    enough = marked.groupBy("gene").agg(F.count("*").alias("groups_marked")).where(F.col("groups_marked") >= min_groups)
    best = raw.groupBy("gene").agg(F.max_by(F.struct("cmp", "auc", "exp_fc", "frac_1", "frac_2", "exp_1", "exp_2"), F.struct("auc", "cmp")).alias("b"))
    return enough.join(best, "gene").select("gene", "groups_marked", F.col("b.cmp").alias("comparison_best"), F.col("b.auc").alias("auc_best"), F.col("b.exp_fc").alias("exp_fc_best"), F.col("b.frac_1").alias("frac_1"), F.col("b.frac_2").alias("frac_2"), F.col("b.exp_1").alias("exp_1"), F.col("b.exp_2").alias("exp_2"))
