"""Differential expression: precision-recall areas, binomial and Welch tests, p-value adjustment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.stats import binom_upper, t_two_sided
from trellis.plans import order


def area_pr(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the precision-recall curve of each key, from (keys, value, p, n): how many of
    either class have the value. Thresholds are the distinct values, highest first; trapezoids over
    recall start at the first of them."""
    w = W.partitionBy(*keys).orderBy(F.desc("value"))
    run = w.rowsBetween(W.unboundedPreceding, 0)
    curve = counts.withColumns({"tp": F.sum("p").over(run), "fp": F.sum("n").over(run), "all_p": F.sum("p").over(W.partitionBy(*keys))})
    curve = curve.withColumns({"rec": F.try_divide("tp", "all_p"), "prec": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))})
    step = (F.col("rec") - F.lag("rec").over(w)) * (F.col("prec") + F.lag("prec").over(w)) / 2
    return curve.withColumn("step", step).groupBy(*keys).agg(F.round(F.coalesce(F.sum("step"), F.lit(0.0)), 3).alias("auc"))


def auc_threshold(n1: Column, n2: Column, factor: float = 1.0, cap: float = float("inf")) -> Column:
    return F.least(n1 / (n1 + n2) * factor, F.lit(cap))


def one_against_rest(groups: DataFrame, names: list | None = None) -> DataFrame:
    """(cmp, cell, side) from (cell, grp): each group against all other cells. Groups are few."""
    if names is None:
        names = sorted(r["grp"] for r in groups.select("grp").distinct().collect())
    cmp = F.explode(F.array(*[F.lit(n) for n in names])).alias("cmp")
    return groups.select("cell", "grp", cmp).select("cmp", "cell", F.when(F.col("grp") == F.col("cmp"), 1).otherwise(2).alias("side"))


def side_counts(expr: DataFrame, sides: DataFrame) -> DataFrame:
    """Sizes of both sides of each comparison: (cmp, n1, n2) from (cmp, cell, side)."""
    return sides.groupBy("cmp").agg(F.count_if(F.col("side") == 1).alias("n1"), F.count_if(F.col("side") == 2).alias("n2"))


def classes(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((cell, cls), (cls, cmp, side)): cells that stand on the same sides of the same comparisons are one class.

    Values are added up by class before they meet a comparison, so none is copied once for each of them;
    there are about as many classes as groups or segments.
    """
    of = sides.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("cmp", "side"))).alias("m")).withColumn("cls", F.xxhash64("m"))
    one = of.groupBy("cls").agg(F.any_value("m").alias("m")).select("cls", F.explode("m").alias("m"))
    return of.select("cell", "cls"), one.select("cls", "m.cmp", "m.side")


def markers_auc_pr(expr: DataFrame, sides: DataFrame, effect: float = 0.25, min_frac: float = 0.1, exp_threshold: float = 0.0, min_diff: float = 0.0, factor: float = 1.0, cap: float = 1.0) -> DataFrame:
    """Markers of side 1 against side 2 for many comparisons at once, ``sides``: (cmp, cell, side).

    Means and shares are over all cells of a side, with or without rows. Only genes past the cheap
    filters get a curve. Rows of ``expr`` are counted by class, gene and value once; all else starts there.
    """
    sizes = side_counts(expr, sides)
    cls, of = classes(sides)
    counted = expr.join(cls, "cell").groupBy("cls", "gene", "value").agg(F.count("*").alias("c"))
    met = counted.join(of, "cls")
    one = lambda s, v: F.coalesce(F.sum(F.when(F.col("side") == s, v)), F.lit(0))
    un = (F.pow(F.lit(2.0), "value") - 1) * F.col("c")
    over = F.when(F.col("value") > exp_threshold, F.col("c")).otherwise(0)
    sums = met.groupBy("cmp", "gene").agg(*[one(s, un).alias(f"u{s}") for s in (1, 2)], *[one(s, over).alias(f"k{s}") for s in (1, 2)])
    g = sums.join(sizes, "cmp").where("n1 > 0 and n2 > 0")
    g = g.withColumns({f"frac_{s}": F.round(F.col(f"k{s}") / F.col(f"n{s}"), 3) for s in (1, 2)} | {f"exp_{s}": F.round(F.log2(F.col(f"u{s}") / F.col(f"n{s}") + 1), 3) for s in (1, 2)})
    ratio = (F.pow(F.lit(2.0), "exp_1") - 1) / F.nullif(F.pow(F.lit(2.0), "exp_2") - 1, F.lit(0.0))
    g = g.withColumn("exp_fc", F.when((F.col("exp_2") == 0) & (F.col("exp_1") > 0), F.lit(float("inf"))).when(F.col("exp_1") > 0, F.log2(ratio)))
    g = g.where((F.greatest("frac_1", "frac_2") > min_frac) & (F.abs(F.col("frac_1") - F.col("frac_2")) > min_diff) & (F.col("exp_fc") > effect))
    passed = g.select("cmp", "gene", "n1", "n2", "frac_1", "frac_2", "exp_1", "exp_2", "exp_fc")
    rows = met.join(passed.select("cmp", "gene"), ["cmp", "gene"], "left_semi").groupBy("cmp", "gene", "value").agg(one(1, F.col("c")).alias("p"), one(2, F.col("c")).alias("n"))
    some = rows.where("value <> 0")
    zeros = passed.select("cmp", "gene", "n1", "n2").join(some.groupBy("cmp", "gene").agg(F.sum("p").alias("sp"), F.sum("n").alias("sn")), ["cmp", "gene"], "left")
    zeros = zeros.select("cmp", "gene", F.lit(0.0).alias("value"), (F.col("n1") - F.coalesce("sp", F.lit(0))).alias("p"), (F.col("n2") - F.coalesce("sn", F.lit(0))).alias("n")).where("p + n > 0")
    auc = area_pr(some.union(zeros), ["cmp", "gene"])
    out = passed.join(auc, ["cmp", "gene"]).withColumn("ratio", F.col("auc") / (F.col("n1") / (F.col("n1") + F.col("n2"))))
    return out.where(F.col("auc") >= auc_threshold(F.col("n1"), F.col("n2"), factor, cap)).drop("n1", "n2")


def adjust_bh(df: DataFrame, p: str, keys: list[str] | None = None, scratch=None) -> DataFrame:
    """False discovery rate: the least of p * n / rank over this and all larger ranks. Without ``keys`` the
    order is that of the whole table, kept over range partitions in ``scratch``."""
    if not keys:
        n = df.count()
        out = order.running(order.ranked(df, [p], scratch), F.col(p) * n / F.col("rank"), "min", "_low", reverse=True)
        return out.withColumn("p_adj", F.least(F.lit(1.0), "_low")).drop("_low", "rank", "part")
    by = W.partitionBy(*keys)
    ranked = df.withColumns({"_r": F.row_number().over(by.orderBy(p)), "_n": F.count("*").over(by)})
    back = by.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("p_adj", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(back))).drop("_r", "_n")


def adjust_holm(df: DataFrame, p: str, keys: list[str] | None = None, scratch=None) -> DataFrame:
    """Step-down adjustment: the greatest of p * (n - rank + 1) over this and all smaller ranks; equal p-values
    share the largest. Without ``keys`` as for ``adjust_bh``."""
    if not keys:
        n = df.count()
        out = order.running(order.ranked(df, [p], scratch), F.col(p) * (n - F.col("rank") + 1), "max", "_high")
        # the first of equal p-values has the largest product of them
        first = F.max("_high").over(W.partitionBy(p))
        return out.withColumn("p_adj", F.least(F.lit(1.0), first)).drop("_high", "rank", "part")
    by = W.partitionBy(*keys)
    ranked = df.withColumns({"_r": F.row_number().over(by.orderBy(p)), "_n": F.count("*").over(by)})
    run = by.orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    ranked = ranked.withColumn("p_adj", F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_n") - F.col("_r") + 1)).over(run)))
    # equal p-values share the largest adjusted value
    return ranked.withColumn("p_adj", F.max("p_adj").over(W.partitionBy(*keys, p))).drop("_r", "_n")


def markers_binom(expr: DataFrame, counts: DataFrame, sides: DataFrame, effect: float = float(np.log(2)), p_max: float = 0.01, min_frac: float = 0.1, either: bool = True, genes: DataFrame | None = None) -> DataFrame:
    """Binomial test of expressing cells, in both directions: (cmp, gene, p_adj, log_effect, frac_1, ...).

    All of ``genes`` (those of ``expr``, if not given) are tested and adjusted for in every comparison,
    those no cell expresses with the p-value that this has. Where a side has no expressing cell its share
    counts as one cell in the probability, but not in ``log_effect``, which is then infinite. Shares
    must reach ``min_frac`` on either side, or on side 1 alone where that is compared with the rest
    (``either`` false). A gene whose effect is zero can be found in both directions.
    """

    @F.pandas_udf("double")
    def upper(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(binom_upper(k.to_numpy(float), n.to_numpy(float), p.to_numpy(float)))

    sizes = side_counts(expr, sides).where("n1 > 0 and n2 > 0")
    cls, of = classes(sides)
    names = (expr if genes is None else genes).select("gene").distinct()

    def by_side(rows: DataFrame, value: Column, name: str) -> DataFrame:
        part = rows.join(cls, "cell").groupBy("cls", "gene").agg(F.sum(value).alias("x")).join(of, "cls")
        return part.groupBy("cmp", "gene").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("x"))), F.lit(0)).alias(f"{name}{s}") for s in (1, 2)])

    k = by_side(expr.where("value > 0"), F.lit(1), "k")
    means = by_side(counts, F.col("count"), "t")
    g = names.crossJoin(F.broadcast(sizes)).join(k, ["cmp", "gene"], "left").join(means, ["cmp", "gene"], "left").na.fill(0, ["k1", "k2", "t1", "t2"])
    floor = lambda c: F.greatest(F.col(c), F.lit(1))
    up = g.withColumn("p", upper("k1", "n1", F.least(floor("k2") / F.col("n2"), F.lit(1.0)))).withColumn("dir", F.lit(1))
    down = g.withColumn("p", upper("k2", "n2", F.least(floor("k1") / F.col("n1"), F.lit(1.0)))).withColumn("dir", F.lit(-1))
    both = adjust_bh(up.union(down), "p", ["cmp", "dir"])
    inf = F.lit(float("inf"))
    log_effect = F.when((F.col("k1") > 0) & (F.col("k2") > 0), F.ln(F.try_divide(F.col("k1") * F.col("n2"), F.col("k2") * F.col("n1")))).when(F.col("k1") > 0, inf).when(F.col("k2") > 0, -inf)
    both = both.withColumn("log_effect", log_effect).withColumns({f"frac_{s}": F.round(F.col(f"k{s}") / F.col(f"n{s}"), 3) for s in (1, 2)} | {f"trans_{s}": F.round(F.col(f"t{s}") / F.col(f"n{s}"), 3) for s in (1, 2)})
    frac = F.greatest("frac_1", "frac_2") if either else F.col("frac_1")
    ok = (F.col("log_effect") * F.col("dir") >= effect) & (F.col("p_adj") <= p_max) & (frac >= min_frac)
    return both.where(ok).select("cmp", "gene", "p_adj", "log_effect", "frac_1", "frac_2", "trans_1", "trans_2")


def nearest_groups(means: DataFrame) -> DataFrame:
    """(g1, g2): each group with the one of the nearest centroid, pairs once, from (grp, gene, m); absent
    genes are zeros. Groups are few."""
    a, b = means.toDF("g1", "gene", "m1"), means.toDF("g2", "gene", "m2")
    dots = a.join(b, "gene").groupBy("g1", "g2").agg(F.sum(F.col("m1") * F.col("m2")).alias("dot"))
    size = means.groupBy("grp").agg(F.sum(F.col("m") * F.col("m")).alias("s"))
    every = size.toDF("g1", "s1").crossJoin(F.broadcast(size.toDF("g2", "s2"))).where("g1 <> g2").join(dots, ["g1", "g2"], "left")
    near = every.groupBy("g1").agg(F.min_by("g2", F.struct(F.col("s1") + F.col("s2") - 2 * F.coalesce("dot", F.lit(0.0)), "g2")).alias("g2"))
    return near.select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).distinct()


def cluster_de(expr: DataFrame, counts: DataFrame, groups: DataFrame, means: DataFrame, effect: float = float(np.log(2)), p_max: float = 0.01, min_frac: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """((g1, g2, n_genes), marker rows) of each group against its nearest, by the binomial test.
    ``groups``: (cell, grp); ``means``: (grp, gene, m) over the genes that distances are taken over."""
    pairs = nearest_groups(means)
    named = pairs.select(F.concat_ws("-", "g1", "g2").alias("cmp"), "g1", "g2")
    side = lambda c, s: groups.join(F.broadcast(named), F.col("grp") == F.col(c)).select("cmp", "cell", F.lit(s).alias("side"))
    genes = markers_binom(expr, counts, side("g1", 1).union(side("g2", 2)), effect, p_max, min_frac)
    found = genes.groupBy("cmp").agg(F.count("*").alias("n"))
    return named.join(found, "cmp", "left").select("g1", "g2", F.coalesce("n", F.lit(0)).alias("n_genes")), genes


def welch_moments(values: DataFrame, sides: DataFrame) -> DataFrame:
    """(cmp, name, n1, n2, m1, m2, v1, v2) of (name, cell, v): sizes, means and variances of both sides, cells
    without a row being zeros. Values are added up by class once; nothing dense is made."""
    cls, of = classes(sides)
    sums = values.join(cls, "cell").groupBy("cls", "name").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(of, "cls")
    pick = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(c))), F.lit(0.0)).alias(f"{c}{s}")
    m = sums.groupBy("cmp", "name").agg(*[pick(s, c) for s in (1, 2) for c in ("s", "q")]).join(side_counts(values, sides), "cmp").where("n1 > 1 and n2 > 1")
    spread = lambda s: F.col(f"q{s}") - F.col(f"s{s}") * F.col(f"s{s}") / F.col(f"n{s}")
    var = lambda s: F.when(spread(s) > 1e-12 * F.col(f"q{s}"), spread(s) / (F.col(f"n{s}") - 1)).otherwise(0.0)  # noqa: E731  less is rounding
    return m.select("cmp", "name", "n1", "n2", *[(F.col(f"s{s}") / F.col(f"n{s}")).alias(f"m{s}") for s in (1, 2)], *[var(s).alias(f"v{s}") for s in (1, 2)])


def welch(values: DataFrame, sides: DataFrame, p_max: float, effect: float) -> DataFrame:
    """Welch's t-test for each name over (name, cell, v); cells of ``sides`` without a row are zeros. The logarithm
    of the ratio of means is infinite where one of them is zero."""

    @F.pandas_udf("double")
    def p_of(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))

    se1, se2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    m = welch_moments(values, sides).where("v1 + v2 > 0").withColumns({"t": (F.col("m1") - F.col("m2")) / F.sqrt(se1 + se2), "df": F.pow(se1 + se2, 2.0) / (F.pow(se1, 2.0) / (F.col("n1") - 1) + F.pow(se2, 2.0) / (F.col("n2") - 1))})
    log_fc = F.when(F.col("m1") * F.col("m2") > 0, F.ln(F.try_divide("m1", "m2"))).when((F.col("m1") > 0) & (F.col("m2") == 0), F.lit(float("inf"))).when((F.col("m1") == 0) & (F.col("m2") > 0), F.lit(float("-inf")))
    m = m.withColumns({"p": p_of("t", "df"), "log_fc": log_fc})
    return m.where((F.col("p") <= p_max) & (F.abs("log_fc") >= effect)).select("cmp", "name", "p", "m1", "m2", "log_fc", "t", "df")
