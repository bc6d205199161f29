"""Views of expression values, group summaries, doublets and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense(expr: DataFrame, cells: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """Every gene and cell with its value, zeros included; for the few genes that need it."""
    genes = expr.select("gene").distinct() if genes is None else genes
    return cells.select("cell").crossJoin(genes).join(expr, ["gene", "cell"], "left").select("gene", "cell", F.coalesce("value", F.lit(0.0)).alias("value"))


def z_scores(expr: DataFrame, cells: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(value - mean) / sd over all cells; genes without spread are dropped. Moments come from the
    rows that exist, so nothing dense is shuffled for them."""
    if genes is not None:
        expr = expr.join(genes, "gene", "left_semi")
    n = cells.agg(F.count("*").cast("double").alias("n"))
    s = expr.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(F.broadcast(n))
    s = s.select("gene", (F.col("s") / F.col("n")).alias("mean"), F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("sd")).where("sd > 1e-9")
    return dense(expr, cells, s.select("gene")).join(s, "gene").select("gene", "cell", ((F.col("value") - F.col("mean")) / F.col("sd")).alias("z"))


def binary(counts: DataFrame) -> DataFrame:
    return counts.withColumn("count", F.least("count", F.lit(1.0)))


def unlogged(expr: DataFrame, genes: list[str] | None = None) -> DataFrame:
    return (expr.where(F.col("gene").isin(genes)) if genes else expr).withColumn("value", F.pow(F.lit(2.0), "value") - 1)


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("grp").agg(F.count("*").alias("n"))


def summary_by_group(expr: DataFrame, groups: DataFrame, min_exp: float = 0.0) -> DataFrame:
    """Per group and gene: mean of logs and mean over all cells of the group, and share expressing."""
    sums = expr.join(groups, "cell").groupBy("grp", "gene").agg(F.sum(F.pow(F.lit(2.0), "value") - 1).alias("u"), F.sum("value").alias("s"), F.count_if(F.col("value") > min_exp).alias("k"))
    n = F.col("n")
    return sums.join(group_sizes(groups), "grp").select("grp", "gene", F.log2(F.col("u") / n + 1).alias("mean_of_logs"), (F.col("s") / n).alias("mean"), (F.col("k") / n).alias("prop_exp"))


def dot_values(expr: DataFrame, groups: DataFrame, min_exp: float = 0.05, expressing_only: bool = False) -> DataFrame:
    """(grp, gene, mean, prop_exp) of a dot plot: mean of logs over all cells of a group, or over its expressing
    ones only, where the share of these is at least ``min_exp``."""
    sums = expr.where("value > 0").join(groups, "cell").groupBy("grp", "gene").agg(F.sum(F.pow(F.lit(2.0), "value") - 1).alias("u"), F.count("*").alias("k")).join(group_sizes(groups), "grp")
    over = F.col("k") if expressing_only else F.col("n")
    return sums.select("grp", "gene", F.log2(F.col("u") / over + 1).alias("mean"), (F.col("k") / F.col("n")).alias("prop_exp")).where(F.col("prop_exp") >= min_exp)


def doublet_pairs(modules: DataFrame, high: float = 0.3, low: float = 0.15) -> DataFrame:
    """For each two modules: cells above both thresholds, their overlap, and its share of the smaller."""
    flags = modules.where(F.col("v") >= low).select("cell", "module", (F.col("v") >= high).cast("int").alias("h"))
    sizes = flags.groupBy("module").agg(F.sum("h").alias("nh"), F.count("*").alias("nl"))
    a, b = (flags.select("cell", F.col("module").alias(m), F.col("h").alias(h)) for m, h in (("m1", "h1"), ("m2", "h2")))
    both = a.join(b, "cell").where("m1 < m2").groupBy("m1", "m2").agg(F.sum(F.col("h1") * F.col("h2")).alias("oh"), F.count("*").alias("ol"))
    s1, s2 = (sizes.toDF(m, f"nh{m[1]}", f"nl{m[1]}") for m in ("m1", "m2"))
    every = s1.crossJoin(s2).where("m1 < m2").join(both, ["m1", "m2"], "left")
    share = lambda o, k: F.bround(F.coalesce(F.try_divide(F.coalesce(o, F.lit(0)), F.least(f"{k}1", f"{k}2")), F.lit(0.0)), 4)
    every = every.withColumns({"frac_high": share("oh", "nh"), "frac_low": share("ol", "nl")})
    return every.select("m1", "m2", F.coalesce("oh", F.lit(0)).alias("overlap_high"), F.coalesce("ol", F.lit(0)).alias("overlap_low"), "frac_high", "frac_low", F.bround(F.col("frac_low") - F.col("frac_high"), 4).alias("frac_diff"))


def doublet_cells(modules: DataFrame, pairs: DataFrame, threshold: float, max_overlap: float, max_diff: float) -> DataFrame:
    """Cells at the threshold or above for both modules of a pair that rarely overlaps."""
    ok = pairs.where((F.col("frac_high") <= max_overlap) & (F.col("frac_diff") <= max_diff)).select("m1", "m2")
    on = modules.where(F.col("v") >= threshold).select("cell", "module")
    a, b = on.withColumnRenamed("module", "m1"), on.withColumnRenamed("module", "m2")
    return a.join(b, "cell").join(ok, ["m1", "m2"], "left_semi").select("cell").distinct()


def modules_in_cells(modules: DataFrame, cells: DataFrame, names: list[str], threshold: float = float("inf")) -> DataFrame:
    """(cell, module, v, above) of each chosen cell and module, absent values as zeros."""
    every = cells.select("cell", F.explode(F.array(*[F.lit(n) for n in names])).alias("module"))
    v = F.coalesce("v", F.lit(0.0))
    return every.join(modules, ["cell", "module"], "left").select("cell", "module", v.alias("v"), (v >= threshold).alias("above"))


def between(col: str, low: float, high: float) -> Column:
    return F.col(col).between(low, high)


def threshold_bits(df: DataFrame, labels: list[tuple[str, float, float]]) -> DataFrame:
    """A string of one bit a label: whether it is strictly between its bounds."""
    bit = lambda c, lo, hi: F.coalesce(((F.col(c) > lo) & (F.col(c) < hi)).cast("int"), F.lit(0)).cast("string")
    return df.withColumn("bits", F.concat(*[bit(*x) for x in labels]))


def highlight(labels: DataFrame, wanted: list[tuple[str, str]], all_of: bool = True) -> DataFrame:
    """Cells with all, or any, of (name, value) among rows (cell, name, value)."""
    hit = F.lit(False)
    for n, v in wanted:
        hit |= (F.col("name") == n) & (F.col("value") == v)
    found = labels.where(hit).groupBy("cell").agg(F.count_distinct("name", "value").alias("k"))
    return found.where(F.col("k") == len(wanted) if all_of else F.col("k") > 0).select("cell")


def signature_score(expr: DataFrame, genes: list[str]) -> DataFrame:
    return expr.where(F.col("gene").isin(genes)).groupBy("cell").agg(F.log2(F.sum(F.pow(F.lit(2.0), "value") - 1) + 1).alias("score"))


def aggregate_columns(long: DataFrame, agg=F.avg) -> DataFrame:
    """Columns of one name become one."""
    return long.groupBy("row", "name").agg(agg("value").alias("value"))


def label_catalog(tables: dict[str, tuple[DataFrame, list[str]]], label: str) -> DataFrame:
    """(cell, value) of a label, from the first table in order that has it."""
    for df, names in tables.values():
        if label in names:
            return df.select("cell", F.col(f"`{label}`").alias("value")) if label in df.columns else df.where(F.col("name") == label).select("cell", "value")
    raise KeyError(label)


def cells_in_cluster(groups: DataFrame, clusters: list) -> DataFrame:
    return groups.where(F.col("grp").isin(clusters)).select("cell")


def group_from_cells(cells: DataFrame, name: str, members: dict[str, DataFrame]) -> DataFrame:
    """(cell, grouping, value): each listed cell under its list's name; of several lists the last counts."""
    out = None
    for i, (value, chosen) in enumerate(members.items()):
        rows = chosen.select("cell", F.lit(i).alias("_i"), F.lit(value).alias("value"))
        out = rows if out is None else out.union(rows)
    named = out.groupBy("cell").agg(F.max_by("value", "_i").alias("value"))
    return cells.select("cell").join(named, "cell").select("cell", F.lit(name).alias("grouping"), "value")


def corner(long: DataFrame, n: int = 5) -> DataFrame:
    """The first n genes of the first n cells, in their order, as far as they have rows."""
    genes, cells = (long.select(c).distinct().orderBy(c).limit(n) for c in ("gene", "cell"))
    return long.join(genes, "gene", "left_semi").join(cells, "cell", "left_semi")
