"""Neighbours, graphs of them, components of variation and clusters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.stats import gamma_fit
from trellis.operators import pivots


def knn_exact(vectors: DataFrame, k: int, scratch) -> DataFrame:
    """(cell, rank, nbr, dist): exact Euclidean neighbours from (cell, vec), ties by nbr."""
    return pivots.knn(vectors, k, scratch)[0]


def knn_outliers(knn: DataFrame, nn_1: int, nn_2: int, x_max: float, slope_r: float, int_r: float, slope_b: float, int_b: float, invert: bool = False) -> DataFrame:
    """Cells whose near and far neighbour distances break any of three lines, or the others."""
    d = knn.groupBy("cell").agg(F.max(F.when(F.col("rank") == nn_1, F.col("dist"))).alias("d1"), F.max(F.when(F.col("rank") == nn_2, F.col("dist"))).alias("d2"))
    out = (F.col("d1") > x_max) | (F.col("d2") > int_r + slope_r * F.col("d1")) | (F.col("d2") > int_b + slope_b * F.col("d1"))
    return d.where(~out if invert else out).select("cell")


def jaccard_edges(knn: DataFrame, k: int) -> DataFrame:
    """(a, b, w): undirected neighbour pairs weighted by the overlap of their neighbour sets, over the largest."""
    near = knn.where(F.col("rank") <= k)
    sets = near.groupBy("cell").agg(F.collect_set("nbr").alias("s"))  # k members
    e = near.select(F.least("cell", "nbr").alias("a"), F.greatest("cell", "nbr").alias("b")).distinct()
    e = e.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    e = e.select("a", "b", (F.size(F.array_intersect("sa", "sb")) / F.size(F.array_union("sa", "sb"))).alias("w")).where("w > 0")
    top = e.agg(F.max("w").alias("top"))
    return e.crossJoin(F.broadcast(top)).select("a", "b", (F.col("w") / F.col("top")).alias("w"))


def variable_gene_stats(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean and coefficient of variation of counts per gene over all cells, zeros included."""
    n = cells.agg(F.count("*").cast("double").alias("n"))
    s = counts.groupBy("gene").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q")).crossJoin(F.broadcast(n))
    mean, var = F.col("s") / F.col("n"), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    return s.select("gene", mean.alias("mean"), (F.sqrt(var) / mean).alias("cv"))


def variable_genes(counts: DataFrame, cells: DataFrame, cutoff: float = 0.5, mean_min: float = 0.005, mean_max: float = 100.0) -> DataFrame:
    """Genes that vary more than a negative binomial of the cells' sizes; the gamma fit needs two aggregates."""
    totals = counts.groupBy("cell").agg(F.sum("count").alias("t"))
    r = totals.crossJoin(F.broadcast(totals.agg(F.avg("t").alias("m")))).agg(F.avg(F.col("t") / F.col("m")).alias("mean"), F.avg(F.ln(F.col("t") / F.col("m"))).alias("log")).first()
    shape, rate = gamma_fit(r["mean"], r["log"])
    stats = variable_gene_stats(counts, cells)
    # negative binomial of size a and scale mean / rate: variance = mean + mean^2 / a
    null_cv = F.sqrt(F.lit(shape) * F.col("mean") / rate + F.lit(shape) * F.pow(F.col("mean") / rate, 2.0)) / (F.lit(shape) * F.col("mean") / rate)
    return stats.withColumn("diff_cv", F.ln("cv") - F.ln(null_cv)).where((F.col("diff_cv") > cutoff) & (F.col("mean") > mean_min) & (F.col("mean") < mean_max))


def marchenko_pastur(genes: int, cells: int, sdev: list[float], factor: float = 1.0) -> list[bool]:
    bound = (1 + math.sqrt(genes / cells)) ** 2
    return [s * s > bound * factor for s in sdev]


def pca(z: DataFrame, factor: float = 1.0, store: float = 2.0, keep: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(components, loadings, scores) from z-scores (cell, gene, z).

    The gene by gene products are added up per task; only that matrix, of the chosen variable
    genes, reaches the driver. Signs are fixed so each component's largest loading is positive.
    """
    genes = sorted(r.gene for r in z.select("gene").distinct().collect())
    at = {g: i for i, g in enumerate(genes)}
    rows = z.groupBy("cell").agg(F.collect_list(F.struct("gene", "z")).alias("g"))  # one cell's variable genes

    def products(batches):
        total = np.zeros((len(genes), len(genes)))
        for b in batches:
            m = np.zeros((len(b), len(genes)))
            for i, row in enumerate(b["g"]):
                for x in row:
                    m[i, at[x["gene"]]] = x["z"]
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(len(genes)), "m": list(total)})

    # a row of the matrix from each task is added up in Spark; one matrix of the chosen genes comes to the driver
    parts = rows.mapInPandas(products, "i int, m array<double>").select("i", F.posexplode("m").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram, n = np.zeros((len(genes), len(genes))), rows.count()
    for r in parts.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("m")).collect():
        gram[r["i"]] = [x["x"] for x in r["m"]]
    values, vectors = np.linalg.eigh(gram / max(n - 1, 1))
    order = np.argsort(values)[::-1]
    sdev, vectors = np.sqrt(np.maximum(values[order], 0)), vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(genes))])
    significant = marchenko_pastur(len(genes), n, sdev.tolist(), factor)
    last = max((i + 1 for i, s in enumerate(significant) if s), default=1)
    k = keep or min(math.ceil(last * store), len(genes))
    spark = z.sparkSession
    pcs = spark.createDataFrame([(i + 1, float(sdev[i]), bool(significant[i])) for i in range(k)], "pc int, sdev double, sig boolean")
    loadings = spark.createDataFrame([(g, j + 1, float(vectors[i, j])) for i, g in enumerate(genes) for j in range(k)], "gene string, pc int, v double")
    scores = z.join(loadings, "gene").groupBy("cell", "pc").agg(F.sum(F.col("z") * F.col("v")).alias("score"))
    return pcs, loadings, scores


def top_loadings(loadings: DataFrame, n: int = 20) -> DataFrame:
    w = W.partitionBy("pc").orderBy(F.desc(F.abs("v")), "gene")
    return loadings.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def diffusion_edges(knn: DataFrame, sigma: float | None = None, density: bool = True) -> DataFrame:
    """(i, j, w): Gaussian kernel on neighbours, made symmetric, divided by densities and degrees."""
    if sigma is None:
        local = knn.where(F.col("rank").between(5, 7)).groupBy("cell").agg(F.avg("dist").alias("s"))
        e = knn.join(local, "cell").join(local.toDF("nbr", "s2"), "nbr")
        w = F.exp(-F.pow("dist", 2.0) / (2 * F.col("s") * F.col("s2")))
    else:
        e, w = knn, F.exp(-F.pow("dist", 2.0) / (2 * sigma * sigma))
    one = e.select(F.col("cell").alias("i"), F.col("nbr").alias("j"), w.alias("w"))
    sym = one.union(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))
    for _ in range(1 + density):  # densities, then degrees
        d = sym.groupBy("i").agg(F.sum("w").alias("d"))
        last = _ == density
        sym = sym.join(d, "i").join(d.toDF("j", "dj"), "j").select("i", "j", (F.col("w") / (F.sqrt(F.col("d") * F.col("dj")) if last else F.col("d") * F.col("dj"))).alias("w"))
    return sym


def neighbors_for(cells: int, least: int = 100, small: int = 1000, big: int = 10000) -> int:
    """How many neighbours a diffusion map takes: all, of few cells; a hundredth, but ``least`` at least, of many; in
    between what lies between on a scale of logarithms."""
    few, many = max(small - 1, 1), max(least, big // 100)
    if cells <= small:
        return max(cells - 1, 1)
    if cells >= big:
        return max(least, cells // 100)
    share = math.log(cells / small) / math.log(big / small)
    return round(math.exp(math.log(few) * (1 - share) + math.log(many) * share))


def kernel_sweep(knn: DataFrame, steps: int = 25) -> DataFrame:
    """(step, sigma, mean_log, slope, chosen): the mean logarithm of a cell's kernel sum, itself included, over widths
    in equal ratios from the least distance above zero to the largest; the slope to the next width, and
    whether that is the steepest, where the kernel feels the most dimensions. One pass for all widths."""
    r = knn.agg(F.min(F.when(F.col("dist") > 0, F.col("dist"))).alias("lo"), F.max("dist").alias("hi")).first()
    if r["lo"] is None:
        return knn.sparkSession.createDataFrame([], "step int, sigma double, mean_log double, slope double, chosen boolean")
    lo, hi = math.log10(r["lo"]), math.log10(r["hi"])
    widths = [10 ** (lo + (hi - lo) * s / (steps - 1)) for s in range(steps)]
    sums = knn.groupBy("cell").agg(*[(1 + F.sum(F.exp(-F.pow("dist", 2.0) / (2 * w * w)))).alias(f"s{i}") for i, w in enumerate(widths)])
    row = sums.agg(*[F.avg(F.log10(f"s{i}")).alias(f"m{i}") for i in range(steps)]).first()
    gap = (hi - lo) / (steps - 1) or 1.0
    slopes = [(row[i + 1] - row[i]) / gap for i in range(steps - 1)]
    best = max(range(steps - 1), key=lambda i: (slopes[i], -i))
    rows = [(i, widths[i], row[i], slopes[i] if i < steps - 1 else None, i == best) for i in range(steps)]
    return knn.sparkSession.createDataFrame(rows, "step int, sigma double, mean_log double, slope double, chosen boolean")


def optimal_sigma(knn: DataFrame, steps: int = 25) -> float | None:
    """The width in the middle, by ratio, of the steepest interval of the sweep."""
    rows = kernel_sweep(knn, steps).orderBy("step").collect()
    at = next((i for i, r in enumerate(rows) if r["chosen"]), None)
    return None if at is None else math.sqrt(rows[at]["sigma"] * rows[at + 1]["sigma"])


def undirected_edges(edges: DataFrame, cells: DataFrame | None = None, connected: bool = False) -> DataFrame:
    """(a, b, w): each pair of (i, j, w) once, by the larger weight; between chosen cells, or touching one of them."""
    e = edges.where("i <> j").groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("w").alias("w"))
    if cells is None:
        return e
    side = lambda c: cells.select(F.col("cell").alias(c)).distinct()
    if not connected:
        return e.join(side("a"), "a", "left_semi").join(side("b"), "b", "left_semi").select("a", "b", "w")
    flag = lambda c: side(c).withColumn(f"has_{c}", F.lit(True))
    return e.join(flag("a"), "a", "left").join(flag("b"), "b", "left").where("has_a or has_b").select("a", "b", "w")


def diffusion_components(edges: DataFrame, n: int, scratch, rounds: int = 16, spare: int = 4, seed: int = 1) -> tuple[list[float], DataFrame]:
    """(eigenvalues, (cell, k, v)) of the largest components of a symmetric (i, j, w), by subspace iteration.

    The vectors stay a table of ``n + spare`` numbers a cell; each round joins them to the edges, adds
    up by cell and makes them orthonormal with a matrix of that few rows, the only thing that
    reaches the driver. Signs are fixed so that the largest entry is positive; the first component
    is the trivial one.
    """
    m = n + spare
    kind = edges.schema["i"].dataType.simpleString()
    normal = [F.sqrt(-2 * F.ln((F.pmod(F.xxhash64("cell", F.lit(seed), F.lit(2 * p)), F.lit(1 << 40)) + 0.5) / float(1 << 40))) * F.cos(2 * math.pi * F.pmod(F.xxhash64("cell", F.lit(seed), F.lit(2 * p + 1)), F.lit(1 << 40)) / float(1 << 40)) for p in range(m)]
    v = scratch.table(edges.select(F.col("i").alias("cell")).distinct().select("cell", F.array(*normal).alias("v")), "vectors0")

    def products(a: str, b: str, df: DataFrame) -> np.ndarray:
        def run(batches):
            total = np.zeros((m, m))
            for x in batches:
                if len(x):
                    total += np.stack(x["a"].to_numpy()).T @ np.stack(x["b"].to_numpy())
            yield pd.DataFrame({"p": np.arange(m * m), "x": total.ravel()})

        sums = df.select(F.col(a).alias("a"), F.col(b).alias("b")).mapInPandas(run, "p int, x double").groupBy("p").agg(F.sum("x").alias("x"))
        out = np.zeros(m * m)
        for r in sums.collect():
            out[r["p"]] = r["x"]
        return out.reshape(m, m)

    def times(df: DataFrame, matrix: np.ndarray) -> DataFrame:
        def run(batches):
            for x in batches:
                rows = np.stack(x["v"].to_numpy()) @ matrix if len(x) else np.zeros((0, matrix.shape[1]))
                yield pd.DataFrame({"cell": x["cell"], "v": list(rows)})

        return df.select("cell", "v").mapInPandas(run, f"cell {kind}, v array<double>")

    def applied(df: DataFrame) -> DataFrame:
        met = edges.join(df.withColumnRenamed("cell", "j"), "j")
        return met.groupBy(F.col("i").alias("cell")).agg(F.array(*[F.sum(F.col("w") * F.get("v", p)) for p in range(m)]).alias("v"))

    for r in range(1, rounds + 1):
        y = scratch.table(applied(v), f"applied{r}")
        gram = products("v", "v", y)
        values, vectors = np.linalg.eigh(gram)
        v = scratch.table(times(y, vectors / np.sqrt(np.maximum(values, 1e-300))), f"vectors{r}")
        scratch.drop(f"applied{r}")
        scratch.drop(f"vectors{r - 1}")
    both = scratch.table(v.join(applied(v).withColumnRenamed("v", "y"), "cell"), "both")
    small = products("v", "y", both)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(values)[::-1][:n]
    out = times(v, vectors[:, order]).select(F.col("cell").cast(kind), F.posexplode("v").alias("k", "v")).withColumn("k", F.col("k") + 1)
    sign = out.groupBy("k").agg(F.signum(F.max_by("v", F.struct(F.abs("v"), "cell"))).alias("s"))
    return values[order].tolist(), out.join(F.broadcast(sign), "k").select("cell", "k", (F.col("v") * F.col("s")).alias("v"))
