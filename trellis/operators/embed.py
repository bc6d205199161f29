"""Two-dimensional neighbour embedding: affinities of a given perplexity, pulls over edges, pushes from a grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import field

#: Halvings of the range of the logarithm of a kernel's precision, and that range.
HALVINGS, PRECISION = 60, (-40.0, 40.0)


def precisions(knn: DataFrame, perplexity: float) -> DataFrame:
    """(cell, beta): the precision at which a cell's kernel over its neighbours has the perplexity, by halving; the
    kernel is exp(-beta d^2). All cells of a batch are halved at once."""
    kind = knn.schema["cell"].dataType.simpleString()
    rows = knn.groupBy("cell").agg(F.sort_array(F.collect_list(F.col("dist") * F.col("dist"))).alias("d2"))

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            n = b["d2"].str.len().to_numpy()
            d2 = np.full((len(b), n.max()), np.inf)
            for i, x in enumerate(b["d2"]):
                d2[i, : len(x)] = np.asarray(x) - x[0]
            lo, hi = (np.full(len(b), v) for v in PRECISION)
            for _ in range(HALVINGS):
                mid = (lo + hi) / 2
                beta = np.exp(mid)[:, None]
                with np.errstate(invalid="ignore"):
                    p = np.exp(-beta * d2)
                    entropy = np.log(p.sum(1)) + (np.where(np.isfinite(d2), beta * d2 * p, 0)).sum(1) / p.sum(1)
                wide = entropy > math.log(perplexity)
                lo, hi = np.where(wide, mid, lo), np.where(wide, hi, mid)
            yield pd.DataFrame({"cell": b["cell"], "beta": np.exp((lo + hi) / 2)})

    return rows.mapInPandas(run, f"cell {kind}, beta double")


def affinities(knn: DataFrame, perplexity: float) -> DataFrame:
    """(i, j, p) in both directions, adding up to one: the mean of both cells' kernel shares, over the cells."""
    near = knn.join(precisions(knn, perplexity), "cell").withColumn("d2", F.col("dist") * F.col("dist"))
    least = near.groupBy("cell").agg(F.min("d2").alias("least"))
    one = near.join(least, "cell").select("cell", "nbr", F.exp(-F.col("beta") * (F.col("d2") - F.col("least"))).alias("k"))
    share = one.join(one.groupBy("cell").agg(F.sum("k").alias("s")), "cell").select(F.col("cell").alias("i"), F.col("nbr").alias("j"), (F.col("k") / F.col("s")).alias("p"))
    n = knn.agg(F.count_distinct("cell").alias("n"))
    both = share.union(share.select(F.col("j").alias("i"), F.col("i").alias("j"), "p")).groupBy("i", "j").agg(F.sum("p").alias("p"))
    return both.crossJoin(F.broadcast(n)).select("i", "j", (F.col("p") / (2 * F.col("n"))).alias("p"))


def _pushes(places: DataFrame, grid_size: int) -> tuple[DataFrame, float]:
    """((cell, x, y, rx, ry), z): what all cells push, not yet over z, the sum of 1 / (1 + d^2) over all pairs."""
    box = field.Box.around(places, grid_size)
    mass = field.masses(places, box)
    near = lambda x, y: 1 / (1 + x * x + y * y)
    fields = {"q": box.convolve(mass, near), "rx": box.convolve(mass, lambda x, y: x * near(x, y) ** 2), "ry": box.convolve(mass, lambda x, y: y * near(x, y) ** 2)}
    read = field.read(places, box, fields)
    n, z = read.agg(F.count("*"), F.sum("q")).first()
    return read, max(float(z or 0.0) - n, 1e-12)  # a cell is no neighbour of itself


def _edges(p: DataFrame, places: DataFrame) -> DataFrame:
    e = p.join(places.select(F.col("cell").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi")), "i").join(places.select(F.col("cell").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj")), "j")
    dx, dy = F.col("xi") - F.col("xj"), F.col("yi") - F.col("yj")
    return e.select("i", "p", dx.alias("dx"), dy.alias("dy"), (1 / (1 + dx * dx + dy * dy)).alias("q"))


def divergence(p: DataFrame, places: DataFrame, grid_size: int = 128) -> float:
    """Kullback-Leibler divergence of the places' shares from the affinities."""
    _, z = _pushes(places, grid_size)
    return float(_edges(p, places).where("p > 0").agg(F.sum(F.col("p") * F.ln(F.col("p") * z / F.col("q")))).first()[0] or 0.0)


def tsne(p: DataFrame, scratch, rounds: int = 250, exaggeration: float = 12.0, rate: float | None = None, grid_size: int = 128, seed: int = 1) -> DataFrame:
    """(cell, x, y) by gradient descent with momentum on (i, j, p) in both directions.

    Starts are normal, by a hash of the cell. For the first quarter of the rounds affinities are
    exaggerated. A step moves no cell by more than five units. Each round is written before the next.
    """
    p = scratch.table(p, "affinities")
    u = lambda k: (F.pmod(F.xxhash64("cell", F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    r = F.sqrt(-2 * F.ln(u(0)))
    now = scratch.table(p.select(F.col("i").alias("cell")).distinct().select("cell", (r * F.cos(2 * math.pi * u(1))).alias("x"), (r * F.sin(2 * math.pi * u(1))).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy")), "tsne0")
    rate = rate or now.count() / (2 * exaggeration)  # so that exaggerated pulls contract without overshooting
    for k in range(1, rounds + 1):
        early = k <= rounds / 4
        pushed, z = _pushes(now, grid_size)
        e = _edges(p, now)
        pull = e.groupBy(F.col("i").alias("cell")).agg(F.sum(F.col("p") * F.col("q") * F.col("dx")).alias("ax"), F.sum(F.col("p") * F.col("q") * F.col("dy")).alias("ay"))
        all_ = pushed.join(pull, "cell", "left").join(now.select("cell", "vx", "vy"), "cell")
        step = lambda a, r, v: F.greatest(F.least((0.5 if early else 0.8) * F.col(v) - rate * 4 * ((exaggeration if early else 1.0) * F.coalesce(a, F.lit(0.0)) - F.col(r) / z), F.lit(5.0)), F.lit(-5.0))
        moved = all_.select("cell", "x", "y", step("ax", "rx", "vx").alias("vx"), step("ay", "ry", "vy").alias("vy"))
        now = scratch.table(moved.select("cell", (F.col("x") + F.col("vx")).alias("x"), (F.col("y") + F.col("vy")).alias("y"), "vx", "vy"), f"tsne{k}")
        scratch.drop(f"tsne{k - 1}")
    return now.select("cell", "x", "y")
