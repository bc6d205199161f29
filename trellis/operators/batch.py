"""Removal of batch effects by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.expression import dense


def _settled(rounds: int) -> Column:
    """Posterior (shift, scale) of one gene in one batch, each from the other in turn."""
    n, gamma, q, t2 = F.col("n"), F.col("gamma"), F.col("q"), F.col("t2")

    def step(at: Column, _: Column) -> Column:
        shift = (t2 * n * gamma + at["scale"] * F.col("gamma_mean")) / (t2 * n + at["scale"])
        squares = q - 2 * shift * n * gamma + n * shift * shift
        return F.struct(shift.alias("shift"), ((squares / 2 + F.col("b")) / (n / 2 + F.col("a") - 1)).alias("scale"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(gamma.alias("shift"), F.col("delta").alias("scale")), step)


def combat(expr: DataFrame, batches: DataFrame, thresh: float = 0.05, low: float = 0.0, high: float | None = None, rounds: int = 30, reference=None) -> DataFrame:
    """(cell, gene, value) with the shift and scale of each batch taken out, rounded to four digits.

    ``batches``: (cell, batch); batches have two cells or more. Priors are normal for shifts and inverse
    gamma for scales, by the moments over all genes of a batch. Values under ``thresh`` become ``low``
    and have no row where that is zero; those over ``high`` (the largest value, rounded up, plus one)
    become that. Genes without spread within batches are dropped. With a ``reference`` batch all others are moved to
    its means and spreads and its own values stay; genes need spread there. What decides is one row a gene and
    batch, from moments of the rows that exist; only the last join has a row for each gene and cell.
    """
    if high is None:
        high = float(expr.agg(F.coalesce(F.ceil(F.max("value")), F.lit(0)) + 1).first()[0])
    sizes = batches.groupBy("batch").agg(F.count("*").cast("double").alias("n"))
    total = F.broadcast(sizes.agg(F.sum("n").alias("all")))
    sums = expr.join(batches, "cell").groupBy("gene", "batch").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    every = sums.select("gene").distinct().crossJoin(F.broadcast(sizes)).join(sums, ["gene", "batch"], "left").na.fill(0.0, ["s", "ss"])
    every = every.withColumns({"mean": F.col("s") / F.col("n"), "within": F.col("ss") - F.col("s") * F.col("s") / F.col("n")})
    if reference is None:
        gene = every.groupBy("gene").agg(F.sum("s").alias("s"), F.sum("within").alias("w")).crossJoin(total)
        gene = gene.select("gene", (F.col("s") / F.col("all")).alias("grand"), (F.col("w") / F.col("all")).alias("pooled"))
    else:
        gene = every.where(F.col("batch") == F.lit(reference)).select("gene", F.col("mean").alias("grand"), (F.col("within") / F.col("n")).alias("pooled"))
    gene = gene.where("pooled > 1e-12")
    off = F.col("mean") - F.col("grand")
    found = every.join(gene, "gene").select("gene", "batch", "n", "grand", F.sqrt("pooled").alias("sd"), (off / F.sqrt("pooled")).alias("gamma"), (F.col("within") / (F.col("n") - 1) / F.col("pooled")).alias("delta"), ((F.col("within") + F.col("n") * off * off) / F.col("pooled")).alias("q"))
    m, v = F.avg("delta"), F.var_samp("delta")
    priors = found.groupBy("batch").agg(F.avg("gamma").alias("gamma_mean"), F.var_samp("gamma").alias("t2"), ((2 * v + m * m) / v).alias("a"), ((m * v + m * m * m) / v).alias("b"))
    settled = found.join(F.broadcast(priors), "batch").select("gene", "batch", "grand", "sd", _settled(rounds).alias("at"))
    if reference is not None:
        stays = F.struct(F.lit(0.0).alias("shift"), F.lit(1.0).alias("scale"))
        settled = settled.withColumn("at", F.when(F.col("batch") == F.lit(reference), stays).otherwise(F.col("at")))
    y = (F.col("value") - F.col("grand") - F.col("at.shift") * F.col("sd")) / F.sqrt("at.scale") + F.col("grand")
    out = dense(expr, batches, gene.select("gene")).join(batches, "cell").join(settled, ["gene", "batch"]).select("cell", "gene", y.alias("y"))
    out = out.select("cell", "gene", F.when(F.col("y") < thresh, F.lit(low)).otherwise(F.round(F.least("y", F.lit(high)), 4)).alias("value"))
    return out.where("value <> 0")
