"""Batches brought together by mutual nearest neighbours, and mixtures of two normal distributions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators import pivots

#: Cells of which a task adds up all genes at once, and the bytes of their sums.
SUM_CELLS, SUM_BYTES = 16_384, 32 << 20


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(cell, vec) at length one; vectors that are null or zero are left out."""
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("_l", size).where("_l > 0").select("cell", F.transform("vec", lambda x: x / F.col("_l")).alias("vec"))


def mutual_pairs(one: DataFrame, other: DataFrame, k: int, scratch) -> DataFrame:
    """(a, b): cells of two batches, as (cell, vec), each of which is among the ``k`` nearest of its batch to the other."""
    side = lambda v: v.select(F.col("cell").alias("id"), "vec")
    to_b = pivots.Index(side(other), scratch, "batch_b").nearest(side(one), k)
    to_a = pivots.Index(side(one), scratch, "batch_a").nearest(side(other), k)
    return to_b.select(F.col("id").alias("a"), F.col("nbr").alias("b")).join(to_a.select(F.col("nbr").alias("a"), F.col("id").alias("b")), ["a", "b"])


def weighted_sums(weights: DataFrame, moves: DataFrame) -> DataFrame:
    """(cell, gene, s): the sum of w * move over (cell, b, w) and (b, gene, move), where either has b.

    A task adds up the cells of one block, a table of fixed size; what its cells need passes by it once, in the order
    of b, so no row is made for each cell, b and gene."""
    kinds = {c: weights.schema[c].dataType.simpleString() for c in ("cell", "b")} | {"gene": moves.schema["gene"].dataType.simpleString()}
    cells, genes = weights.select("cell").distinct().count(), moves.select("gene").distinct().count()
    size = max(1, min(SUM_CELLS, SUM_BYTES // (8 * max(genes, 1))))
    blocks = max(math.ceil(cells / size), min(weights.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / 1000)), 1)
    of = weights.select(F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int").alias("block"), "b", "cell", F.col("w").cast("double").alias("w"))
    packed = moves.groupBy("b").agg(F.collect_list(F.struct("gene", F.col("move").cast("double").alias("move"))).alias("m"))  # one cell's genes
    packed = packed.select("b", F.col("m.gene").alias("genes"), F.col("m.move").alias("moves"))
    asked = packed.join(of.select("block", "b").distinct(), "b")
    rows = of.join(moves.select("b").distinct(), "b", "left_semi").unionByName(asked, allowMissingColumns=True).select("block", "b", "cell", "w", "genes", "moves")
    rows = rows.repartition(blocks, "block").sortWithinPartitions("block", "b", F.col("cell").isNull())

    def run(batches):
        block = None
        at: tuple[dict, dict] = ({}, {})  # places of cells and genes in the sums
        sums = met = np.zeros((0, 0))
        own: list[tuple] = []  # places and weights of the cells that what passes next is for

        def places(column: pa.Array, axis: int) -> np.ndarray:
            coded = column.dictionary_encode()
            where = np.array([at[axis].setdefault(v, len(at[axis])) for v in coded.dictionary.to_pylist()], np.int64)
            return where[coded.indices.to_numpy(zero_copy_only=False)]

        def result():
            i, j = np.nonzero(met[: len(at[0]), : len(at[1])])
            names = [pa.array(list(at[0]), types[0]), pa.array(list(at[1]), types[1])]
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                yield pa.RecordBatch.from_arrays([names[0].take(pa.array(a)), names[1].take(pa.array(b)), pa.array(sums[a, b])], names=["cell", "gene", "s"])

        for whole in batches:
            if not whole.num_rows:
                continue
            types = (whole["cell"].type, whole["genes"].type.value_type)
            of = whole["block"].to_numpy()
            ends = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for s, e in zip(ends[:-1], ends[1:], strict=True):
                b = whole.slice(s, e - s)
                if of[s] != block:
                    if at[0]:
                        yield from result()
                    block, at, own = of[s], ({}, {}), []
                    sums, met = np.zeros((size, genes)), np.zeros((size, genes), bool)
                passes = b["cell"].is_null().to_numpy(zero_copy_only=False)
                cells_, w = places(b["cell"].drop_null(), 0), b["w"].drop_null().to_numpy(zero_copy_only=False)
                while len(at[0]) > len(sums):  # a hash need not deal evenly
                    sums, met = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([met, np.zeros_like(met)])
                genes_, x = places(b["genes"].flatten(), 1), b["moves"].flatten().to_numpy(zero_copy_only=False)
                width = np.concatenate([[0], np.cumsum(b["genes"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                before, last = np.cumsum(~passes), 0
                for row in np.flatnonzero(passes):
                    own.append((cells_[last : before[row]], w[last : before[row]]))
                    last, own_now = before[row], [np.concatenate(c) for c in zip(*own, strict=True)]
                    own = []
                    g = slice(width[row], width[row + 1])
                    where = np.ix_(own_now[0], genes_[g])
                    np.add.at(sums, where, own_now[1][:, None] * x[None, g])
                    met[where] = True
                own.append((cells_[last:], w[last:]))
        if at[0]:
            yield from result()

    return rows.mapInArrow(run, f"cell {kinds['cell']}, gene {kinds['gene']}, s double")


def mutual_correction(expr: DataFrame, one: DataFrame, other: DataFrame, scratch, k: int = 20, sigma: float = 1.0, smooth: int = 50, least: float = 0.05) -> DataFrame:
    """(cell, gene, value): the cells of ``other`` moved to those of ``one``; values below ``least`` become absent zeros.

    ``one`` and ``other``: (cell, vec) over the genes that neighbours are taken from, compared by direction;
    all genes of ``expr`` are corrected. A cell moves by the mean difference of the pairs of the ``smooth``
    nearest paired cells of its batch, weighted by a normal kernel of width ``sigma`` over their distance.
    """
    a, b = (scratch.table(unit_vectors(v), n) for v, n in ((one, "one"), (other, "other")))
    pairs = scratch.table(mutual_pairs(a, b, k, scratch), "pairs")
    count = pairs.groupBy("b").agg(F.count("*").alias("n"))
    to = pairs.join(expr.withColumnRenamed("cell", "a"), "a").groupBy("b", "gene").agg(F.sum("value").alias("s"))
    own = count.join(expr.withColumnRenamed("cell", "b"), "b").select("b", "gene", "n", F.col("value").alias("v"))
    moves = to.join(count, "b").join(own.select("b", "gene", "v"), ["b", "gene"], "full").select("b", "gene", (F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)) - F.coalesce("v", F.lit(0.0))).alias("move"))
    side = lambda v: v.select(F.col("cell").alias("id"), "vec")
    paired = b.join(count.select(F.col("b").alias("cell")), "cell", "left_semi")
    near = pivots.Index(side(paired), scratch, "paired").nearest(side(b), smooth)
    # the nearest one weighs one, so that far cells are moved, too
    near = near.join(near.groupBy("id").agg(F.min("dist").alias("least")), "id")
    weight = F.exp(-(F.col("dist") * F.col("dist") - F.col("least") * F.col("least")) / (sigma * sigma))
    weights = near.select(F.col("id").alias("cell"), F.col("nbr").alias("b"), weight.alias("w"))
    weights = scratch.table(weights, "weights")
    total = weights.groupBy("cell").agg(F.sum("w").alias("total"))
    shift = weighted_sums(weights, scratch.table(moves, "moves")).join(total, "cell").select("cell", "gene", (F.col("s") / F.col("total")).alias("shift"))
    moved = expr.join(other.select("cell"), "cell", "left_semi").join(shift, ["cell", "gene"], "full").select("cell", "gene", (F.coalesce("value", F.lit(0.0)) + F.coalesce("shift", F.lit(0.0))).alias("value"))
    return expr.join(one.select("cell"), "cell", "left_semi").select("cell", "gene", "value").union(moved).where(F.col("value") >= least)


def _density(x, mean: str, sd: str):
    return F.exp(-F.pow((x - F.col(mean)) / F.col(sd), 2.0) / 2) / (F.col(sd) * math.sqrt(2 * math.pi))


def mixture_rounds(values: DataFrame, scratch, low: float, high: float, weight_low: float = 0.95, rounds: int = 200, tolerance: float = 1e-5) -> DataFrame:
    """(key, round, likelihood, weight_low, mean_low, mean_high, sd_low, sd_high) of the last round of each key: a
    mixture of two normal distributions of (key, x), fitted to all keys at once.

    Means start at those of the values below ``low`` and above ``high``, deviations at that of all values.
    A key is done when its likelihood grows by less than ``tolerance``, which it never falls by. Keys without values on either
    side, or without a deviation, are left out.
    """
    values = scratch.table(values.where("x is not null").select("key", F.col("x").cast("double").alias("x")), "values")
    start = values.groupBy("key").agg(F.avg(F.when(F.col("x") < low, F.col("x"))).alias("mean_low"), F.avg(F.when(F.col("x") > high, F.col("x"))).alias("mean_high"), F.stddev_pop("x").alias("sd_low"))
    now = start.where("mean_low is not null and mean_high is not null and sd_low > 0").select("key", F.lit(0).alias("round"), F.lit(None).cast("double").alias("likelihood"), F.lit(weight_low).alias("weight_low"), "mean_low", "mean_high", "sd_low", F.col("sd_low").alias("sd_high"), F.lit(False).alias("done"))
    now = scratch.table(now, "round0")
    for k in range(1, rounds + 1):
        met = values.join(now.where("not done"), "key")
        a, b = F.col("weight_low") * _density(F.col("x"), "mean_low", "sd_low"), (1 - F.col("weight_low")) * _density(F.col("x"), "mean_high", "sd_high")
        met = met.withColumns({"a": a, "b": b}).withColumn("r", F.try_divide("a", F.col("a") + F.col("b")))
        q = 1 - F.col("r")
        x = F.col("x")
        s = met.groupBy("key").agg(F.sum(F.ln(F.col("a") + F.col("b"))).alias("l"), F.count("*").alias("n"), F.sum("r").alias("r0"), F.sum(F.col("r") * x).alias("r1"), F.sum(F.col("r") * x * x).alias("r2"), F.sum(q).alias("q0"), F.sum(q * x).alias("q1"), F.sum(q * x * x).alias("q2"))
        sd = lambda c: F.sqrt(F.greatest(F.col(f"{c}2") / F.col(f"{c}0") - F.pow(F.col(f"{c}1") / F.col(f"{c}0"), 2.0), F.lit(1e-12)))
        new = s.select("key", F.lit(k).alias("round"), F.col("l").alias("likelihood"), (F.col("r0") / F.col("n")).alias("weight_low"), (F.col("r1") / F.col("r0")).alias("mean_low"), (F.col("q1") / F.col("q0")).alias("mean_high"), sd("r").alias("sd_low"), sd("q").alias("sd_high"))
        before = now.select("key", F.col("likelihood").alias("was"))
        new = new.join(before, "key").withColumn("done", F.coalesce(F.col("likelihood") - F.col("was") < tolerance, F.lit(False))).drop("was")
        now = scratch.table(now.where("done").unionByName(new), f"round{k}")
        scratch.drop(f"round{k - 1}")
        if now.where("not done").isEmpty():
            break
    return now.drop("done")


def members_of_high(values: DataFrame, fit: DataFrame) -> DataFrame:
    """The rows of (key, x, ...) at or above the least value that is at least as likely high as low."""
    met = values.join(fit, "key")
    a, b = F.col("weight_low") * _density(F.col("x"), "mean_low", "sd_low"), (1 - F.col("weight_low")) * _density(F.col("x"), "mean_high", "sd_high")
    upper = F.when(F.col("mean_high") >= F.col("mean_low"), b >= a).otherwise(a >= b)
    cut = met.where(upper).groupBy("key").agg(F.min("x").alias("cut"))
    return values.join(cut, "key").where(F.col("x") >= F.col("cut")).drop("cut")
