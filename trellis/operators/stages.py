"""Modules of genes connected across stages of development, and programmes along what they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scaled(rows: DataFrame, value: str) -> DataFrame:
    """``value`` over the largest of its module of its stage."""
    top = rows.groupBy("stage", "module").agg(F.max(value).alias("_top"))
    return rows.join(top, ["stage", "module"]).where("_top > 0").withColumn(value, F.col(value) / F.col("_top")).drop("_top")


def overlaps(weights: DataFrame, gap: int = 1, top: int = 25) -> DataFrame:
    """(from_stage, to_stage, a, b, score) of modules ``gap`` stages apart: the share of the weights of both modules'
    leading genes that lies in genes which lead both.

    ``weights``: (stage, module, gene, w) with whole numbers as stages. Only genes count that both stages have;
    each module's weights of these are over its largest, and its ``top`` largest lead it, ties to the first
    name. Pairs without a shared leading gene are absent.
    """
    w = weights.where("w > 0")
    have = weights.select("stage", "gene").distinct()

    def leading(name: str, other: int) -> DataFrame:
        both = scaled(w.join(have.select((F.col("stage") - other).alias("stage"), "gene"), ["stage", "gene"], "left_semi"), "w")
        rank = F.row_number().over(W.partitionBy("stage", "module").orderBy(F.desc("w"), "gene"))
        first = both.withColumn("_r", rank).where(F.col("_r") <= top)
        total = first.groupBy("stage", "module").agg(F.sum("w").alias("t"))
        stage = F.col("stage") if other > 0 else F.col("stage") + other
        return first.join(total, ["stage", "module"]).select(stage.alias("from_stage"), F.col("module").alias(name), "gene", F.col("w").alias(f"w_{name}"), F.col("t").alias(f"t_{name}"))

    met = leading("a", gap).join(leading("b", -gap), ["from_stage", "gene"])
    out = met.groupBy("from_stage", "a", "b").agg(((F.sum("w_a") + F.sum("w_b")) / (F.first("t_a") + F.first("t_b"))).alias("score"))
    return out.select("from_stage", (F.col("from_stage") + gap).alias("to_stage"), "a", "b", "score")


def well_connected(one_back: DataFrame, least: float = 0.2) -> DataFrame:
    """(stage, module) of those that overlap by more than ``least`` with some module of a stage beside theirs."""
    good = one_back.where(F.col("score") > least)
    return good.select(F.col("from_stage").alias("stage"), F.col("a").alias("module")).union(good.select("to_stage", "b")).distinct()


def connections(one_back: DataFrame, two_back: DataFrame, least: float = 0.2, weak: float = 0.3, strong: float = 0.5) -> DataFrame:
    """(from_stage, a, to_stage, b, score): the predecessor of each module that has one.

    That is its best overlap one stage back, of modules that are connected well; two stages back if there is
    none above ``least``, or if it is below ``weak`` and the best two stages back above ``strong``. Ties go to the
    first name.
    """
    keep = well_connected(one_back, least)
    side = lambda s, m: keep.select(F.col("stage").alias(s), F.col("module").alias(m))
    best = lambda d, n: d.where(F.col("score") > least).groupBy("to_stage", "b").agg(F.min_by(F.struct("a", "score"), F.struct(-F.col("score"), "a")).alias(n))
    near = best(one_back.join(side("from_stage", "a"), ["from_stage", "a"], "left_semi").join(side("to_stage", "b"), ["to_stage", "b"], "left_semi"), "one")
    both = near.join(best(two_back, "two"), ["to_stage", "b"], "full")
    far = F.col("one").isNull() | ((F.col("one.score") < weak) & (F.col("two.score") > strong))
    far = F.coalesce(far, F.lit(False))
    back = F.when(far, 2).otherwise(1)
    chosen = F.when(far, F.col("two")).otherwise(F.col("one"))
    return both.select((F.col("to_stage") - back).alias("from_stage"), chosen["a"].alias("a"), "to_stage", "b", chosen["score"].alias("score"))


def chains(links: DataFrame, scratch, least: float = 0.45) -> DataFrame:
    """(end_stage, end, stage, module, mean_score): all modules upstream of each that nothing follows, itself included,
    where the links between them score at least ``least`` on average.

    A module has one predecessor, so chains are as long as there are stages; each round doubles what is known.
    """
    node = lambda s, m: F.struct(F.col(s).alias("stage"), F.col(m).alias("module"))
    e = scratch.table(links.select(node("to_stage", "b").alias("n"), node("from_stage", "a").alias("up"), "score"), "links")
    ends = e.select("n").join(e.select(F.col("up").alias("n")), "n", "left_anti")
    known = scratch.table(e.select("n", "up", F.lit(1).alias("steps"), "score"), "known0")
    k = 0
    while True:
        step = known.groupBy("n").agg(F.max("steps").alias("steps"))
        last = known.join(step, ["n", "steps"]).select("n", F.col("up").alias("mid"), "steps", F.col("score").alias("s0"))
        more = last.join(known.select(F.col("n").alias("mid"), F.col("up").alias("up"), F.col("steps").alias("more"), F.col("score").alias("s1")), "mid").select("n", "up", (F.col("steps") + F.col("more")).alias("steps"), (F.col("s0") + F.col("s1")).alias("score"))
        if more.isEmpty():
            break
        k += 1
        known = scratch.table(known.union(more), f"known{k}")
        scratch.drop(f"known{k - 1}")
    above = known.join(ends, "n", "left_semi")
    whole = above.groupBy("n").agg(F.max_by(F.col("score") / F.col("steps"), "steps").alias("mean_score")).where(F.col("mean_score") >= least)
    members = above.select("n", F.col("up").alias("m")).union(ends.select("n", F.col("n").alias("m"))).join(whole, "n")
    return members.select(F.col("n.stage").alias("end_stage"), F.col("n.module").alias("end"), F.col("m.stage").alias("stage"), F.col("m.module").alias("module"), "mean_score")


def programmes(chained: DataFrame, levels: DataFrame) -> DataFrame:
    """(end_stage, end, cell, level): the levels of a chain's modules, each over its largest, added up by cell.
    ``levels``: (stage, module, cell, v)."""
    met = chained.join(scaled(levels.where("v > 0"), "v"), ["stage", "module"])
    return met.groupBy("end_stage", "end", "cell").agg(F.sum("v").alias("level"))
