"""Distributed union-find: connected components by alternating large-star and small-star steps.

Links stay in DataFrames all the time. Every round writes its edges to the shared folder, so no
lineage grows and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(a, b) links, in any direction, to (node, component): the smallest node reachable.

    Nodes without a link to another node are absent from the result. Nulls and self links are
    ignored. Ids can be of any orderable type.
    """
    e = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("v < u").distinct()
    e = scratch.table(e, f"{name}-0")
    mark = None
    for i in range(1, max_rounds + 1):
        # large star: every neighbour above u moves to the smallest of u's neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("v < u").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("v < u").distinct()
        e = scratch.table(small, f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            roots = e.groupBy("u").agg(F.min("v").alias("component"))
            return roots.select(F.col("u").alias("node"), "component").union(roots.select(F.col("component").alias("node"), "component").distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
