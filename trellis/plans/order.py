"""Global order without one task: ranks, running values and shifts over range partitions.

Rows are dealt by ranges of the order and written once; a row's place in its range and the sizes
of the ranges before it give its rank. What goes from one range to the next is one number a range,
so no window stands without a partition key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Of spark.sql's monotonically increasing ids: the partition stands above these bits.
PLACE_BITS = 33


def _carried(df: DataFrame, per_part: DataFrame, start, add: Callable, reverse: bool = False) -> DataFrame:
    """(part, before): what the ranges before each one come to; one row a range, whose number the session sets."""
    rows = sorted(per_part.collect(), key=lambda r: r["part"], reverse=reverse)
    out, now = [], start
    for r in rows:
        out.append((r["part"], now))
        now = add(now, r["x"])
    kind = per_part.schema["x"].dataType.simpleString()
    return F.broadcast(df.sparkSession.createDataFrame(out, f"part long, before {kind}"))


def ranked(df: DataFrame, order: list, scratch, name: str = "ranges", rank: str = "rank") -> DataFrame:
    """``df`` with its ``rank`` from 1 in the total order of ``order``, and ``part``, the range it lies in.
    Rows equal in all of the order come in any order, but always the same."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.table(dealt, name).withColumn("part", F.shiftright("_at", PLACE_BITS))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("x"))
    before = _carried(df, sizes, 0, lambda a, b: a + b)
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return dealt.join(before, "part").withColumn(rank, F.col("before") + place + 1).drop("_at", "before")


def running(df: DataFrame, value: Column, how: str, name: str, reverse: bool = False) -> DataFrame:
    """A ``ranked`` frame with the sum, least or greatest ("sum", "min", "max") of ``value``, a double, over all
    rows up to each one, or from each one on if ``reverse``."""
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    start = {"sum": 0.0, "min": float("inf"), "max": float("-inf")}[how]
    add = {"sum": lambda a, b: a + b, "min": min, "max": max}[how]
    df = df.withColumn("_v", value.cast("double"))
    before = _carried(df, df.groupBy("part").agg(fold("_v").alias("x")), start, lambda a, b: a if b is None else add(a, b), reverse)
    inside = fold("_v").over(W.partitionBy("part").orderBy(F.desc("rank") if reverse else F.asc("rank")).rowsBetween(W.unboundedPreceding, 0))
    both = {"sum": lambda a, b: a + b, "min": F.least, "max": F.greatest}[how]
    return df.withColumn("_in", inside).join(before, "part").withColumn(name, both(F.col("before"), F.coalesce("_in", F.lit(start)))).drop("_v", "_in", "before")


def shifted(df: DataFrame, by: int, columns: dict[str, str]) -> DataFrame:
    """A ``ranked`` frame with columns of the row ``by`` ranks behind each one (before it, if negative), by new
    names; nulls where there is none."""
    other = df.select((F.col("rank") - by).alias("rank"), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(other, "rank", "left")


def quantile(df: DataFrame, value: str, q: float, scratch, name: str = "quantile") -> float | None:
    """The ``q`` quantile of a column by linear interpolation between the two values around it; two rows are read."""
    rows = ranked(df.select(F.col(value).cast("double").alias("v")).where("v is not null"), ["v"], scratch, name)
    at = (rows.count() - 1) * q
    if at < 0:
        return None
    near = {r["rank"]: r["v"] for r in rows.where(F.col("rank").isin(int(at) + 1, int(at) + 2)).collect()}
    scratch.drop(name)
    low = near[int(at) + 1]
    return low + (near.get(int(at) + 2, low) - low) * (at - int(at))
