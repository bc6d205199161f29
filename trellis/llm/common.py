"""Shared pieces: scratch tables in the cluster's shared folder, table loading, token splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: Fixed value: the same white space as characters.
SPACE_CHARS = " \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session. Only a session on this one machine gets a temporary one
    where none is configured; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="trellis-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        schema = df.schema
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, f"{self.base}/{name}")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``: a lambda variable is never re-evaluated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text, as an array; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def slices(batch: pa.RecordBatch, most: int = 8 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, in order; ``column`` holds the text."""
    n = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = n[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(n, done + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def bit_table(keys: DataFrame, log_bits: int = 21) -> DataFrame:
    """(word, bits): which values modulo 2^``log_bits`` the one column of 64-bit hashes takes. It never
    has more than 2^(log_bits - 6) rows, whatever the input, and so can be broadcast."""
    place = F.pmod(F.col(keys.columns[0]), F.lit(1 << log_bits))
    return keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))


def marked(rows: DataFrame, key: Column, table: DataFrame, how: str, log_bits: int = 21) -> DataFrame:
    """``rows`` whose hash ``key`` may be in a bit table, without losing one that is (how: left_semi);
    or all rows, with a column ``word`` that is null where it certainly isn't (how: left)."""
    rows = rows.withColumn("_p", F.pmod(key, F.lit(1 << log_bits)))
    hit = (F.shiftright(rows["_p"], 6) == table["word"]) & (F.getbit(table["bits"], rows["_p"].bitwiseAND(F.lit(63)).cast("int")) == 1)
    return rows.join(F.broadcast(table), hit, how).drop("_p", "bits")


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], n: str, most: int = 2048, salts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key and the number ``n`` of rows that
    meet it. Keys with more than ``most`` are dealt over ``salts`` tasks: both sides read from one
    bounded bit table whether a key is salted, so they always agree on it."""
    key = F.xxhash64(*on)
    bits = bit_table(table.where(F.col(n) > most).select(key.alias("h")))
    left = marked(rows, key, bits, "left").withColumn("_salt", F.when(F.col("word").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0).cast("int"))
    copies = F.when(F.col("word").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = marked(table, key, bits, "left").withColumn("_salt", F.explode(copies))
    return left.drop("word").join(right.drop("word", n), [*on, "_salt"]).drop("_salt")
