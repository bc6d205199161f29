"""Reading count tables and reports into long form, and making the normalised container."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.plans.scratch import Scratch


@dataclass(frozen=True)
class Container:
    """Named long tables; absent rows of ``counts`` and ``expr`` are zeros."""

    counts: DataFrame
    expr: DataFrame
    cells: DataFrame
    groups: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def with_table(self, name: str, df: DataFrame) -> Container:
        return replace(self, tables=self.tables | {name: df})


def create(counts: DataFrame, meta: DataFrame | None = None, min_cells: int = 3, min_genes: int = 500, min_counts: float = 10, gene_max_cut: float = 5000, scratch: Scratch | None = None) -> Container:
    """Filter cells, then genes on those cells, and log-normalise: log2(count * scale + 1), two decimals.

    Genes are counted before, counts after the gene filter. The median of the totals is one row. With
    ``scratch`` counts, cells and values are written once, so that what is built on the container
    reads them instead of making them anew for each of its branches.
    """
    kept_once = scratch.table if scratch else lambda df, name: df
    counts = counts.where("count <> 0")
    n_genes = counts.groupBy("cell").agg(F.count("*").alias("n_genes")).where(F.col("n_genes") > min_genes)
    on_cells = counts.join(n_genes, "cell")
    genes = on_cells.groupBy("gene").agg(F.count("*").alias("nc"), F.sum("count").alias("t"), F.max("count").alias("m"))
    genes = genes.where((F.col("nc") > min_cells) & (F.col("t") > min_counts) & (F.col("m") <= gene_max_cut)).select("gene")
    kept = kept_once(on_cells.join(genes, "gene", "left_semi"), "counts")
    totals = kept.groupBy("cell").agg(F.first("n_genes").alias("n_genes"), F.sum("count").alias("n_trans"))
    middle = totals.agg(F.pow(F.lit(10.0), F.ceil(F.log10(F.expr("percentile(n_trans, 0.5)")))).alias("k"))
    cells = kept_once(totals.crossJoin(F.broadcast(middle)).withColumn("scale", F.col("k") / F.col("n_trans")).drop("k"), "cells")
    expr = kept.drop("n_genes").join(cells.select("cell", "scale"), "cell").select("gene", "cell", F.bround(F.log2(F.col("count") * F.col("scale") + 1), 2).alias("value"))
    expr = kept_once(expr, "expr")
    groups = cells.select("cell", F.lit("init").alias("grouping"), F.regexp_extract("cell", "^[^_-]*", 0).alias("value"))
    cells = cells.select("cell", "n_genes", "n_trans")
    if meta is not None:
        cells = cells.join(meta.drop("n_genes", "n_trans"), "cell", "left")
    return Container(kept.select("gene", "cell", "count"), expr, cells, groups)


def subset(c: Container, cells: DataFrame) -> Container:
    """Every per-cell table restricted to a list of cells; tables of edges at both ends."""
    keep = cells.select("cell").distinct()

    def cut(df: DataFrame) -> DataFrame:
        if "cell" in df.columns:
            return df.join(keep, "cell", "left_semi")
        for end in ("i", "j"):
            if end in df.columns:
                df = df.join(keep.withColumnRenamed("cell", end), end, "left_semi")
        return df

    return Container(cut(c.counts), cut(c.expr), cut(c.cells), cut(c.groups), {k: cut(v) for k, v in c.tables.items()})


def read_dense(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """A tab-separated gene by cell table with a header, gzip or plain, to (gene, cell, count)."""
    wide = spark.read.csv(path, sep="\t", header=True)
    gene, *cells = wide.columns
    long = wide.withColumnRenamed(gene, "gene").unpivot("gene", cells, "cell", "count").withColumn("count", F.col("count").try_cast("double")).where("count <> 0")
    return long.withColumn("cell", F.concat_ws("_", F.lit(prefix), "cell")) if prefix else long


def _numbered(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Lines of a small id file with their numbers from 1; one file, so one ordered partition."""
    df = spark.read.csv(path, sep="\t", schema=", ".join(f"{n} string" for n in names)).coalesce(1)
    return df.withColumn("line", F.monotonically_increasing_id() + 1)


def read_sparse(spark: SparkSession, folder: str, prefix: str | None = None, cells: list[str] | None = None, by: str = "gene", strip: bool = True) -> DataFrame:
    """A Matrix-Market bundle with barcodes and genes; by symbol, equal symbols are added up."""
    lines = spark.read.text(f"{folder}/matrix.mtx").where(~F.col("value").startswith("%"))
    parts = F.split("value", r"\s+")
    # the size line has three whole numbers, too: it is the one in front
    triplets = lines.withColumn("at", F.monotonically_increasing_id())
    size = triplets.agg(F.min("at").alias("size_at"))
    triplets = triplets.join(F.broadcast(size), F.col("at") > F.col("size_at"), "inner").select(parts[0].cast("long").alias("i"), parts[1].cast("long").alias("j"), parts[2].cast("double").alias("count"))
    barcodes = _numbered(spark, f"{folder}/barcodes.tsv", ["cell"]).withColumnRenamed("line", "j")
    if strip:
        barcodes = barcodes.withColumn("cell", F.regexp_replace("cell", r"-\d+$", ""))
    genes = _numbered(spark, f"{folder}/genes.tsv", ["id", "symbol"]).withColumnRenamed("line", "i")
    out = triplets.join(barcodes, "j").join(genes, "i")
    if cells is not None:
        out = out.join(spark.createDataFrame([(c,) for c in cells], "cell string"), "cell", "left_semi")
    if prefix:
        out = out.withColumn("cell", F.concat(F.lit(prefix), "cell"))
    if by == "gene":
        return out.groupBy(F.col("symbol").alias("gene"), "cell").agg(F.sum("count").alias("count"))
    return out.select(F.col("id").alias("gene"), "cell", "count")


def combine(tables: list[DataFrame]) -> DataFrame:
    """Side by side over the union of genes; what one lacks is zero, that is, has no row."""
    return reduce(DataFrame.unionByName, tables)


def read_stats(spark: SparkSession, reports: list[str], samples: list[str], read_counts: list[str] | None = None, with_sample: bool = True) -> DataFrame:
    """Per-sample reports with optional read counts, as one table with SAMPLE and CELL."""
    out = []
    for k, (path, sample) in enumerate(zip(reports, samples, strict=True)):
        df = spark.read.csv(path, sep="\t", header=True)
        if read_counts:
            counts = spark.read.csv(read_counts[k], sep="\t", schema="NUM_READS bigint, CELL_BARCODE string")
            df = df.join(counts, "CELL_BARCODE", "left")
        cell = F.concat_ws("_", F.lit(sample), "CELL_BARCODE") if with_sample else F.col("CELL_BARCODE")
        out.append(df.withColumn("SAMPLE", F.lit(sample)).withColumn("CELL", cell))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def meta_trim(counts: DataFrame, meta: DataFrame, column: str, low: float | None = None, high: float | None = None, cell: str = "cell") -> DataFrame:
    """Cells whose metadata lie within inclusive bounds; genes left without counts go with their rows."""
    ok = F.lit(True)
    if low is not None:
        ok &= F.col(column) >= low
    if high is not None:
        ok &= F.col(column) <= high
    return counts.join(meta.where(ok).select(F.col(cell).alias("cell")), "cell", "left_semi").where("count <> 0")


def knee_curve(reads: DataFrame, key: str, n: str, scratch: Scratch) -> DataFrame:
    """Cumulative share of reads over barcodes in decreasing order.

    The order is total, so ranges of it are spread over tasks: sums of ranges first, then within. The
    ranges are written once: both steps must see the same ones.
    """
    spread = reads.select(F.col(key).alias("key"), F.col(n).cast("double").alias("n")).repartitionByRange(F.desc("n"), F.asc("key")).sortWithinPartitions(F.desc("n"), F.asc("key")).withColumn("part", F.spark_partition_id())
    spread = scratch.table(spread, "ranges")
    sums = spread.groupBy("part").agg(F.sum("n").alias("s"), F.count("*").alias("m"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    before = sums.select("part", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias("s0"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("m0"), F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    inside = W.partitionBy("part").orderBy(F.desc("n"), F.asc("key"))
    return spread.withColumns({"r": F.row_number().over(inside), "c": F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, 0))}).join(F.broadcast(before), "part").select("key", (F.col("m0") + F.col("r")).alias("rank"), ((F.col("s0") + F.col("c")) / F.col("total")).alias("share"))


def reads_per_cell(molecules: DataFrame) -> DataFrame:
    """Sums of the three kinds of reads by barcode, largest total first, with the barcode's letters."""
    from trellis.functions.expr import decode_barcode

    kinds = ("reads", "unmapped_reads", "nonconf_mapped_reads")
    out = molecules.groupBy("barcode").agg(*[F.sum(k).alias(k) for k in kinds]).withColumn("total_reads", sum((F.col(k) for k in kinds[1:]), F.col(kinds[0])))
    return out.withColumn("cell", decode_barcode("barcode")).orderBy(F.desc("total_reads"))


def import_edges(transitions: DataFrame, eigen: DataFrame | None = None) -> dict[str, DataFrame]:
    """A ready-made diffusion map: its edges and vectors; walks and pseudotime start anew."""
    return {"edges": transitions.select("i", "j", F.col("w").cast("double").alias("w")), **({"eigen": eigen} if eigen is not None else {})}


def discrete_columns(meta: DataFrame, cell: str = "cell", most: float = 0.015) -> list[str]:
    """Columns with so few distinct values for the rows that they are taken as groups."""
    names = [c for c in meta.columns if c != cell]
    r = meta.agg(F.count("*").alias("_n"), *[F.count_distinct(c).alias(c) for c in names]).first()
    return [c for c in names if r["_n"] and r[c] / r["_n"] <= most]
