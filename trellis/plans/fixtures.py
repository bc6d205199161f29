"""The public star-schema tables seen as cells, genes, vectors, walks and a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are suppliers, genes are parts."""
    line = load(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").cast("string").alias("cell"), F.col("l_partkey").cast("string").alias("gene")).agg(F.sum("l_quantity").alias("count"))


def customer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are customers, genes are brands."""
    line, orders, part = (load(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    met = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return met.groupBy(F.col("o_custkey").cast("string").alias("cell"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("count"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("string").alias("grp"))


def clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, gene, value): vector components, negative ones as absent zeros; gene is the dimension."""
    v = vectors(spark, sf_dir).select("cell", F.posexplode("vec").alias("gene", "value"))
    return v.where("value > 0").select("cell", F.col("gene").cast("string").alias("gene"), "value")


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in time order are a walk over event types by hour."""
    e = load(spark, sf_dir, "events")
    cell = F.concat_ws("-", "event_type", F.hour("ts").cast("string"))
    return e.select(F.col("user_id").alias("walk"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"), cell.alias("cell"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World, regions, nations, suppliers as (parent, child)."""
    r, n, s = (load(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    lab = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = r.select(F.lit("world").alias("parent"), lab("r", "r_regionkey").alias("child"))
    b = n.select(lab("r", "n_regionkey").alias("parent"), lab("n", "n_nationkey").alias("child"))
    c = s.select(lab("n", "s_nationkey").alias("parent"), lab("s", "s_suppkey").alias("child"))
    return a.union(b).union(c)


SQL = {
    "m1": "m1 as (select l_suppkey::varchar cell, l_partkey::varchar gene, sum(l_quantity) as count from lineitem group by 1, 2)",
    "m2": "m2 as (select o_custkey::varchar cell, p_brand gene, sum(l_quantity) as count from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2)",
    "e1": "e1 as (select vec_id cell, label::varchar grp, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 as g from embeddings), c1 as (select cell, grp, g::varchar gene, v as value from e1 where v > 0), sz as (select label::varchar grp, count(*) n from embeddings group by 1)",
    "w1": "w1 as (select user_id walk, row_number() over (partition by user_id order by ts, event_id) pos, event_type || '-' || hour(ts)::varchar cell from events)",
    "t1": "t1 as (select 'world' parent, 'r' || r_regionkey child from region union all select 'r' || n_regionkey, 'n' || n_nationkey from nation union all select 'n' || s_nationkey, 's' || s_suppkey from supplier)",
}


def created_sql(source: str, min_cells: int, min_genes: int, min_counts: int, cut: int) -> str:
    """CTEs ending in ``ex`` (gene, cell, value) and ``tot`` (cell, n_genes, n_trans)."""
    return f"""{SQL[source]}, nz as (select * from {source} where count <> 0),
ng as (select cell, count(*) n_genes from nz group by 1 having count(*) > {min_genes}), oc as (select nz.* from nz semi join ng using (cell)),
ge as (select gene from oc group by 1 having count(*) > {min_cells} and sum(count) > {min_counts} and max(count) <= {cut}),
kp as (select oc.* from oc semi join ge using (gene)), tot as (select kp.cell, any_value(n_genes) n_genes, sum(count) n_trans from kp join ng on ng.cell = kp.cell group by 1),
sc as (select cell, power(10, ceil(log10((select median(n_trans) from tot)))) / n_trans s from tot),
ex as (select gene, kp.cell, round(log2(count * s + 1), 2) as value from kp join sc on sc.cell = kp.cell)"""
