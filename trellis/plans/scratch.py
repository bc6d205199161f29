"""Tables written to the cluster's shared folder, which cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not root:  # only on one machine where none is configured, as in tests
            root = tempfile.mkdtemp(prefix="trellis-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.base = spark, f"{root.rstrip('/')}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
