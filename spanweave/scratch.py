"""Tables that cut lineage, in the folder that a cluster shares for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Tables written once into the cluster's shared checkpoint folder, to cut lineage: a lost executor costs
    no recomputation of what has been written. ``drop`` removes a table that no later plan reads."""

    def __init__(self, spark: SparkSession, what: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:  # only where the session names none, as in tests
            base = tempfile.mkdtemp(prefix="spanweave-")
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.base = spark, f"{base.rstrip('/')}/spanweave-{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
