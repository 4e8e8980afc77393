"""Scratch tables: they cut lineage, and any executor can read them again after a loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A folder of one call below ``spark.checkpoint.dir``, which all executors share. Only a local master may leave it unset."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = f"{tempfile.gettempdir()}/checkpoints"
        self.root = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and read it back; what built it never runs again."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete scratch tables that no later step reads."""
        for t in tables:
            if t is not None and hasattr(t, "_scratch_path"):
                jvm = self.spark.sparkContext._jvm
                path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
