"""Intermediate tables: they cut plans and lineage, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Work:
    """A fresh folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode, else below the warehouse."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = tempfile.mkdtemp(prefix="veilframe-") if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.sql.warehouse.dir')}/veilframe-work"
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{label}")
