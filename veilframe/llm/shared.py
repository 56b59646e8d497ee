"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group of more than this share of all rows is treated apart; there are at most 1 / HEAVY_SHARE such groups.
HEAVY_SHARE = 1 / 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    That one is a temporary folder in local mode only; elsewhere it is below the warehouse.
    """
    own = spark.sparkContext.getCheckpointDir()
    setting = spark.conf.get("spark.checkpoint.dir", None)
    if own is None and setting:
        spark.sparkContext.setCheckpointDir(setting)
    elif own is None:
        local = spark.sparkContext.master.startswith("local[")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="veilframe-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/veilframe-work")
    return setting or spark.sparkContext.getCheckpointDir()


class Workspace:
    """A fresh folder below the shared one, for tables that cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, label: str) -> str:
        return f"{self.root}/{label}"

    def keep(self, df: DataFrame, label: str, **options) -> DataFrame:
        """Write df as Parquet and read it back."""
        df.write.mode("overwrite").options(**({"compression": "zstd"} | options)).parquet(self.path(label))
        return self.spark.read.schema(df.schema).parquet(self.path(label))

    def release(self) -> None:
        """Have the driver collect its garbage, so that shuffle files of plans that have run are deleted now."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, label: str = "") -> None:
        """Delete a table that no pending plan reads any more (all tables if label is empty)."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(label) if label else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return what this Python worker has freed to the system; for the end of a task, as workers outlive tasks."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5 is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def join_heavy_apart(left: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left inner join groups on key, where n in groups counts left's rows of that key.

    Groups of more than total * HEAVY_SHARE rows, at most 1 / HEAVY_SHARE of them, are broadcast; so no task of the
    shuffled rest gets more than that share for one key. Null keys match nothing: leave them out or replace them.
    """
    heavy = F.col(n) > F.lit(max(1000.0, total * HEAVY_SHARE))
    big = F.broadcast(groups.filter(heavy))
    few = big.select(F.col(key))
    rest = left.join(few, key, "left_anti").join(groups.filter(~heavy), key)
    return left.join(big, key).unionByName(rest)
