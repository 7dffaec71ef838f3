"""Folders for files that are written and read again within one run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def folder(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which all executors see; it goes when the driver ends.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cohortloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


class Tables:
    """Intermediate tables of one run, as Parquet in a folder of their own.

    A table that is written cuts the lineage of what reads it and survives lost executors.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, folder(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def save_counted(self, df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, tuple]:
        """The same, with aggregates over the rows that are taken while they are written."""
        seen = Observation()
        named = [c.alias(f"s{k}") for k, c in enumerate(sums)]
        out = self.save(df.observe(seen, F.count(F.lit(1)).alias("n"), *named), name)
        return out, tuple(seen.get[k] for k in ("n", *(f"s{k}" for k in range(len(sums)))))

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        for name in names:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
