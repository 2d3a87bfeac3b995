"""Shared scratch tables.

Intermediate results are cut from their lineage by writing them as Parquet below the folder
that the cluster names in ``spark.checkpoint.dir``. Every executor and the driver see that
folder, so a lost executor never loses a stage's result.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is configured and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_linkloom_shared", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="linkloom-")
        spark.sparkContext._linkloom_shared = folder
    return folder.rstrip("/")


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


class Scratch:
    """One run's folder of tables; it goes when the session ends, or table by table with drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/linkloom/{name}-{uuid.uuid4().hex}"
        fs, path = _fs(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows once and returns the table; lineage ends here."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = _fs(self.spark, self.path(name))
            fs.delete(path, True)
