"""Session helpers: the shared folder, materialised tables and test tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    return "file://" + os.path.join(tempfile.gettempdir(), "loam-shared")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is deleted when the driver ends in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loam-{uuid.uuid4().hex}")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(root)
    files.deleteOnExit(root)
    return f"{root.toString()}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
