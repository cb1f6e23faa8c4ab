"""Intermediate tables in the folder that driver and executors share: lineage ends there, a lost executor costs no more."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session has one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return "file:///tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
