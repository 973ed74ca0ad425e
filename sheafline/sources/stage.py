"""Intermediate tables in the shared folder: where lineage is cut, and what is written for a while."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints and intermediate tables: that of spark.checkpoint.dir. Where it is unset, a session on one
    machine (as in tests) takes one in the warehouse; on a cluster, where that may be a disk of one machine, it is an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def intermediate(spark: SparkSession, name: str) -> str:
    """A new folder for a table in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str, now: bool = True) -> None:
    """Deletes a folder of intermediate tables, at once or when the driver ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if now:
        files.delete(path, True)
    else:
        files.deleteOnExit(path)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage is cut there, what is read is read by column, and
    lost executors cost nothing that was written. The table is deleted when the driver ends."""
    spark = df.sparkSession
    folder = folder or intermediate(spark, name)
    df.write.option("compression", "zstd").parquet(folder)
    discard(spark, folder, now=False)
    return spark.read.schema(df.schema).parquet(folder)
