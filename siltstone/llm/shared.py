"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, as in tests, a temporary one, in local mode only."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="siltstone-")
        sc.setCheckpointDir(known)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder: later steps read them there whatever executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed(), as a Parquet table: compressed, and columns can be read apart."""
    path = f"{shared_dir(df.sparkSession)}/siltstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.parquet(path)
    table.stored_at = path
    return table


def dropped(table: DataFrame) -> None:
    """Deletes a table of stored() that nothing reads any more."""
    spark, path = table.sparkSession, table.__dict__.get("stored_at")
    if path:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
