"""Makes this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the job's Python files, once a context. The driver serves the file to executors."""
    sc = spark.sparkContext
    if not getattr(sc, "_siltstone_shipped", False):
        here = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="siltstone-"), "siltstone.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, str(p.relative_to(here.parent)))
        sc.addPyFile(target)
        sc._siltstone_shipped = True
    return spark


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small table in as many partitions as there are cores, where less than a quarter of them would have work.

    A file of one row group is read by one task; larger tables stay as they are. With keys the order of the rows is
    fixed, by these columns.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() * 4 > cores:
        return rows
    return rows.repartition(cores, *keys).sortWithinPartitions(*keys) if keys else rows.repartition(cores)
