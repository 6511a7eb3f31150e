"""Intermediate tables in the folder all executors share.

Iterative fits and multi-use frames are written once and read back.  That cuts
the lineage, survives the loss of any executor, and gives later stages a table
whose size is known.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on a local master."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="areacast-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under one folder per application, so it can be dropped as a whole."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/areacast-{app}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
