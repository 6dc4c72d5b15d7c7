"""Tables that a query needs several times, written once to the folder that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder in the warehouse, on a local master only: what executors of a
    cluster share can't be guessed. It is set then, so that checkpoint() goes there too."""
    set_to = spark.sparkContext.getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or set_to
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "palimpsest-shared")
    if not set_to:
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the application."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df and read it back: lineage ends there, and whatever reads it several times computes it once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
