"""Intermediate tables, in a folder shared by driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; where it is unset, a folder of the warehouse, or a temporary one if all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="scriptorium-")
    return _local[app]


def write(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there.

    Files are removed when the JVM's file system closes.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/scriptorium/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
