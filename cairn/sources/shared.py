"""The folder that driver and executors share, and deleting in it."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def drop_folder(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(where) if at_exit else fs.delete(where, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in that of ``spark.checkpoint.dir``, or in the session's warehouse; it goes with the session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    drop_folder(spark, path, at_exit=True)
    return path
