"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.errors import TidelogError


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one where a local session names none, an error where a cluster does not."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise TidelogError("SHARED_FOLDER_MISSING", "A cluster needs a folder that all executors share in spark.checkpoint.dir")
    return (found or os.path.join(tempfile.gettempdir(), "tidelog-checkpoints")).rstrip("/")


def written_by(frame: DataFrame, column: str) -> str:
    """The folder of a table with a folder for each value of a column."""
    path = f"{folder(frame.sparkSession)}/tidelog/{uuid.uuid4().hex}"
    frame.write.partitionBy(column).parquet(path)
    return path


def written(frame: DataFrame) -> DataFrame:
    """The frame as a table of its own: no lineage beyond its files, so a lost executor repeats nothing before it."""
    spark = frame.sparkSession
    path = f"{folder(spark)}/tidelog/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
