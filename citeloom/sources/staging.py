"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def scratch(spark: SparkSession, what: str = "stage") -> str:
    """A fresh folder path under ``spark.checkpoint.dir``; only a local session, all of one process, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once and read back, so that what follows neither repeats nor reorders its work."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
