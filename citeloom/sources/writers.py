"""Sinks: snapshots in versions, reduced notices and reports."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


#: Versions of a snapshot that stay, so that jobs which began on one end on it.
KEEP = 3


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a snapshot, oldest first: those whose writing job left its marker."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(hadoop.Path(root, "v-*/_SUCCESS")) or []
    return sorted(f.getPath().getParent().toString() for f in found)


def write_snapshot(rows: DataFrame, path: str, partition_by: tuple[str, ...] = (), keep: int = KEEP) -> str:
    """Write ``rows`` as the new version of the snapshot at ``path`` and return its folder.

    A version is a folder of its own, and counts once its job has left the marker
    that it writes last. Until then, and if it fails at any step, readers find the
    version before. The ``keep`` newest stay; older ones go after the new is there.
    """
    spark = rows.sparkSession
    version = f"{path.rstrip('/')}/v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").partitionBy(*partition_by).parquet(version)
    hadoop = spark._jvm.org.apache.hadoop.fs
    for old in _versions(spark, path)[:-keep]:
        target = hadoop.Path(old)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of the snapshot at ``path``."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"{path} has no complete version")
    return spark.read.parquet(versions[-1])


def write_notices(notices: DataFrame, path: str) -> None:
    """Replace the notice table, by kind; a failure keeps the old one."""
    write_snapshot(notices, path, ("kind",))


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    return read_snapshot(spark, path)


def report_lines(reports: DataFrame) -> DataFrame:
    """One JSON text a report, with its version."""
    body = F.struct(F.lit(VERSION).alias("v"), *[c for c in reports.columns if c != "v"])
    return reports.select(F.to_json(body).alias("value"))


def write_reports(reports: DataFrame, path: str) -> None:
    report_lines(reports).write.mode("overwrite").text(path)


def parse_reports(lines: DataFrame, schema: str) -> DataFrame:
    """Reports of JSON texts in ``value``: broken ones, other versions and titles that are no text are left out."""
    part = lambda x, path: F.try_variant_get(x, path, "variant")
    kind = lambda x, path: F.schema_of_variant(part(x, path))
    fine = lambda x: kind(x, "$.v").isin("BIGINT", "STRING") & (F.try_variant_get(x, "$.v", "string") == str(VERSION)) & (kind(x, "$.title") == "STRING")
    # a list of one, so that a text is parsed once for all that is asked of it; a broken text has no version
    good = F.exists(F.array(F.try_parse_json("value")), fine)
    return lines.where(good).select(F.from_json("value", f"v int, {schema}").alias("r")).select("r.*")


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_reports(spark.read.text(path), schema)
