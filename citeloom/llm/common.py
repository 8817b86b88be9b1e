"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder path under the shared ``spark.checkpoint.dir``.

    Only a local session, all of one process, may leave that unset: it gets a
    temporary folder. A cluster must name the folder that its executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def materialise(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This computes an expensive stage once and cuts its lineage; the copy
    outlives any executor.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys up to which a table with a row for each is sent to all tasks; beyond, the join is salted.
SENT = 20_000
SALTS = 32


def join_small(rows: DataFrame, per: DataFrame, key: str, salt: str) -> DataFrame:
    """``rows`` left-joined with ``per``, which has one row a key, without bringing the rows of a hot key together.

    A null key meets a null key. ``salt`` is a column of ``rows`` that differs among rows of a key.
    """
    there = per.withColumnRenamed(key, "__key")
    same = F.col(key).eqNullSafe(F.col("__key"))
    if per.count() <= SENT:
        return rows.join(F.broadcast(there), same, "left").drop("__key")
    spread = there.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__deal", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, same & (F.col("__deal") == F.col("__salt")), "left").drop("__key", "__deal", "__salt")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def n_words(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node id reachable from every node with an edge.

    ``edges`` holds two long columns ``a`` and ``b``. Large-star and small-star
    rounds alternate until the edges are stars; the number of rounds grows with
    the logarithm of a component's size. A node's neighbours are reduced to a
    minimum, which is written and joined back: both sides of a join are then
    plain shuffles, which adaptive execution splits where a hub is large, or
    the minima are small enough for Spark to send to all tasks.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = materialise(e), None
    while True:
        size = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before or size[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = size
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialise(large.distinct())
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialise(small.union(least.select("u", F.col("m").alias("v"))).distinct())
