"""Cache tables with a time to live: rows (key, value, written_at); a null value is a known miss."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import scans


def _time(now: dt.datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp")


def split_cached(requests: DataFrame, cache: DataFrame, ttl: dt.timedelta, now: dt.datetime | Column) -> DataFrame:
    """Distinct requested keys with value and state: hit, miss (known) or fetch. A row is fresh while its age is at most ``ttl``."""
    age = F.unix_micros(_time(now)) - F.unix_micros("written_at")
    fresh = cache.withColumn("fresh", age <= int(ttl.total_seconds() * 1e6)).where("fresh")
    keys = requests.select("key").where("key IS NOT NULL").distinct()
    state = F.when(F.col("fresh").isNull(), "fetch").when(F.col("value").isNull(), "miss").otherwise("hit")
    return keys.join(fresh.select("key", "value", "fresh"), "key", "left").select("key", "value", state.alias("state"))


def upsert_cache(cache: DataFrame, updates: DataFrame, keep_misses: bool = True) -> DataFrame:
    """The cache after ``updates`` (key, value, written_at, failed): the last write of a key wins, failed calls write nothing, misses only where kept."""
    new = updates.where(~F.coalesce("failed", F.lit(False)) & (F.lit(keep_misses) | F.col("value").isNotNull()))
    both = cache.select("key", "value", "written_at", F.lit(0).alias("new")).unionByName(new.select("key", "value", "written_at", F.lit(1).alias("new")))
    last = F.max_by(F.struct("value", "written_at"), F.struct("written_at", "new", "value"))
    return both.groupBy("key").agg(last.alias("r")).select("key", "r.value", "r.written_at")


def evict_to_quota(cache: DataFrame, quota: int, now: dt.datetime | Column) -> DataFrame:
    """Rows (key, bytes, created_at, expires_at) that stay; the key is a string.

    At the quota or above it, expired rows go, then the oldest until the bytes
    freed exceed what is over; a missing created_at is oldest, and rows of one
    age go by key. 0 means no limit. Rows are sorted over tasks once; a running sum
    is taken over one row a task, and over the rows of the one in which the bytes
    freed suffice, whatever ties.
    """
    total = cache.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    if not quota or total < quota:
        return cache
    over = total - quota
    dead = F.coalesce(F.col("expires_at") <= _time(now), F.lit(False))
    first = cache.where(dead).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first()["b"]
    rows = scans.in_order(cache.where(~dead).select("created_at", "key", "bytes", F.struct("*").alias("row")), "created_at", "key")
    parts = rows.groupBy("part").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"))
    before = F.coalesce(F.sum("b").over(Window.orderBy("part").rowsBetween(*scans.BEFORE)), F.lit(0)) + first
    parts = staged(parts.withColumn("before", before))  # a row for each part
    stay = rows.join(parts.where(F.col("before") > over).select("part"), "part").select("row.*")
    edge = rows.join(parts.where((F.col("before") <= over) & (F.col("before") + F.col("b") > over)), "part")
    own = Window.partitionBy("part").orderBy("at").rowsBetween(*scans.BEFORE)
    walked = edge.withColumn("gone", F.col("before") + F.coalesce(F.sum("bytes").over(own), F.lit(0)))
    return stay.unionByName(walked.where(F.col("gone") > over).select("row.*"))


def cache_hits_asof(requests: DataFrame, writes: DataFrame, ttl: dt.timedelta) -> DataFrame:
    """``requests`` (request_id, key, ts) with ``hit``: whether the key's last write (key, ts) up to then is at most ``ttl`` old.

    Both are one sequence by key and time, dealt over tasks wherever a key is
    large; each part begins with the last write of the parts before it.
    """
    r = requests.select("request_id", "key", "ts", F.lit(1).alias("o"), F.lit(None).cast("timestamp").alias("w"))
    w = writes.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "key", "ts", F.lit(0).alias("o"), F.col("ts").alias("w"))
    rows = scans.in_order(r.unionByName(w), "key", "ts", "o")
    parts = rows.groupBy("key", "part").agg(F.max("w").alias("w"))
    parts = parts.select("key", "part", F.max("w").over(Window.partitionBy("key").orderBy("part").rowsBetween(*scans.BEFORE)).alias("carried"))
    own = F.max("w").over(Window.partitionBy("key", "part").orderBy("at").rowsBetween(*scans.UPTO))
    rows = scans.with_parts(rows.withColumn("own", own).where("o = 1"), parts, "key", "part")
    hit = F.unix_micros("ts") - F.unix_micros(F.coalesce("own", "carried")) <= int(ttl.total_seconds() * 1e6)
    return rows.select("request_id", "key", "ts", F.coalesce(hit, F.lit(False)).alias("hit"))
