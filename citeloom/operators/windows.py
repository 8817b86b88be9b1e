"""Windows, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def first_occurrence(occurrences: DataFrame, notices: DataFrame) -> DataFrame:
    """The first mention (by ``pos``) of each DOI with a notice on a page."""
    flagged = occurrences.join(notices.select("doi", "kind"), "doi")
    order = Window.partitionBy("page_id", "doi").orderBy("pos")
    return flagged.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def cap_augmentations(entries: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` entries of a page in document order."""
    order = Window.partitionBy("page_id").orderBy("pos")
    return entries.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")


def latest_log_entries(logs: DataFrame, n: int = 800, most: int = 1000) -> DataFrame:
    """The newest ``n`` rows of each source (source, t, level, msg), cut to ``most`` characters, with ``place`` oldest first and n-of-m counts."""
    newest = Window.partitionBy("source").orderBy(F.desc("t"), F.desc("msg"))
    total = logs.groupBy("source").agg(F.count("*").alias("total"))
    kept = logs.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= n).join(total, "source")
    shown = F.least(F.col("total"), F.lit(n))
    return kept.select("source", "t", "level", F.substring("msg", 1, most).alias("msg"), (shown - F.col("back") + 1).alias("place"), shown.alias("shown"), "total")


def new_dois(scan: DataFrame, processed: DataFrame) -> DataFrame:
    """DOIs of a page's scan that were not processed before."""
    return scan.select("page_id", "doi").distinct().join(processed.select("page_id", "doi"), ["page_id", "doi"], "left_anti")


def doi_set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page_id", "doi").unionByName(b.select("page_id", "doi")).distinct()


def doi_set_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page_id", "doi").distinct().join(b.select("page_id", "doi"), ["page_id", "doi"], "left_anti")


def page_sessions(events: DataFrame) -> DataFrame:
    """``events`` (tab, ts, seq, url) with ``visit``, counted from 1: a new one begins when a tab's url changes.

    A tab's events are dealt over tasks wherever they are many; each part begins
    with the last url and the visits of the parts before it.
    """
    rows = scans.in_order(events.select("tab", "ts", "seq", F.struct(F.col("url")).alias("place"), F.struct("*").alias("row")), "tab", "ts", "seq")
    own = Window.partitionBy("tab", "part").orderBy("at")
    # a struct, so that a null url is told from no event before
    new = F.lag("place").over(own).isNotNull() & ~F.col("place").eqNullSafe(F.lag("place").over(own))
    rows = rows.withColumn("new", new.cast("long"))
    parts = rows.groupBy("tab", "part").agg(F.min_by("place", "at").alias("first"), F.max_by("place", "at").alias("last"), F.sum("new").alias("inner"))
    tab = Window.partitionBy("tab").orderBy("part")
    begins = (~F.col("first").eqNullSafe(F.lag("last").over(tab))).cast("long")  # a tab's first part does
    parts = parts.withColumn("begins", begins)
    carried = F.sum("begins").over(tab.rowsBetween(*scans.UPTO)) + F.coalesce(F.sum("inner").over(tab.rowsBetween(*scans.BEFORE)), F.lit(0))
    parts = parts.select("tab", "part", carried.alias("carried"))
    rows = scans.with_parts(rows.withColumn("within", F.sum("new").over(own.rowsBetween(*scans.UPTO))), parts, "tab", "part")
    kept = rows.select("row", (F.col("carried") + F.col("within")).alias("visit"))
    return kept.select("row.*", "visit")
