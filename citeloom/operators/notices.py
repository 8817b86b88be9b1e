"""Reduction of status events to one current notice a paper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.doi import is_real_doi

#: Natures that change a paper's status, in the order that settles ties of time.
RETRACTION, CONCERN, REINSTATEMENT = "Retraction", "Expression of concern", "Reinstatement"
_NEVER = "0001-01-01 00:00:00"


def reduce_notices(events: DataFrame) -> DataFrame:
    """(origin_doi, notice_doi, kind, pos) from events (seq, original_doi, nature, event_time, notice_doi).

    The latest event decides a paper's status; at the same time retraction beats
    reinstatement beats concern, then the first in the file. Reinstated papers
    have no notice. The link is a real DOI if there is one, then the latest, among
    events of the winning nature; papers whose link stays blank are left out.
    ``pos`` is the paper's first place in the file. One shuffle, by paper: the
    link of each nature is kept beside the status.
    """
    rank = F.when(F.col("nature") == RETRACTION, 3).when(F.col("nature") == REINSTATEMENT, 2).when(F.col("nature") == CONCERN, 1)
    rows = events.select(
        F.trim("original_doi").alias("origin_doi"), F.trim("nature").alias("nature"), F.coalesce(F.trim("notice_doi"), F.lit("")).alias("notice_doi"),
        F.coalesce(F.col("event_time").cast("timestamp"), F.lit(_NEVER).cast("timestamp")).alias("at"), "seq",
    ).where(F.col("nature").isin(RETRACTION, CONCERN, REINSTATEMENT) & is_real_doi(F.col("origin_doi")))
    back = -F.col("seq")
    link = F.struct(is_real_doi(F.col("notice_doi")).alias("real"), "at", back.alias("back"))
    own = lambda nature: F.max_by("notice_doi", F.when(F.col("nature") == nature, link))
    last = rows.groupBy("origin_doi").agg(
        F.max_by("nature", F.struct("at", rank.alias("rank"), back.alias("back"))).alias("nature"),
        own(RETRACTION).alias("retraction"), own(CONCERN).alias("concern"), F.min("seq").alias("pos"),
    )
    kind = F.when(F.col("nature") == RETRACTION, "retraction").when(F.col("nature") == CONCERN, "concern")
    out = last.select("origin_doi", F.when(kind == "retraction", F.col("retraction")).otherwise(F.col("concern")).alias("notice_doi"), kind.alias("kind"), "pos")
    return out.where("kind IS NOT NULL AND notice_doi <> ''")


def notice_counts(notices: DataFrame) -> DataFrame:
    return notices.groupBy("kind").agg(F.count("*").alias("papers"))
