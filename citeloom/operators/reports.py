"""Aggregations for pages, sheets and papers.

Arrays are collected with their positions and sorted, so results don't depend on
the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import author_label
from ..functions.web import is_safe_url


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def evidence_totals(df: DataFrame) -> DataFrame:
    """Per page over its distinct DOIs (page_id, doi, replications, reproductions): sums, DOI count and list; pages without any give no row.

    A page's list is needed anyway, so its DOIs are told apart in it, and no task holds a map of all (page, DOI) pairs.
    """
    r, p = (F.coalesce(c, F.lit(0)) for c in ("replications", "reproductions"))
    pages = df.where((r > 0) | (p > 0)).groupBy("page_id").agg(F.collect_set(F.struct("doi", r.alias("r"), p.alias("p"))).alias("rows"))
    for c in "rp":  # the greatest of each DOI is the last of those sorted
        pages = pages.withColumn(c, F.sort_array(F.transform("rows", lambda x: F.struct(x["doi"].alias("doi"), x[c].alias("v")))))
        pages = pages.withColumn(c, F.filter(c, lambda x, i: (i == F.size(c) - 1) | ~F.get(c, i + 1)["doi"].eqNullSafe(x["doi"])))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["v"])
    dois = F.transform("r", lambda x: x["doi"])
    return pages.select(
        "page_id", total("r").alias("replications"), total("p").alias("reproductions"), F.size("r").cast("long").alias("n_dois"), F.filter(dois, lambda x: x.isNotNull()).alias("dois")
    )


def notice_summary(df: DataFrame) -> DataFrame:
    """Per page (page_id, doi, kind): retracted and concern counts and a headline, retractions first.

    A page's DOIs are told apart in its own set, after the rows are dealt out by page, so no task holds a map of (page, DOI) pairs.
    """
    sets = df.select("page_id", "doi", "kind").repartition("page_id").groupBy("page_id").agg(F.collect_set(F.struct("doi", "kind")).alias("rows"))
    n = lambda kind: F.size(F.filter("rows", lambda x: x["kind"] == kind)).cast("long")
    one = sets.select("page_id", n("retraction").alias("retracted"), n("concern").alias("concerns"))
    a = F.when(F.col("retracted") > 0, F.concat(_plural(F.col("retracted"), "retracted paper")))
    b = F.when(F.col("concerns") > 0, F.concat(_plural(F.col("concerns"), "expression"), F.lit(" of concern")))
    return one.withColumn("headline", F.concat_ws(", ", a, b))


def article_panel(df: DataFrame) -> DataFrame:
    """Per page over its article DOIs (page_id, pos, doi, stats, replications, reproductions, originals, notice): sums, flat lists, whether it replicates, first notice."""
    ordered = lambda k: F.flatten(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(k).alias("v")))), lambda x: x["v"]), lambda v: v.isNotNull())).alias(k)
    total = lambda k: F.sum(F.coalesce(f"stats.{k}", F.lit(0))).alias(k)
    out = df.groupBy("page_id").agg(
        total("n_replications_total"), total("n_reproductions_total"), total("n_originals_total"),
        ordered("replications"), ordered("reproductions"), ordered("originals"), F.min_by("notice", F.when(F.col("notice").isNotNull(), F.col("pos"))).alias("notice"),
    )
    return out.withColumn("is_replication", F.col("n_originals_total") > 0)


def primary_feedback(df: DataFrame, host: str) -> DataFrame:
    """The page's discussion with the most comments (page_id, pos, doi, total_comments, url); the first wins ties; no row if its link leaves ``host``."""
    best = df.where("total_comments > 0").groupBy("page_id").agg(F.max_by(F.struct("doi", "total_comments", "url"), F.struct("total_comments", (-F.col("pos")).alias("p"))).alias("b")).select("page_id", "b.*")
    name = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return best.where(is_safe_url(F.col("url")) & ((name == host) | F.endswith(name, F.lit(f".{host}"))))


def flagged_references(references: DataFrame, feedback: DataFrame, notices: DataFrame, evidence: DataFrame) -> DataFrame:
    """(page_id, doi, comments, kind, replications, reproductions, originals) of distinct reference DOIs that anything is known of.

    ``notices`` has one row a lower-case ``doi``, as ``folded_notices`` gives.
    """
    one = references.select("page_id", "doi").where("doi IS NOT NULL").distinct()
    f = feedback.groupBy("doi").agg(F.max("total_comments").alias("comments"))
    e = evidence.groupBy("doi").agg(*[F.max(c).alias(c) for c in ("replications", "reproductions", "originals")])
    rows = one.join(f, "doi", "left").join(notices.select("doi", "kind"), "doi", "left").join(e, "doi", "left")
    known = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("comments", "replications", "reproductions", "originals")]) > 0
    return rows.where(known | F.col("kind").isNotNull()).select("page_id", "doi", "comments", "kind", "replications", "reproductions", "originals")


def badge_signal(df: DataFrame) -> DataFrame:
    """``df`` with badge (notice kind, replications, reproductions or none) and its count."""
    r, p = F.coalesce("replications", F.lit(0)), F.coalesce("reproductions", F.lit(0))
    badge = F.when(F.col("kind").isNotNull(), F.col("kind")).when(r > 0, "replications").when(p > 0, "reproductions").otherwise("none")
    return df.withColumn("badge", badge).withColumn("badge_count", F.when(F.col("kind").isNotNull(), F.lit(None).cast("long")).when(r > 0, r).when(p > 0, p))


def reference_tags(df: DataFrame) -> DataFrame:
    """``df`` with its tags; rows without any are dropped."""
    n = lambda c, word: F.when(F.coalesce(c, F.lit(0)) > 0, _plural(F.col(c), word))
    tags = F.array(
        n("replications", "replication"), n("reproductions", "reproduction"), F.when(F.coalesce("in_atlas", F.lit(False)), "in atlas"),
        F.when(F.col("kind") == "retraction", "retracted"), F.when(F.col("kind") == "concern", "concern"), n("comments", "comment"),
    )
    return df.withColumn("tags", F.filter(tags, lambda t: t.isNotNull())).where(F.size("tags") > 0)


def entry_line(authors: Column, year: Column, journal: Column) -> Column:
    """authors · year · journal, of those known."""
    return F.concat_ws(" · ", F.nullif(author_label(authors), F.lit("")), F.when(year != 0, year.cast("string")), F.nullif(journal, F.lit("")))


def meta_report(papers: DataFrame, entries: DataFrame, references: DataFrame, feedback: DataFrame) -> DataFrame:
    """One nested report a paper.

    ``papers``: (doi, title, notice); ``entries``: (doi, role, pos, title, authors,
    year, journal, outcome) with role replication, reproduction or original;
    ``references``: (doi, pos, ref_doi, title, tags); ``feedback``: (doi, comments, url).
    """
    roles = ("replication", "reproduction", "original")
    item = F.struct("role", "pos", "title", entry_line(F.col("authors"), F.col("year"), F.col("journal")).alias("line"), "outcome")
    # one list a paper, parted by role after it is sorted, as a buffer for each role costs more than the rows
    rows = entries.select("doi", F.when(F.col("role").isin(*roles), item).alias("item")).repartition("doi")
    one = rows.groupBy("doi").agg(F.sort_array(F.collect_list("item")).alias("rows"))
    of = lambda role: F.transform(F.filter("rows", lambda x: x["role"] == role), lambda x: x.dropFields("role"))
    lists = one.select("doi", *[of(r).alias(f"{r}s") for r in roles])
    refs = references.groupBy("doi").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("ref_doi").alias("doi"), "title", "tags"))).alias("references"))
    talk = feedback.groupBy("doi").agg(F.max(F.struct(F.col("comments"), F.col("url"))).alias("discussion"))
    out = papers.join(lists, "doi", "left").join(refs, "doi", "left").join(talk, "doi", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}")
    stats = F.struct(*[size(c) for c in ("replications", "reproductions", "originals", "references")]).alias("stats")
    return out.select(F.lit(1).alias("v"), "doi", "title", "notice", stats, "replications", "reproductions", "originals", "references", "discussion")


def panel_fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fingerprint): a hash of all of a key's rows as sorted JSON texts, so the same for the same rows in any order."""
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "|"), 256).alias("fingerprint"))


def changed_panels(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Keys whose fingerprint is new or differs."""
    return now.join(before.select(key, "fingerprint"), [key, "fingerprint"], "left_anti")


def layer_yield(page_dois: DataFrame) -> DataFrame:
    """(layer, dois): how many DOIs each layer newly adds, from rows that hold a DOI's first layer."""
    return page_dois.groupBy("layer").agg(F.count("*").alias("dois"))
