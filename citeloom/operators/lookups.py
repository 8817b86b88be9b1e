"""Keyed lookups against snapshot tables.

Snapshots are reduced to one row a key before a join, so a famous DOI on the
other side never multiplies rows, and Spark may broadcast a snapshot when its
statistics allow it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import doi as D
from ..functions import text as T
from ..functions.web import host_of


def handle_state(status: Column, code: Column) -> Column:
    """true, false or unknown: 404 denies, 200 tells by its code, anything else is a passing failure."""
    return F.when(status == 404, F.lit(False)).when(status == 200, F.coalesce(code == 1, F.lit(False)))


def validate_dois(df: DataFrame, handles: DataFrame) -> DataFrame:
    """``df`` with ``valid``: true, false, or null where nothing is known."""
    state = handles.groupBy("doi").agg(F.bool_or(handle_state(F.col("http_status"), F.col("response_code"))).alias("valid"))
    return df.join(state, "doi", "left").select(*df.columns, "valid")


def keep_not_invalid(df: DataFrame) -> DataFrame:
    """Lenient: unknown DOIs stay."""
    return df.where(~F.col("valid").eqNullSafe(False))


def keep_valid(df: DataFrame) -> DataFrame:
    """Strict: only confirmed DOIs stay."""
    return df.where("valid")


def folded_notices(notices: DataFrame) -> DataFrame:
    """Notices (origin_doi, notice_doi, kind, pos) by lower-case DOI: the last raw key of a kind wins, and retraction beats concern."""
    pos = F.col("pos") if "pos" in notices.columns else F.col("origin_doi")
    per = notices.groupBy(F.lower("origin_doi").alias("doi"), "kind").agg(F.max_by("notice_doi", pos).alias("notice_doi"))
    order = F.when(F.col("kind") == "retraction", 0).otherwise(1)
    return per.groupBy("doi").agg(F.min_by(F.struct("kind", "notice_doi"), order).alias("n")).select("doi", F.col("n.kind").alias("kind"), F.col("n.notice_doi").alias("notice_doi"))


def notice_lookup(df: DataFrame, notices: DataFrame) -> DataFrame:
    """Rows of ``df`` whose DOI has a notice, with its kind and link.

    The notices, one row a DOI, are hashed by partition and the rows pass by them; sorting the rows would hold all of a task's.
    """
    return df.join(folded_notices(notices).hint("shuffle_hash"), "doi").select(*df.columns, "kind", "notice_doi")


def evidence_lookup(df: DataFrame, evidence: DataFrame) -> DataFrame:
    """``df`` with the evidence record's columns and ``status`` matched or no-match."""
    cols = [c for c in evidence.columns if c != "doi"]
    one = evidence.groupBy(F.lower("doi").alias("doi")).agg(F.max(F.struct(*cols)).alias("r"))
    joined = df.join(one, "doi", "left")
    return joined.select(*df.columns, *[F.col(f"r.{c}").alias(c) for c in cols], F.when(F.col("r").isNotNull(), "matched").otherwise("no-match").alias("status"))


def pmc_lookup(df: DataFrame, pmc_ids: DataFrame) -> DataFrame:
    """(pmcid, doi, state) of each distinct id: resolved, missing (a known miss) or unknown (ask again)."""
    ids = df.select(D.normalise_pmcid(F.col("pmcid")).alias("pmcid")).where("pmcid IS NOT NULL").distinct()
    doi = F.when(F.coalesce(F.col("status") != "error", F.lit(True)), D.normalise_doi(F.col("doi")))
    known = pmc_ids.select(D.normalise_pmcid(F.col("pmcid")).alias("pmcid"), doi.alias("doi")).groupBy("pmcid").agg(F.max("doi").alias("doi"), F.lit(True).alias("seen"))
    state = F.when(F.col("doi").isNotNull(), "resolved").when(F.col("seen"), "missing").otherwise("unknown")
    return ids.join(known, "pmcid", "left").select("pmcid", "doi", state.alias("state"))


def feedback_lookup(df: DataFrame, feedback: DataFrame) -> DataFrame:
    """Rows of ``df`` with discussion; of several records of a DOI the last (by ``pos``) wins, of those at one place the greatest as a text."""
    cols = [c for c in feedback.columns if c not in ("doi", "pos")]
    order = F.struct(F.col("pos") if "pos" in feedback.columns else F.lit(0), F.to_json(F.struct(*cols)))
    one = feedback.groupBy(F.lower("doi").alias("doi")).agg(F.max_by(F.struct(*cols), order).alias("r"))
    return df.join(one, "doi").select(*df.columns, *[F.col(f"r.{c}").alias(c) for c in cols])


#: Labels of the versions that open-access records name, fixed values.
VERSIONS = {"publishedVersion": "published", "acceptedVersion": "accepted", "submittedVersion": "submitted"}


def _location(raw: Column) -> Column:
    url = F.coalesce(F.nullif(raw["url_for_pdf"], F.lit("")), F.nullif(raw["url"], F.lit("")))
    institution = F.nullif(F.trim(raw["repository_institution"]), F.lit(""))
    label = F.coalesce(institution, F.when(raw["host_type"] == "publisher", "Publisher"), host_of(url), F.lit("Free copy"))
    names = F.create_map(*[F.lit(x) for kv in VERSIONS.items() for x in kv])
    is_pdf = F.coalesce(raw["url_for_pdf"] != "", F.lit(False))
    return F.when(url.isNotNull(), F.struct(url.alias("url"), label.alias("label"), F.try_element_at(names, raw["version"]).alias("version"), is_pdf.alias("is_pdf")))


def oa_status(df: DataFrame, unpaywall: DataFrame) -> DataFrame:
    """``df`` with is_oa, url and locations: the best copy first, one row an address.

    Of several records of a DOI an open one counts, of these the greatest as a text.
    """
    every = F.concat(F.array("best_oa_location"), F.coalesce("oa_locations", F.array().cast("array<struct<url:string,url_for_pdf:string,host_type:string,version:string,repository_institution:string>>")))
    found = F.filter(F.transform(every, _location), lambda x: x.isNotNull())
    once = F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["url"]), x["url"]) == i + 1)
    each = unpaywall.select(F.lower("doi").alias("doi"), F.struct("is_oa", once.alias("locations")).alias("r"))
    rows = each.groupBy("doi").agg(F.max_by("r", F.struct(F.coalesce("r.is_oa", F.lit(False)), F.to_json("r"))).alias("r")).select("doi", "r.*")
    url = F.get("locations", F.lit(0))["url"]
    return df.join(rows, "doi", "left").select(*df.columns, F.coalesce(F.col("is_oa") & url.isNotNull(), F.lit(False)).alias("is_oa"), url.alias("url"), "locations")


def title_by_doi(df: DataFrame, first: DataFrame, second: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """``df`` with a title: the discussion's, else the first works table's, else the second's, else the DOI itself."""
    one = lambda t, name: t.where("title IS NOT NULL").groupBy("doi").agg(F.min("title").alias(name))
    out = df.join(one(first, "t1"), "doi", "left").join(one(second, "t2"), "doi", "left")
    out = out.join(one(feedback, "t0"), "doi", "left") if feedback is not None else out.withColumn("t0", F.lit(None).cast("string"))
    return out.select(*df.columns, F.coalesce("t0", "t1", "t2", "doi").alias("title"))


#: Citation formats; an unknown one is rendered as the first.
FORMATS = ("apa", "mla", "chicago", "harvard", "vancouver", "ieee", "bibtex", "ris")


def citation_by_format(df: DataFrame, rendered: DataFrame) -> DataFrame:
    """``df`` (doi, format) with the tidy citation and its markup; the registry's rendering, else the resolver's; null if nothing is left."""
    fmt = F.when(F.lower("format").isin(*FORMATS), F.lower("format")).otherwise(FORMATS[0])
    asked = df.withColumn("fmt", fmt)
    # dealt out before the texts are made, as a small file is few tasks; by DOI, as the grouping needs it
    rendered = rendered.repartition(int(rendered.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doi")
    text = F.nullif(T.tidy_citation(F.col("raw"), F.col("format")), F.lit(""))
    ready = rendered.select("doi", F.lower("format").alias("fmt"), "provider", text.alias("citation"), T.tidy_citation_html(F.col("raw"), F.col("format")).alias("html")).where("citation IS NOT NULL")
    rank = F.when(F.col("provider") == "crossref", 0).otherwise(1)
    best = ready.groupBy("doi", "fmt").agg(F.min_by(F.struct("citation", "html"), F.struct(rank, "provider")).alias("c"))
    return asked.join(best, ["doi", "fmt"], "left").select(*df.columns, F.col("c.citation").alias("citation"), F.col("c.html").alias("html"))
