"""Readers of the snapshot formats."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import doi as D
from ..functions import text as T
from .staging import staged

NOTICE_COLUMNS = ("RetractionNature", "RetractionDate", "RetractionDOI", "OriginalPaperDOI")


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, record): the records of quoted CSV files, headers included, numbered over all files in order.

    Files are read by splits, a line at a time. A line begins a record if an even
    number of quotes stands before it in its file. Each split counts its quotes, and
    the lines that begin a record if an even or an odd number came before the
    split; one row a split then tells where every split stands, so one large file is
    read by many tasks. Only the lines of one record come together. Blank lines
    between records are no records.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"),
        F.regexp_count("value", F.lit('"')).alias("quotes"),
    )
    inside = Window.partitionBy("file", "at").orderBy("line")
    odd = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    lines = lines.withColumn("odd", odd).withColumn("blank", F.col("value").isin("", "\r"))
    begins = [((F.col("odd") == k) & ~F.col("blank")).cast("long").alias(f"begins{k}") for k in (0, 1)]
    lines = lines.select("*", *begins)
    lines = staged(lines.select("*", *[F.sum(f"begins{k}").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"upto{k}") for k in (0, 1)]))
    splits = lines.groupBy("file", "at").agg(F.sum("quotes").alias("quotes"), *[F.sum(f"begins{k}").alias(f"begins{k}") for k in (0, 1)])
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("flip", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    own = lambda name: F.when(F.col("flip") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    order = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = splits.select("file", "at", "flip", F.coalesce(F.sum(own("begins")).over(order), F.lit(0)).alias("base"))
    lines = lines.join(splits, ["file", "at"]).withColumn("n", F.col("base") + own("upto"))
    inner = F.col("odd") != F.col("flip")
    parts = lines.where(inner | ~F.col("blank")).groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("at", "line", "value"))).alias("parts"))
    return parts.select("file", "n", F.regexp_replace(F.array_join("parts.value", "\n"), r"\r\z", "").alias("record"))


def read_notice_csv(spark: SparkSession, path: str) -> DataFrame:
    """Status events (seq, original_doi, nature, event_time, notice_doi) of quoted CSV files with a header; raises if a column is missing or headers differ.

    Quotes are doubled inside fields and fields may span lines. An empty or
    missing field is an empty text, an unparsable date null. ``seq`` follows the
    order of the files' paths and of the records within a file.
    """
    records = staged(csv_records(spark, path))
    firsts = records.groupBy("file").agg(F.min("n").alias("n"))
    headers = records.join(firsts, ["file", "n"]).select(F.regexp_replace("record", "\\A\uFEFF", "").alias("record")).distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError("the CSV files have different headers" if headers else "the CSV has no header")
    options = {"quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = [x.strip() for x in next(csv.reader([headers[0].record]))]
    if missing := [c for c in NOTICE_COLUMNS if c not in names]:
        raise ValueError(f"the CSV has no column {', '.join(missing)}")
    kept = {c: f"c{names.index(c)}" for c in NOTICE_COLUMNS}
    rows = records.join(firsts.withColumnRenamed("n", "first"), "file").where("n > first")
    rows = rows.select(F.col("n").alias("seq"), F.from_csv("record", ", ".join(f"c{k} string" for k in range(len(names))), options).alias("r"))
    field = lambda c: F.coalesce(D.trim(F.col(f"r.{kept[c]}")), F.lit(""))
    return rows.select(
        "seq", field("OriginalPaperDOI").alias("original_doi"), field("RetractionNature").alias("nature"),
        T.parse_notice_date(field("RetractionDate")).alias("event_time"), field("RetractionDOI").alias("notice_doi"),
    )


def works_from_json(lines: DataFrame, source: str) -> DataFrame:
    """(doi, title, first_author, year, urls, source) of work records in column ``value``; records without DOI or title are dropped."""
    j = lambda path: F.get_json_object("value", path)
    many = lambda path: F.coalesce(F.from_json(j(path), "array<string>"), F.array().cast("array<string>"))
    if source == "crossref":
        doi, title = j("$.DOI"), j("$.title[0]")
        author = F.coalesce(j("$.author[0].family"), j("$.author[0].name"))
        year, urls = T.works_year(F.col("value")), F.concat(F.array(j("$.URL")), many("$.link[*].URL"))
    else:
        doi, title, author = j("$.doi"), F.coalesce(j("$.title"), j("$.display_name")), j("$.authorships[0].author.display_name")
        year = j("$.publication_year").try_cast("int")
        places = F.from_json(j("$.locations"), "array<struct<landing_page_url:string,pdf_url:string>>")
        each = F.flatten(F.transform(places, lambda p: F.array(p["landing_page_url"], p["pdf_url"])))
        urls = F.concat(F.array(j("$.primary_location.landing_page_url"), j("$.primary_location.pdf_url")), F.coalesce(each, F.array().cast("array<string>")))
    distinct = F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))
    rows = lines.select(D.normalise_doi(doi).alias("doi"), F.nullif(F.trim(title), F.lit("")).alias("title"), author.alias("first_author"), year.alias("year"), distinct.alias("urls"), F.lit(source).alias("source"))
    return rows.where("doi IS NOT NULL AND title IS NOT NULL")


def read_works_json(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Works of a file of JSON lines, from ``crossref`` or ``openalex``."""
    return works_from_json(spark.read.text(path), source)


AUTHORS = "array<struct<sequence:string,given:string,family:string>>"
STATS = ("n_replications_total", "n_reproductions_total", "n_originals_total")
ENTRY = "struct<doi:string,title:string,authors:string,journal:string,year:int,outcome:string,url:string>"


def evidence_from_json(envelopes: DataFrame) -> DataFrame:
    """(doi, title, authors, journal, year, stats, replications, reproductions, originals, valid) from envelopes ``{"results": {doi: record or null}}`` in column ``value``.

    A null record is no row. A record without a title or counts is kept apart as
    ``valid`` false, and does not fail the others. One author string becomes a
    list of one. Keys are lower-cased.
    """
    results = F.from_json(F.get_json_object("value", "$.results"), "map<string,string>")
    return _evidence(envelopes.select(F.explode(results).alias("key", "record")))


def _evidence(rows: DataFrame) -> DataFrame:
    rows = rows.where("record IS NOT NULL AND record <> 'null'")
    j = lambda path: F.get_json_object("record", path)
    authors = F.when(F.substring(F.trim(j("$.authors")), 1, 1) == "[", F.from_json(j("$.authors"), AUTHORS)).otherwise(
        F.when(j("$.authors").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("sequence"), F.lit(None).cast("string").alias("given"), j("$.authors").alias("family"))))
    )
    stats = F.struct(*[j(f"$.record.stats.{k}").try_cast("long").alias(k) for k in STATS])
    lists = [F.coalesce(F.from_json(j(f"$.record.{k}"), f"array<{ENTRY}>"), F.array().cast(f"array<{ENTRY}>")).alias(k) for k in ("replications", "reproductions", "originals")]
    valid = F.try_parse_json("record").isNotNull() & j("$.record.stats").isNotNull() & (F.greatest(*[stats[k].isNull().cast("int") for k in STATS]) == 0)
    return rows.select(F.lower(F.trim("key")).alias("doi"), j("$.title").alias("title"), authors.alias("authors"), j("$.journal").alias("journal"), j("$.year").try_cast("int").alias("year"), stats.alias("stats"), *lists, F.coalesce(valid, F.lit(False)).alias("valid"))


#: What stands before the first record of an envelope, up to the brace that opens the results.
_HEAD = r'(?s)\A\s*,?\s*\{?(?:[^{}"]|"(?:[^"\\]|\\.)*+")*?"results"\s*:\s*\{'


def envelope_records(spark: SparkSession, path: str) -> DataFrame:
    """(key, record) of files that each hold ``{"results": {key: record, ...}}``, however long and on however few lines.

    Files are read by splits, a piece up to the next ``},`` at a time, which may
    also stand in a text or deeper. Each split adds up its quotes, and its braces
    for either state that it may begin in; one row a split tells every piece
    whether it begins in a text and how deep it ends. Only the pieces of one record
    come together. Records of other keys than ``results`` are left out.
    """
    lines = spark.read.option("lineSep", "},").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line")
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")  # no escapes
    lines = lines.withColumn("bare", bare).withColumn("quotes", F.regexp_count("bare", F.lit('"')))
    texts = r'(?s)"[^"]*("|\z)'
    net = lambda c: F.regexp_count(c, F.lit(r"[{\[]")) - F.regexp_count(c, F.lit(r"[}\]]"))
    lines = lines.withColumns({"d0": net(F.regexp_replace("bare", texts, "")), "d1": net(F.regexp_replace(F.concat(F.lit('"'), "bare"), texts, ""))}).drop("bare")
    inside = Window.partitionBy("file", "at").orderBy("line")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    # the brace of the separator closes something unless it stands in a text
    step = lambda flip: F.when((F.col("odd") + flip) % 2 == 0, F.col("d0")).otherwise(F.col("d1")) - (1 - (F.col("odd") + F.col("quotes") + flip) % 2)
    lines = lines.withColumns({f"step{k}": step(k) for k in (0, 1)})
    lines = staged(lines.withColumns({f"deep{k}": F.sum(f"step{k}").over(upto) for k in (0, 1)}))
    splits = lines.groupBy("file", "at").agg(F.sum("quotes").alias("quotes"), F.sum("step0").alias("step0"), F.sum("step1").alias("step1"))
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("flip", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    own = lambda name: F.when(F.col("flip") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    splits = splits.select("file", "at", "flip", F.coalesce(F.sum(own("step")).over(earlier), F.lit(0)).alias("base"))
    lines = lines.join(splits, ["file", "at"])
    outside = (F.col("odd") + F.col("quotes") + F.col("flip")) % 2 == 0
    depth = F.col("base") + own("deep")
    ends = {"record": (outside & (depth <= 2)).cast("long"), "part": (outside & (depth <= 1)).cast("long")}
    lines = staged(lines.withColumns(ends).select("file", "at", "line", "value", *ends))
    counts = lines.groupBy("file", "at").agg(*[F.sum(c).alias(f"all_{c}") for c in ends])
    counts = counts.select("file", "at", *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"from_{c}") for c in ends])
    place = {f"n_{c}": F.col(f"from_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ends}
    lines = lines.join(counts, ["file", "at"]).withColumns(place)
    pieces = lines.groupBy("file", "n_record").agg(F.min("n_part").alias("n_part"), F.array_sort(F.collect_list(F.struct("at", "line", "value"))).alias("pieces"))
    texts = staged(pieces.select("file", "n_part", "n_record", F.array_join("pieces.value", "},").alias("text")))
    # a part begins with its key
    firsts = texts.groupBy("file", "n_part").agg(F.min("n_record").alias("n_record"))
    parts = texts.join(firsts, ["file", "n_part", "n_record"]).where(F.col("text").rlike(_HEAD)).select("file", "n_part", F.col("n_record").alias("first"))
    rows = texts.join(parts, ["file", "n_part"])
    text = F.when(F.col("n_record") == F.col("first"), F.regexp_replace("text", _HEAD, "")).otherwise(F.col("text"))
    return rows.select(F.explode(F.from_json(F.concat(F.lit("{"), text, F.lit("}}")), "map<string,string>")).alias("key", "record"))


def read_evidence_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, counts): valid records, and one row (records, malformed)."""
    rows = staged(_evidence(envelope_records(spark, path)))
    return rows.where("valid").drop("valid"), rows.agg(F.count_if("valid").alias("records"), F.count_if(~F.col("valid")).alias("malformed"))
