"""Small worked cases for the operators."""

import datetime as dt
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from citeloom.operators import caches, lookups, notices, pages, reports, resolve, windows
from citeloom.sources import readers, writers

PAGE = """<html><head><title>Doc title</title>
<meta name="citation_doi" content="doi:10.1234/Own"><meta name="DC.identifier" content="10.1234/second"><meta name="citation_author" content="Lee, Kim">
<script type="application/ld+json">[{"@id": "https://doi.org/10.1234/ld"}, {"doi": "10.1234/ld2", "datePublished": "2017-05-01"}]</script>
<script type="application/ld+json">{broken</script></head>
<body><h1>Head &amp; line</h1><script>var x = "10.9999/script"</script><p>Text cites 10.5555/body1.</p>
<p><a href="https://doi.org/10.6666/linked">10.6666/linked</a> <a href="https://x.org/doi/10.7777/inner">view</a></p>
<div id="references"><ol><li>One, A. Title of one. 1999. doi:10.4444/ref1 <ul><li>CrossRef</li></ul></li>
<li>Two, B. Title of two. 2000. <a href="https://doi.org/10.1234/url.1">Cite</a> <a href="https://doi.org/10.4444/ref2">CrossRef</a></li><li>Three, C. Title. PMCID: PMC123456</li></ol></div></body></html>"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(1, "https://www.x.org/article/10.1234/url.1", PAGE), (2, "https://y.org/toc/3", None), (3, "https://z.org/a", "<p>plain</p>")]
    return pages.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()


def test_layers_and_classes(parsed):
    rows = {(r.doi, r.layer) for r in pages.extract_page_dois(parsed).collect()}
    assert {d for d, l in rows if l == "meta"} == {"10.1234/own", "10.1234/second"}
    assert {d for d, l in rows if l == "jsonld"} == {"10.1234/ld", "10.1234/ld2"}
    assert ("10.1234/url.1", "url") in rows and ("10.5555/body1", "text") in rows and not any("script" in d for d, _ in rows)
    assert {r.page_id: r.primary_doi for r in pages.primary_doi(parsed).collect()} == {1: "10.1234/url.1", 2: None, 3: None}
    got = {r.page_id: r for r in pages.classify_page_dois(parsed).collect()}
    assert [got[k].page_type for k in (1, 2, 3)] == ["article", "listing", "unknown"]
    assert set(got[1].reference) == {"10.4444/ref1", "10.4444/ref2"}
    assert set(got[1].other) == {"10.5555/body1", "10.6666/linked"}


def test_occurrences_and_references(parsed):
    kinds = {(r.doi, r.kind) for r in pages.doi_occurrences(parsed).collect()}
    assert {("10.6666/linked", "link-text"), ("10.7777/inner", "link-embedded"), ("10.5555/body1", "text"), ("10.4444/ref2", "link-doi-org")} <= kinds
    assert ("10.6666/linked", "link-doi-org") not in kinds
    got = [(r.doi, r.doi_in_text, r.pmcid) for r in pages.reference_entries(parsed).orderBy("pos").collect()]
    assert got == [("10.4444/ref1", True, None), ("10.4444/ref2", False, None), (None, False, "PMC123456")]


def test_heading_references(spark):
    html = "<h2>1. References</h2><p>Aa, A. Some long enough title. 2001.</p><p>Bb, B. Another title. 2002.</p><h2>Next</h2><p>no</p>"
    p = pages.parse_pages(spark.createDataFrame([(1, "https://x.org", html)], "page_id long, url string, html string"))
    assert pages.reference_entries(p).count() == 2


def test_page_metadata(parsed):
    meta = {r.page_id: (r.first_author, r.year) for r in pages.page_metadata(parsed).collect()}
    assert meta == {1: ("Lee, Kim", 2017), 2: (None, None), 3: (None, None)}
    assert {r.page_id: r.title for r in pages.page_title(parsed).collect()}[1] == "Head & line"
    assert [r[0] for r in parsed.orderBy("page_id").select(pages.is_scholarly_page(F.col("metas"))).collect()] == [True, False, False]


def test_bot_checks_and_domains(spark):
    rows = [(1, "https://a.org", "<div id='challenge-form'></div>"), (2, "https://b.org", "<title>Just a moment</title><script src='/cdn-cgi/challenge-platform/x.js'></script>"), (3, "https://sub.c.org", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r.page_id for r in pages.drop_bot_checks(pages.parse_pages(df)).collect()] == [3]
    kept = pages.drop_blocked_domains(df, spark.createDataFrame([("c.org",)], "domain string"))
    assert sorted(r.page_id for r in kept.collect()) == [1, 2]


def test_reduce_notices(spark):
    t = dt.datetime
    rows = [
        (1, "10.1/a", "Retraction", t(2020, 1, 1), "10.9/n1"), (2, "10.1/a", "Reinstatement", t(2021, 1, 1), "10.9/n2"),
        (3, "10.1/b", "Retraction", t(2020, 1, 1), "unavailable"), (4, "10.1/b", "Retraction", t(2019, 1, 1), "10.9/n4"), (5, "10.1/b", "Expression of concern", t(2020, 1, 1), "10.9/n5"),
        (6, "10.1/c", "Retraction", None, ""), (7, "unavailable", "Retraction", None, "10.9/x"), (8, "10.1/d", "Correction", t(2022, 1, 1), "10.9/x"),
        (9, "10.1/e", "Expression of concern", None, "10.9/n9"), (10, "10.1/E", "Retraction", None, "10.9/n10"),
    ]
    n = notices.reduce_notices(spark.createDataFrame(rows, "seq long, original_doi string, nature string, event_time timestamp, notice_doi string"))
    assert {(r.origin_doi, r.kind, r.notice_doi) for r in n.collect()} == {("10.1/b", "retraction", "10.9/n4"), ("10.1/e", "concern", "10.9/n9"), ("10.1/E", "retraction", "10.9/n10")}
    found = lookups.notice_lookup(spark.createDataFrame([("10.1/e",), ("10.1/a",)], "doi string"), n).collect()
    assert [(r.doi, r.kind) for r in found] == [("10.1/e", "retraction")]


WORKS = "doi string, title string, first_author string, year int, urls array<string>, source string"
ASK = "request_id long, title string, first_author string, year int, source_url string"


def test_augment_dois(spark):
    works = spark.createDataFrame([
        ("10.1/a", "Sleep and memory in young adults", "Lee", 2001, ["https://a.org/x"], "crossref"), ("10.1/b", "Sleep and memory in young adults", "Kim", 2010, ["https://b.org/x"], "crossref"),
        ("10.1/c", "An unrelated paper on glaciers", None, None, None, "openalex"), ("10.1/c", "An unrelated paper on glaciers", "Fox", 1999, ["https://c.org"], "crossref"),
    ], WORKS)
    asks = spark.createDataFrame([
        (1, "sleep and memory in young adults", None, None, None), (2, "Sleep AND memory, in young adults", "X. Lee", None, None), (3, "unrelated paper on glaciers", None, None, None),
        (4, "nothing like it", None, None, None), (5, None, None, None, None),
    ], ASK)
    got = {r.request_id: r.doi for r in resolve.augment_dois(asks, works).collect()}
    assert got == {1: None, 2: None, 3: "10.1/c", 4: None, 5: None}  # 1 decides for 2: they share a title
    for extra, doi in (((2, None, None), None), (("Kim", None, None), "10.1/b"), ((None, 2002, None), "10.1/a"), ((None, None, "https://www.b.org/z"), "10.1/b")):
        if extra[0] == 2:
            continue
        one = spark.createDataFrame([(1, "Sleep and memory in young adults", *extra)], ASK)
        assert resolve.augment_dois(one, works).first().doi == doi


def test_resolve_references(spark):
    works = spark.createDataFrame([("10.1/a", "sleep and memory in young adults", None, None, None, "crossref"), ("10.1/z", "a wholly different thing", None, None, None, "crossref")], WORKS)
    entries = spark.createDataFrame([
        (1, 0, "Sleep and memory in young adults 2001", None, False, None), (1, 1, "short", None, False, None), (1, 2, "Some linked reference", "10.2/h", False, None),
        (1, 3, "Shown reference text", "10.2/s", True, None), (1, 4, "Kept by PMC id only", None, False, "PMC1"), (1, 5, "no year at all in this one", None, False, None), (1, 6, "A wholly different thing 1999", None, False, None),
    ], "page_id long, pos int, text string, doi string, doi_in_text boolean, pmcid string")
    pmc = spark.createDataFrame([("PMC1", "10.3/p")], "pmcid string, doi string")
    handles = spark.createDataFrame([("10.1/z", 404, None)], "doi string, http_status int, response_code int")
    got = {(r.pos, r.doi, r.mode) for r in resolve.resolve_references(entries, works, pmc, handles).collect()}
    assert got == {(0, "10.1/a", "augment"), (2, "10.2/h", "hidden"), (4, "10.3/p", "pmc")}
    assert (3, "10.2/s", "hidden") in {(r.pos, r.doi, r.mode) for r in resolve.resolve_references(entries, works, pmc, handles, show_all=True).collect()}


def test_handles_are_three_valued(spark):
    h = spark.createDataFrame([("a", 404, None), ("b", 200, 1), ("c", 200, 100), ("d", 429, None)], "doi string, http_status int, response_code int")
    df = lookups.validate_dois(spark.createDataFrame([(x,) for x in "abcde"], "doi string"), h)
    assert {r.doi: r.valid for r in df.collect()} == {"a": False, "b": True, "c": False, "d": None, "e": None}
    assert sorted(r.doi for r in lookups.keep_not_invalid(df).collect()) == ["b", "d", "e"]
    assert [r.doi for r in lookups.keep_valid(df).collect()] == ["b"]


def test_caches(spark):
    t = dt.datetime
    cache = spark.createDataFrame([("a", "1", t(2024, 1, 1)), ("b", None, t(2024, 1, 9)), ("c", "3", t(2023, 1, 1))], "key string, value string, written_at timestamp")
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "key string")
    got = {r.key: r.state for r in caches.split_cached(asked, cache, dt.timedelta(days=9), t(2024, 1, 10)).collect()}
    assert got == {"a": "hit", "b": "miss", "c": "fetch", "d": "fetch"}
    up = spark.createDataFrame([("a", "9", t(2024, 1, 2), False), ("c", "x", t(2024, 1, 2), True), ("e", None, t(2024, 1, 2), False)], "key string, value string, written_at timestamp, failed boolean")
    assert {r.key: r.value for r in caches.upsert_cache(cache, up, keep_misses=False).collect()} == {"a": "9", "b": None, "c": "3"}


@pytest.mark.parametrize(("quota", "kept"), [(0, "abcd"), (41, "abcd"), (40, "bcd"), (31, "bcd"), (30, "bd"), (20, "b"), (1, "")])
def test_evict(spark, quota, kept):
    """d lives on after c although it is older than b: a has expired, c has no date."""
    t = dt.datetime
    rows = [("a", 10, t(2024, 1, 5), t(2024, 1, 6)), ("b", 10, t(2024, 1, 4), None), ("c", 10, None, None), ("d", 10, t(2024, 1, 3), None)]
    df = spark.createDataFrame(rows, "key string, bytes long, created_at timestamp, expires_at timestamp")
    assert "".join(sorted(r.key for r in caches.evict_to_quota(df, quota, t(2024, 1, 10)).collect())) == kept


def test_evict_of_one_age(spark):
    """Many rows without a date, of one second, of one instant: as a walk over all rows in order has it."""
    t = dt.datetime
    when = [None] * 20 + [t(2024, 1, 3, 5, 0, 0, k % 3) for k in range(20)] + [t(2024, 1, 3, 5, k) for k in range(10)]
    rows = [(f"https://x.org/{k * 7919 % 101:03d}" if k else None, 1 + k % 4, w, None) for k, w in enumerate(when)]
    df = spark.createDataFrame(rows, "key string, bytes long, created_at timestamp, expires_at timestamp")
    total = sum(r[1] for r in rows)
    for quota in (total - 17, 40):
        gone, want = 0, set()
        for key, size, *_ in sorted(rows, key=lambda r: (r[2] or t.min, r[0] or "")):
            if gone > total - quota:
                want.add(key)
            gone += size
        assert {r.key for r in caches.evict_to_quota(df, quota, t(2024, 1, 10)).collect()} == want


def test_reports_reject_what_is_not_theirs(spark, tmp_path):
    lines = ['{"v":1,"title":"ok","doi":"d"}', '{"v":2,"title":"x"}', '{"v":1,"title":7}', "{broken", "null"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.title for r in writers.parse_reports(df, "title string, doi string").collect()] == ["ok"]
    one = spark.createDataFrame([("t", "d")], "title string, doi string")
    writers.write_reports(one, str(tmp_path / "r"))
    assert writers.read_reports(spark, str(tmp_path / "r"), "title string, doi string").collect()[0].doi == "d"


def test_notice_csv_and_replacing_write(spark, tmp_path):
    p = tmp_path / "n.csv"
    p.write_text('Title,RetractionNature,RetractionDate,RetractionDOI,OriginalPaperDOI\r\n"a ""q"", b\nc",Retraction,8/1/2020 0:00,10.9/n,10.1/a\r\n')
    r = readers.read_notice_csv(spark, str(p)).collect()
    assert [(x.original_doi, x.nature, x.event_time) for x in r] == [("10.1/a", "Retraction", dt.datetime(2020, 8, 1))]
    (tmp_path / "bad.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="RetractionNature"):
        readers.read_notice_csv(spark, str(tmp_path / "bad.csv"))
    n = spark.createDataFrame([("10.1/a", "10.9/n", "retraction")], "origin_doi string, notice_doi string, kind string")
    for _ in range(2):
        writers.write_notices(n, str(tmp_path / "out"))
    assert writers.read_notices(spark, str(tmp_path / "out")).count() == 1


def test_evidence_json(spark, tmp_path):
    stats = '{"stats":{"n_replications_total":1,"n_reproductions_total":0,"n_originals_total":2},"replications":[{"title":"r","year":2001}]}'
    (tmp_path / "e.json").write_text('{"results":{"10.1/A":{"title":"t","authors":"Lee","record":%s},"10.1/b":null,"10.1/c":{"title":"x"}}}' % stats)
    good, counts = readers.read_evidence_json(spark, str(tmp_path / "e.json"))
    row = good.collect()[0]
    assert (row.doi, row.authors[0].family, row.stats.n_originals_total, row.replications[0].year) == ("10.1/a", "Lee", 2, 2001)
    assert counts.first().asDict() == {"records": 1, "malformed": 1}


def test_windows(spark):
    e = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 2, "a"), (1, 3, 3, "b"), (1, 4, 4, None), (2, 1, 5, "a")], "tab int, ts int, seq int, url string")
    assert [r.visit for r in windows.page_sessions(e).orderBy("seq").collect()] == [1, 1, 2, 3, 1]
    logs = spark.createDataFrame([("s", i, "i", "m" * 5) for i in range(5)], "source string, t int, level string, msg string")
    got = windows.latest_log_entries(logs, 2, 3).orderBy("place").collect()
    assert [(r.t, r.msg, r.place, r.shown, r.total) for r in got] == [(3, "mmm", 1, 2, 5), (4, "mmm", 2, 2, 5)]


def test_fingerprint_hashes_whole_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None)], "k int, v string")
    rows = {1: '{"v":"a"}|{"v":"a"}|{"v":"b"}', 2: '{"v":null}'}
    want = {k: hashlib.sha256(x.encode()).hexdigest() for k, x in rows.items()}
    assert {r.k: r.fingerprint for r in reports.panel_fingerprint(df, "k", ["v"]).collect()} == want


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (1, None)], "k int, v string")
    b = spark.createDataFrame([(1, None), (1, "x")], "k int, v string")
    f = lambda df: reports.panel_fingerprint(df, "k", ["v"])
    assert f(a).first() == f(b).first()
    assert reports.changed_panels(f(a), f(b), "k").count() == 0


def test_feedback_and_titles(spark):
    fb = spark.createDataFrame([(1, 0, "a", 3, "https://talk.org/1"), (1, 1, "b", 3, "https://talk.org/2"), (2, 0, "c", 1, "https://evil.org/x"), (3, 0, "d", 0, "https://talk.org/3")], "page_id int, pos int, doi string, total_comments int, url string")
    assert [(r.page_id, r.doi) for r in reports.primary_feedback(fb, "talk.org").collect()] == [(1, "a")]


def test_muted(spark):
    c = spark.createDataFrame([(1, " Bot "), (2, None), (3, "Ann")], "id int, commenter string")
    assert sorted(r.id for r in pages.hide_muted_commenters(c, spark.createDataFrame([("BOT",)], "name string")).collect()) == [2, 3]


def test_title_candidates_against_brute_force(spark):
    """Common words everywhere, one rare word spelt otherwise, both spellings known: every pair at the threshold is found."""
    from pyspark.sql import functions as F

    from citeloom.functions import text as T

    common = "randomised controlled trial therapy patients outcomes treatment"
    titles = [f"{common} tumour{k}x" for k in range(130)] + [f"tumor{k}x registry" for k in range(5)] + ["anemic hemoglobin tumors trial"]
    asks = [t.replace("tumour", "tumor") for t in titles[:5]] + ["anaemic haemoglobin tumours trial"]
    works = spark.createDataFrame([(f"10.1/{k}", t, None, None, None, "s") for k, t in enumerate(titles)], "doi string, title string, first_author string, year int, urls array<string>, source string")
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(asks)], "request_id int, title string")
    got = {(r.key, r.doi) for r in resolve.title_candidates(rows, works, top=1000).collect()}
    pairs = rows.select(F.col("title").alias("key")).distinct().crossJoin(works.select("doi", F.col("title").alias("norm")))
    want = {(r.key, r.doi) for r in pairs.where(T.token_set_ratio(F.col("key"), F.col("norm")) >= 88).collect()}
    assert (asks[0], "10.1/0") in want and (asks[-1], f"10.1/{len(titles) - 1}") in want
    assert got == want


def test_a_page_is_one_group_of_its_evidence(spark):
    """DOIs are told apart within a page's list, by the greatest of each count; no task groups by page and DOI."""
    rows = [(1, "b", 1, 5), (1, "b", 3, None), (1, "a", 2, 0), (1, "a", 2, 0), (1, "c", 0, None), (2, "c", None, 4), (3, "a", 0, 0)]
    out = reports.evidence_totals(spark.createDataFrame(rows, "page_id long, doi string, replications long, reproductions long"))
    assert {r.page_id: (r.replications, r.reproductions, r.n_dois, r.dois) for r in out.collect()} == {1: (5, 5, 2, ["a", "b"]), 2: (0, 4, 1, ["c"])}
    groups = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(keys" in line]
    assert groups and not any("doi" in line[line.index("keys=[") : line.index("]")] for line in groups)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_notice_summary_holds_sets_of_pages(spark):
    rows = spark.createDataFrame(
        [(1, "a", "retraction"), (1, "a", "retraction"), (1, "b", "retraction"), (1, "b", "concern"), (2, "c", "concern"), (3, "d", None), (4, None, "concern"), (4, None, "concern")],
        "page_id long, doi string, kind string",
    )
    out = reports.notice_summary(rows)
    assert sorted((r.page_id, r.retracted, r.concerns, r.headline) for r in out.collect()) == [
        (1, 2, 1, "2 retracted papers, 1 expression of concern"), (2, 0, 1, "1 expression of concern"), (3, 0, 0, ""), (4, 0, 1, "1 expression of concern"),
    ]
    assert dict(out.dtypes)["retracted"] == "bigint" and not re.search(r"Aggregate \[page_id#\w+, doi#", _plan(out))
    notice = spark.createDataFrame([("a", "n", "concern", 1)], "origin_doi string, notice_doi string, kind string, pos long")
    assert "SortMergeJoin" not in lookups.notice_lookup(rows.drop("kind"), notice)._jdf.queryExecution().executedPlan().toString()


def test_a_report_text_is_parsed_once_and_kept_by_version_and_title(spark):
    texts = ['{"v":1,"title":"a"}', '{"v":"1","title":"b"}', '{"v":1.0,"title":"c"}', '{"v":2,"title":"d"}', '{"v":1,"title":7}', '{"v":1}', '{broken', "[]", None, '{"v":1,"title":"e"} x']
    out = writers.parse_reports(spark.createDataFrame([(t,) for t in texts], "value string"), "title string")
    assert sorted(r.title for r in out.collect()) == ["a", "b", "e"]
    asked = [line for line in _plan(out).splitlines() if "Filter" in line]
    assert len(asked) == 1 and len(re.findall(r"parse_?json|get_?json_?object", asked[0], re.I)) == 1


def test_meta_report_keeps_one_list_of_entries(spark):
    papers = spark.createDataFrame([("a", "A", None), ("b", "B", None), ("c", "C", None)], "doi string, title string, notice string")
    e = "doi string, role string, pos int, title string, authors array<struct<sequence:string,given:string,family:string>>, year int, journal string, outcome string"
    rows = [("a", "original", 2, "t2", None, 2001, "J", None), ("a", "original", 1, "t1", None, 2000, None, "x"), ("a", "replication", 3, "t3", None, None, "J", None), ("b", "comment", 1, "t", None, 1, "J", None)]
    refs = spark.createDataFrame([], "doi string, pos int, ref_doi string, title string, tags array<string>")
    talk = spark.createDataFrame([], "doi string, comments long, url string")
    out = reports.meta_report(papers, spark.createDataFrame(rows, e), refs, talk)
    got = {r.doi: r for r in out.collect()}
    assert [tuple(x) for x in got["a"].originals] == [(1, "t1", "2000", "x"), (2, "t2", "2001 · J", None)]
    assert [tuple(x) for x in got["a"].replications] == [(3, "t3", "J", None)] and got["a"].reproductions == []
    assert got["b"].originals == [] and got["c"].originals is None and got["a"].stats.n_originals == 2
    assert max(line.count("collect_list(") for line in _plan(out).splitlines()) == 1
