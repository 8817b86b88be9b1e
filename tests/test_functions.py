"""Worked examples for the Column expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from citeloom.functions import doi as D
from citeloom.functions import text as T
from citeloom.functions import web as U


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_normalise_doi(spark):
    given = {
        "10.1234/Abc": "10.1234/abc", "https://doi.org/10.1234/ABC": "10.1234/abc", "http://dx.doi.org/10.5555/x": "10.5555/x", "DOI:10.1000/1": "10.1000/1",
        "  10.1234/a ": "10.1234/a", "10.1088%2F0960-1317%2F16%2F3%2F007": "10.1088/0960-1317/16/3/007", "10.1234/%zz": "10.1234/%zz", "10.1234/a+b%20c": "10.1234/a+b c",
        "10.12/ab": None, "abc": None, "": None, "10.1234": "10.1234", "https://doi.org/10.1234/a?x=1": "10.1234/a?x=1", "https://example.org/10.1234/a": None,
    }
    assert apply(spark, D.normalise_doi, [*given, None]) == [*given.values(), None]


def test_clean_doi_trailing(spark):
    given = {
        "10.1234/ab.": "10.1234/ab", "10.1234/ab).": "10.1234/ab", "10.1234/a(b)c": "10.1234/a(b)c", "10.1234/a(4)": "10.1234/a", "10.1234/a(b)(c);.": "10.1234/a",
        "10.1234/a)b(c)": "10.1234/a", "10.1234/(ab": "10.1234/(ab",
    }
    assert apply(spark, D.clean_doi_trailing, list(given)) == list(given.values())


def test_found_dois(spark):
    given = {
        "See 10.1234/one, 10.1234/TWO; and (doi:10.1234/three).": ["10.1234/one", "10.1234/two", "10.1234/three"],
        "https://x.org/doi/10.1234/abc/full": ["10.1234/abc"], "https://x.org/10.1234/abc/full/7": ["10.1234/abc"], "10.1234/16/3/007": ["10.1234/16/3/007"],
        "10.1016/j": [], "none here": [], "10.1234/ab 10.1234/AB": ["10.1234/ab"], "10.1234%2Fab%2Fc1 x": ["10.1234/ab/c1"], "10.12​34/a­bc": ["10.1234/abc"],
        "10.1001/jama.2020.1﻿PubMed": ["10.1001/jama.2020.1"], "10.1234/ab c": ["10.1234/ab"], "": [],
    }
    assert apply(spark, D.found_dois, list(given)) == list(given.values())
    old = "10.1002/(SICI)1097-0266(199704)18:4<303::AID-SMJ869>3.0.CO;2-G"
    assert apply(spark, lambda c: D.found_dois(c, D.DOI_TEXT_PATTERN), [old]) == [[old.lower()]]


def test_doi_from_href(spark):
    given = {
        "https://doi.org/10.1234/ab": "10.1234/ab", "https://x.org/a?DOI=10.1234%2Fab": "10.1234/ab", "https://x.org/a?identifierName=doi&identifierValue=10.1234/ab": "10.1234/ab",
        "https://x.org/a?identifier_name=DOI&identifier_value=10.1234/ab": "10.1234/ab", "https://x.org/doi/10.1234/ab.c?x=1": "10.1234/ab.c", "https://x.org/10.1234/a": None,
        "https://x.org/": None, "https://x.org/%E0%A4%A/10.1234/abc": None,
    }
    assert apply(spark, D.doi_from_href, [*given, None]) == [*given.values(), None]


def test_pmc_ids(spark):
    assert apply(spark, D.normalise_pmcid, [" pmc123 ", "PMC12", "PMC1234567890", "x", None]) == ["PMC123", None, None, None, None]
    pick = lambda c: D.pmcid_from_text_or_href(c, F.array(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC777/")))
    assert apply(spark, pick, ["PMCID: PMC 3741663.", "nothing"]) == ["PMC3741663", "PMC777"]


def test_small_doi_functions(spark):
    assert apply(spark, D.is_valid_doi_suffix, ["10.1/ab", "10.1/a", "10.1"]) == [True, False, False]
    assert apply(spark, D.is_real_doi, ["10.1/a", "", "Unavailable", None]) == [True, False, False, False]
    probe = lambda c: D.contains_doi_candidate(c, F.array(F.lit("https://x.org/10.1")))
    assert apply(spark, probe, [None]) == [True]
    assert apply(spark, lambda c: D.contains_doi_candidate(c, F.array().cast("array<string>")), ["10.1234", "x 10.1234/abcd", None]) == [False, True, False]


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("Same Title", "same title!", 100), ("the effect", "the effect of sleep", 100), ("", "", 100), ("abc", "xyz", 0), ("abc d", "", 100)],
)
def test_token_set_ratio(spark, a, b, score):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(T.token_set_ratio(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(score)


def plain_ratio(a, b):
    import re

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return row[-1]

    norm = lambda s: set(re.sub(r"[^a-z0-9_]+", " ", s.lower()).split())
    x, y = norm(a), norm(b)
    both = " ".join(sorted(x & y))
    one, two = (" ".join([both, *sorted(d)]).strip() for d in (x - y, y - x))
    like = lambda p, q: 1.0 if not max(len(p), len(q)) else (max(len(p), len(q)) - distance(p, q)) / max(len(p), len(q))
    return 100 * max(like(both, one), like(both, two), like(one, two))


def test_token_set_ratio_agrees_with_definition(spark):
    titles = ["sleep and memory", "memory and sleep in rats", "a study of sleep", "completely other", "sleep-and memory: review", "x", "a b c d e", "e d c b"]
    pairs = [(a, b) for a in titles for b in titles]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r.r == pytest.approx(plain_ratio(r.a, r.b)), (r.a, r.b)


def test_names_and_bylines(spark):
    assert apply(spark, T.author_surname, ["Ana María Núñez", "J. R. R. Tolkien", "A.", "", None, "Smith-Jones"]) == ["nunez", "tolkien", "", "", "", "smith-jones"]
    got = apply(spark, T.byline_metadata, ["MD Wilkinson, M Dumontier… - Scientific data, 2016 - nature.com", "", "Ö Müller - J, 12016"])
    assert [(r.first_author, r.year) for r in got] == [("Wilkinson", 2016), (None, None), ("Müller", None)]


def test_citations(spark):
    apa = lambda c: T.tidy_citation(c, F.lit("apa"))
    assert apply(spark, apa, ["[1] A. <i>B</i> &amp; C.", "12. X  y", "T. edited by , P.", "&amp;lt;"]) == ["A. B & C.", "X y", "T. P.", "&lt;"]
    assert apply(spark, lambda c: T.tidy_citation(c, F.lit("bibtex")), [" @a{x,\n  y} "]) == ["@a{x,\n  y}"]
    html = lambda c: T.tidy_citation_html(c, F.lit("mla"))
    assert apply(spark, html, ["1. <I class='a'>x</I> <div>y</div><sub>2</sub><ins>z</ins>"]) == ["<I>x</I> y<sub>2</sub>z"]
    assert apply(spark, lambda c: T.tidy_citation_html(c, F.lit("ris")), ["x"]) == [None]


def test_years_dates_outcomes(spark):
    records = ['{"issued":{"date-parts":[[2019,1]]}}', '{"published-print":{"date-parts":[[2018]]}}', '{"issued":{"date-parts":[[null]]},"published":{"date-parts":[[2018]]}}', "{}"]
    assert apply(spark, T.works_year, records) == [2019, 2018, None, None]
    assert apply(spark, T.parse_notice_date, ["8/1/2020 0:00", "12/31/1999  23:59", "bad"]) == [dt.datetime(2020, 8, 1), dt.datetime(1999, 12, 31, 23, 59), None]
    assert apply(spark, T.outcome_class, ["Not replicated", "yes", "Failed", "no", "unclear", None]) == ["success", "success", "failure", "failure", "mixed", None]
    assert apply(spark, T.parse_year, ["in 1999.", "1850", "x2001y", None]) == [1999, None, None, None]


def test_hosts_and_reference_text(spark):
    assert apply(spark, U.host_of, ["https://www.A.org/x", "nonsense"]) == ["a.org", None]
    assert apply(spark, U.host_suffixes, ["a.b.org"]) == [["a.b.org", "b.org", "org"]]
    assert apply(spark, lambda c: U.host_matches(c, F.lit("b.org")), ["a.b.org", "b.org", "ab.org"]) == [True, True, False]
    assert apply(spark, T.clean_reference_text, ["S. T. 2001. CrossRef | PubMed, Google Scholar.", "Web of Science", "A PDFs"]) == ["S. T. 2001.", "Web of Science", "A PDFs"]


def test_editor_phrases_without_a_name(spark):
    plain = lambda c: T.tidy_citation(c, F.lit("apa"))
    given = ["A title. edited by , Press", "A title, edited by , Press", "A title edited by , Press", "A title edited by . Press", "A title. , ed. Press", "A title, edited by B. Lee, Press"]
    want = ["A title. Press", "A title, Press", "A title, Press", "A title Press", "A title. Press", "A title, edited by B. Lee, Press"]
    assert apply(spark, plain, given) == want
    assert apply(spark, lambda c: T.tidy_citation_html(c, F.lit("mla")), ["<span> </span>", "[3] <p></p>", "<b class='x'>a</b>"]) == [None, None, "<b>a</b>"]


def test_a_citation_is_computed_once(spark):
    """Each step names its text many times; the expression still holds the text it begins with once."""
    raw = F.concat(F.lit("[7] "), F.col("raw"))
    df = spark.createDataFrame([("A &amp; B, edited by , Press.",)], "raw string").select(T.tidy_citation(raw, F.lit("apa")).alias("x"))
    assert df.first()["x"] == "A & B, Press."
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("concat([7] , raw") == 1
