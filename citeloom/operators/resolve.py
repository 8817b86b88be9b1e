"""Entity resolution: titles to DOIs, references and search results to DOIs.

Works are a table (doi, title, first_author, year, urls, source); requests are
(request_id, title, first_author, year, source_url). A title that another one
holds almost whole shares one of its rarest tokens with it. Titles that are
spelled alike need share none: titles of like length are compared in blocks by
their counts of letters and digits, which an edit changes by one at most, and
only pairs whose counts allow the threshold leave a block to be scored.

Most requests need none of that: works rank by the words they share, so the
works that hold all words of a title, all but one, and so on, are read from an
index of sets of words, until there are enough of each source.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import doi as D
from ..functions import text as T
from ..functions.web import host_of
from ..sources.staging import staged
from .lookups import validate_dois

THRESHOLD = 88.0
BAND = 5.0
MERITS = {"url": 8, "year": 3, "author": 3}
TOP = 5
DEAL = 1024
BLOCK = 2048
SLACK = 1e-6
SHORT = 8  # words of a title whose sets of words are all in the index
DROPPED = 3  # words of a request that the index is asked without, at most
MIN_CITATION = 16
MAX_AUGMENTED = 30


def _set_bits(numbers: Column, words: int) -> list[Column]:
    """A set of numbers below 64 ``words`` as so many 64-bit words."""
    one = F.lit(1).cast("long")
    word = lambda k: F.aggregate(F.filter(numbers, lambda i: F.floor(i / 64) == k), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", one, i % 64)))
    return [word(k) for k in range(words)]


def _titles(rows: DataFrame, name: str) -> DataFrame:
    """(name, tokens, length, bits, mark): the length of its distinct tokens joined, its pairs of letters in a set of 256 bits and its tokens in one of 128."""
    rows = rows.withColumn("tokens", T.title_tokens(F.col(name))).withColumn("length", F.length(F.array_join("tokens", " ")))
    pairs = F.regexp_extract_all(F.col(name), F.lit("(?=([^ ]{2}))"), F.lit(1))
    hashed = lambda c, n: F.transform(c, lambda x: F.pmod(F.xxhash64(x), F.lit(n)).cast("int"))
    rows = rows.withColumns({"at": F.array_distinct(hashed(pairs, 256)), "of": hashed(F.col("tokens"), 128)})
    named = {f"bits{k}": c for k, c in enumerate(_set_bits(F.col("at"), 4))} | {f"mark{k}": c for k, c in enumerate(_set_bits(F.col("of"), 2))}
    return rows.withColumns(named).drop("at", "of")


def _share(least: Column) -> Column:
    """Whether titles ``a`` and ``b`` share so many tokens; their marks tell first that most pairs can't.

    Tokens of ``a`` that fall on one bit count as shared.
    """
    count = lambda x: sum(F.bit_count(x(k)) for k in (0, 1))
    a = lambda k: F.col(f"a.mark{k}")
    most = count(lambda k: a(k).bitwiseAND(F.col(f"b.mark{k}"))) + F.size("a.tokens") - count(a)
    return (most >= least) & (F.size(F.array_intersect("a.tokens", "b.tokens")) >= least)


def _by_rarity(rows: DataFrame, name: str, frequency: DataFrame, wanted: Column) -> DataFrame:
    """``rows`` by token, rarest first, as far as ``wanted`` says of ``n``, a token's place, and ``before``, the length up to it."""
    order = Window.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "token")
    each = rows.select("*", F.explode("tokens").alias("token")).join(frequency, "token", "left")
    each = each.withColumns({"n": F.row_number().over(order), "before": F.sum(F.length("token") + 1).over(order) - F.length("token") - 1})
    return each.where(wanted & F.col("df").isNotNull()).drop("df", "n", "before")


def _shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b)).alias("shared")


def _meet(keys: DataFrame, norms: DataFrame, possible: Column) -> DataFrame:
    """(key, norm, shared) of rows of one token that are ``possible``, with the tokens they share; a token's rows are dealt into blocks of ``DEAL`` on both sides."""
    blocks = lambda rows, name: rows.groupBy("token").agg(F.ceil(F.count("*") / DEAL).cast("long").alias(name))
    both = blocks(keys, "k_blocks").join(blocks(norms, "n_blocks"), "token")
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = keys.join(both, "token").withColumn("i", own("key", "k_blocks")).withColumn("j", every("n_blocks")).alias("a")
    b = norms.join(both, "token").withColumn("j", own("norm", "n_blocks")).withColumn("i", every("k_blocks")).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("token", "i", "j")]
    return a.join(b.hint("merge"), [*same, possible]).select("key", "norm", _shared("a.tokens", "b.tokens"))


def _within(x: str, y: str, cut: float) -> Column:
    """Whether what title ``x`` may have besides ``y`` can weigh ``cut`` of its length at most, by pairs of letters."""
    lacks = sum(F.bit_count(F.col(f"{x}.bits{k}").bitwiseAND(F.bitwise_not(f"{y}.bits{k}"))) for k in range(4))
    return lacks <= cut * F.col(f"{x}.length") + SLACK


#: Counts of letters, digits and ``_`` as 512 bits: so many bits stand for a symbol, the first of them set.
_LEVELS = np.repeat([18, 4], [26, 11])


def _counts(texts: list[str]) -> np.ndarray:
    """A row of eight 64-bit words for each normalised title."""
    code = np.frombuffer("".join(texts).encode("ascii"), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    symbol = np.where(code >= 97, code - 97, np.where(code == 95, 36, code - 22))
    seen = code != 32
    counts = np.bincount(row[seen] * 37 + symbol[seen], minlength=len(texts) * 37).reshape(-1, 37)
    level = np.concatenate([np.arange(n) for n in _LEVELS])
    return np.packbits(np.repeat(counts, _LEVELS, axis=1) > level, axis=1).view(np.uint64)


def _alike(cut: float):
    """Of two blocks (id, text), the pairs whose lengths and counts allow that ``cut`` of the longer one is edited."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ta, tb = (t.column("text").to_pylist() for t in (left, right))
        pairs: list[np.ndarray] = []
        if ta and tb:
            a, b = _counts(ta), _counts(tb)
            na, nb = (np.bitwise_count(x).sum(1).astype(np.int32) for x in (a, b))
            la, lb = (np.array([len(t) for t in x], np.int32) for x in (ta, tb))
            for i in range(0, len(ta), 128):
                common = np.zeros((len(a[i : i + 128]), len(b)), np.uint16)
                for w in range(8):
                    common += np.bitwise_count(a[i : i + 128, w, None] & b[None, :, w])
                most = cut * np.maximum(la[i : i + 128, None], lb) + SLACK
                apart = np.maximum(np.maximum(na[i : i + 128, None], nb) - common, np.abs(la[i : i + 128, None] - lb))
                pairs.append(np.argwhere(apart <= most) + [i, 0])
        at = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        ids = [t.column("id").to_numpy()[at[:, k]] if len(at) else np.zeros(0, np.int64) for k, t in enumerate((left, right))]
        return pa.table({"a": pa.array(ids[0], pa.int64()), "b": pa.array(ids[1], pa.int64())})

    return run


def spelled_alike(keys: DataFrame, titles: DataFrame, cut: float) -> DataFrame:
    """(a, b): ids of ``keys`` and ``titles`` (id, tokens, length) that may differ by ``cut`` of the longer one at most.

    Titles fall into bands of length, each as wide as an edited title may move, so
    a key meets three; the titles of a band are dealt into blocks of about
    ``BLOCK`` on both sides, and each pair of blocks is one group of two tables.
    """
    step = max(-math.log(1 - cut) * (1 + SLACK), 0.01)
    band = F.floor(F.log(F.col("length")) / step).cast("long")
    text = F.array_join("tokens", " ").alias("text")
    a = keys.select("id", text, F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    b = titles.where("length > 0").select("id", text, band.alias("band"))
    blocks = lambda rows, name: rows.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(name))
    both = blocks(a, "m").join(blocks(b, "n"), "band")
    own, every = lambda n: F.pmod(F.xxhash64("id"), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(both, "band").withColumn("i", own("m")).withColumn("j", every("n")).select("band", "i", "j", "id", "text")
    b = b.join(both, "band").withColumn("j", own("n")).withColumn("i", every("m")).select("band", "i", "j", "id", "text")
    place = ["band", "i", "j"]
    return a.groupBy(*place).cogroup(b.groupBy(*place)).applyInArrow(_alike(cut), "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` over as many tasks as a shuffle has, as a small file is few."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _held_by(right: DataFrame, top: int) -> DataFrame:
    """(norm, source, works): of each title and source, the first ``top`` works by DOI."""
    first = F.row_number().over(Window.partitionBy("norm", "source").orderBy("doi", "work"))
    works = right.withColumn("n", first).where(F.col("n") <= top)
    return works.groupBy("norm", "source").agg(F.sort_array(F.collect_list(F.struct("doi", "work", F.struct("title", "first_author", "year", "urls").alias("record")))).alias("works"))


def _set_index(titles: DataFrame, held: DataFrame, top: int) -> DataFrame:
    """(words, source, entries): of each set of words and source, the short titles that hold the set, the first ``top`` of each length by their first DOI.

    Each has a work at least, so more of one length can't be among the first ``top`` works of any request: those before them
    share as many words and differ as much in length.
    """
    first = F.row_number().over(Window.partitionBy("words", "source", "length").orderBy("doi", "id"))
    short = titles.where(F.size("tokens").between(1, SHORT)).select("id", "norm", F.array_sort("tokens").alias("tokens"))
    each = short.join(held.select("norm", "source", F.col("works")[0]["doi"].alias("doi"), F.size("works").alias("n")), "norm").withColumn("length", F.length("norm")).drop("norm")
    each = each.withColumn("mask", F.explode(F.expr("sequence(1, shiftleft(1, size(tokens)) - 1)")))
    each = each.withColumn("words", F.expr("array_join(filter(tokens, (t, i) -> shiftright(mask, i) % 2 = 1), ' ')")).drop("mask", "tokens")
    each = each.withColumn("place", first).where(F.col("place") <= top)
    return each.groupBy("words", "source").agg(F.collect_list(F.struct("length", "doi", "id", "n")).alias("entries"))


def _without(keys: DataFrame, dropped: int) -> DataFrame:
    """``keys`` with ``words``: the sets of words of each title without so many of its words."""
    rows = keys.withColumn("tokens", F.array_sort(T.title_tokens(F.col("key")))).where(F.size("tokens").between(dropped + 1, SHORT + dropped))
    rows = rows.withColumn("at", F.lit(-1)).withColumn("out", F.array().cast("array<int>"))
    for _ in range(dropped):
        rows = rows.where("at < size(tokens) - 1").withColumn("at", F.explode(F.expr("sequence(at + 1, size(tokens) - 1)"))).withColumn("out", F.array_append("out", F.col("at")))
    return rows.withColumn("words", F.expr("array_join(filter(tokens, (t, i) -> NOT array_contains(out, i)), ' ')"))


#: A title that a request met: what it shares (negative), its difference in length, its first DOI, itself, its works.
_MET = "array<struct<less:int,apart:int,doi:string,title:long,n:int>>"


def _enough(entries: str, top: int) -> Column:
    """The first of ``entries`` until they hold ``top`` works."""
    return F.expr(f"filter(slice(sort_array({entries}), 1, {top}), (e, i) -> aggregate(slice(sort_array({entries}), 1, i), 0, (s, x) -> s + x.n) < {top})")


def _first_by_words(keys: DataFrame, titles: DataFrame, held: DataFrame, top: int) -> tuple[DataFrame, DataFrame]:
    """What the index tells: (id, key, source, got), the short titles that hold the first ``top`` works, for each of the
    requests that it settles, and those others (as in ``keys``) that lack works of some source among all that share as many words.

    A source of a request is asked for until it is settled. A title that is met first without some words shares all others:
    if it shared more it would have been met before, or so many works before it that the source was settled.
    """
    index = staged(_set_index(titles, held, top))
    state = keys.select("id", "key").crossJoin(held.select("source").distinct()).withColumn("got", F.array().cast(_MET))
    settled = []
    for dropped in range(DROPPED + 1):
        met = _without(state, dropped).join(index, ["words", "source"]).withColumn("less", dropped - F.size("tokens"))
        met = met.withColumn("new", F.expr("transform(entries, e -> struct(less, abs(e.length - length(key)) AS apart, e.doi AS doi, e.id AS title, e.n AS n))").cast(_MET))
        none = F.lit(None)
        rows = state.withColumn("new", none.cast(_MET)).unionByName(met.select("id", none.cast("string").alias("key"), "source", none.cast(_MET).alias("got"), _enough("new", top).alias("new")))
        rows = rows.groupBy("id", "source").agg(F.max("key").alias("key"), F.flatten(F.collect_list("got")).alias("got"), F.array_distinct(F.flatten(F.collect_list("new"))).alias("new"))
        rows = rows.withColumn("got", F.expr("concat(got, filter(new, e -> NOT array_contains(got.title, e.title)))")).withColumn("got", _enough("got", top)).drop("new")
        state = staged(rows.withColumn("full", F.expr(f"aggregate(got, 0, (s, e) -> s + e.n) >= {top}")))
        settled.append(state.where("full").drop("full"))
        state = state.where("NOT full").drop("full")
        if state.isEmpty():
            break
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    return done.join(state.select("id").distinct(), "id", "left_anti"), keys.join(state.select("id").distinct(), "id", "left_semi")


def title_candidates(requests: DataFrame, works: DataFrame, top: int = TOP, threshold: float = THRESHOLD) -> DataFrame:
    """(key, doi, title, score, source, first_author, year, urls): the best works of each source for each distinct title.

    Works that share a token are candidates, and those that reach the threshold
    without one. They rank by shared tokens, then by the difference in length,
    then by DOI; the first ``top`` of a source are scored and those at the
    threshold kept. Titles that the index of sets of words does not settle meet
    all others: those that reach the threshold are found first, then all that
    share as many tokens with the same request. Titles are written to the shared
    folder once, and scored once however many works have them.
    """
    cut = 1 - threshold / 100
    numbered = lambda rows, name: staged(_titles(rows, name).withColumn("id", F.monotonically_increasing_id()))
    keys = numbered(_dealt(requests.select("title")).select(T.normalize_title(F.col("title")).alias("key")).where("key <> ''").distinct(), "key")
    works = _dealt(works.where("doi IS NOT NULL AND title IS NOT NULL").withColumn("work", F.monotonically_increasing_id()))
    right = staged(works.withColumn("norm", T.normalize_title(F.col("title"))))
    held = staged(_held_by(right, top))
    # titles, not works: equal titles are compared once
    titles = numbered(held.select("norm").distinct(), "norm")
    frequency = titles.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    every = lambda rows: rows.select("*", F.explode("tokens").alias("token"))
    best = Window.partitionBy("key", "source").orderBy(F.desc("shared"), F.abs(F.length("key") - F.length("norm")), "doi")
    ranked = lambda rows, works: rows.join(works, "norm").withColumn("n", F.row_number().over(best)).where(F.col("n") <= top)
    told, keys_left = _first_by_words(keys, titles, held, top)
    told = told.select("id", "key", "source", F.explode("got").alias("e")).select(F.col("id").alias("asked"), "key", "source", F.col("e.title").alias("id"), (-F.col("e.less")).alias("shared"))
    named = held.join(titles.select("id", "norm"), "norm")
    long = titles.where(F.size("tokens") > SHORT)
    if long.isEmpty():
        told = told.join(named, ["id", "source"])
    else:
        told = staged(told)
        asked = keys.join(told.groupBy(F.col("asked").alias("id")).agg(F.min("shared").alias("least")), "id")
        rivals = _by_rarity(asked, "key", frequency, F.col("n") <= F.size("tokens") - F.col("least") + 1)
        more = _meet(rivals, every(long), _share(F.col("a.least"))).distinct().join(held, "norm")
        told = told.join(named, ["id", "source"]).select(more.columns).unionByName(more).withColumn("doi", F.col("works")[0]["doi"])
        told = told.withColumn("n", F.row_number().over(best)).where(F.col("n") <= top)
    # scored by title; what is grouped is no filter, which would move below the steps of the ratio and repeat them
    apart = F.abs(F.length("key") - F.length("norm"))
    scored = T.with_token_set_ratio(told.select("key", "norm", "source", "shared", "works"), "key", "norm", "score")
    scored = scored.groupBy("key", "source").agg(F.collect_list(F.struct((-F.col("shared")).alias("less"), apart.alias("apart"), "score", "works")).alias("t"))
    each = F.expr("flatten(transform(t, x -> transform(x.works, w -> struct(x.less, x.apart, w.doi AS doi, w.work, x.score AS score, w.record AS record))))")
    found = scored.select("key", "source", F.explode(F.filter(F.slice(F.sort_array(each), 1, top), lambda x: x["score"] >= threshold)).alias("x"))
    columns = ["key", "doi", "title", "score", "source", "first_author", "year", "urls"]
    found = found.select("key", "source", "x.doi", "x.score", "x.record.*").select(columns)
    if not keys_left.isEmpty():
        met = _all_rivals(keys_left, titles, right, frequency, every, ranked, cut, threshold)
        met = T.with_token_set_ratio(met, "key", "norm", "score").where(F.col("score") >= threshold)
        found = found.unionByName(met.select(columns))
    return found


def _all_rivals(keys: DataFrame, titles: DataFrame, right: DataFrame, frequency: DataFrame, every, ranked, cut: float, threshold: float) -> DataFrame:
    """The first works of each source for ``keys`` that have one at the threshold, out of all titles."""
    # what a near subset lacks weighs ``cut`` of its length at most
    subset = F.col("before") <= cut * F.col("length") + SLACK
    a = _meet(_by_rarity(keys, "key", frequency, subset), every(titles), _within("a", "b", cut))
    b = _meet(every(keys), _by_rarity(titles, "norm", frequency, subset), _within("b", "a", cut))
    of = lambda rows, k, name: rows.select(F.col("id").alias(k), name, F.col("tokens").alias(f"{k}_tokens"))
    alike = spelled_alike(keys, titles, cut).join(of(keys, "a", "key"), "a").join(of(titles, "b", "norm"), "b")
    pairs = a.union(b).union(alike.select("key", "norm", _shared("a_tokens", "b_tokens"))).distinct()
    # grouped, as a filter would move below the steps of the ratio and repeat them
    good = T.with_token_set_ratio(pairs, "key", "norm", "score").groupBy("key", "norm", "shared").agg(F.max("score").alias("score")).where(F.col("score") >= threshold)
    # of those at the threshold only the first few of each source can be among the first of all
    good = staged(ranked(good.drop("score"), right.select("norm", "source", "doi")).select("key", "norm", "shared").distinct())
    asked = keys.join(good.groupBy("key").agg(F.min("shared").alias("least")), "key")
    # of n tokens, those that share ``least`` share one of the first n - least + 1
    rivals = _by_rarity(asked, "key", frequency, F.col("n") <= F.size("tokens") - F.col("least") + 1)
    pairs = _meet(rivals, every(titles), _share(F.col("a.least")))
    return ranked(pairs.union(good).distinct(), right)


def merge_candidates(candidates: DataFrame, first_source: str = "crossref") -> DataFrame:
    """One row for a key's DOI: the higher score's record (a tie keeps ``first_source``), first known author and year, all urls."""
    rank = F.struct((-F.col("score")).alias("s"), (F.col("source") != first_source).alias("later"), F.col("source"))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank))
    return candidates.groupBy("key", "doi").agg(
        F.min_by("title", rank).alias("title"), F.max("score").alias("score"), F.min_by("source", rank).alias("source"),
        known("first_author").alias("first_author"), known("year").alias("year"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("urls", F.array().cast("array<string>")))))).alias("urls"),
    )


def _evidence(url: str = "source_url", author: str = "want_author", year: str = "want_year") -> dict[str, Column]:
    """Whether a candidate is backed by the request's address, year or author."""
    host = host_of(F.col(url))
    same_host = ~host.isin("doi.org", "dx.doi.org") & F.exists("urls", lambda u: host_of(u) == host)
    surname = T.author_surname(F.col(author))
    return {
        "by_url": F.coalesce((D.normalise_doi(F.col(url)) == F.col("doi")) | F.coalesce(same_host, F.lit(False)), F.lit(False)) if url else F.lit(False),
        "by_year": F.coalesce(F.abs(F.col(year) - F.col("year")) <= 1, F.lit(False)),
        "by_author": F.coalesce((surname != "") & (surname == T.author_surname(F.col("first_author"))), F.lit(False)),
    }


def select_best_candidate(requests: DataFrame, candidates: DataFrame, band: float = BAND) -> DataFrame:
    """(key, doi, title, score, source): the one DOI that fits each request (key, first_author, year, source_url), or no row.

    With an author or year the titles within ``band`` of the best compete, else
    only the best. Address, year and author each narrow the field if they leave
    something; the highest merit must belong to a single DOI.
    """
    asked = requests.select("key", F.col("first_author").alias("want_author"), F.col("year").alias("want_year"), "source_url")
    rows = candidates.where(F.col("score") >= THRESHOLD).join(asked, "key").withColumns(_evidence())
    field = Window.partitionBy("key")
    informed = (F.coalesce("want_author", F.lit("")) != "") | (F.coalesce("want_year", F.lit(0)) != 0)
    rows = rows.withColumn("best", F.max("score").over(field))
    rows = rows.where(F.col("score") >= F.col("best") - F.when(informed, band).otherwise(0.0))
    for by in ("by_url", "by_year", "by_author"):
        rows = rows.withColumn("some", F.bool_or(by).over(field)).where(~F.col("some") | F.col(by))
    merit = F.col("score") + sum(F.when(F.col(f"by_{k}"), v).otherwise(0) for k, v in MERITS.items())
    rows = rows.withColumn("merit", merit).withColumn("top", F.max("merit").over(field)).where("merit = top")
    one = rows.groupBy("key").agg(F.min("doi").alias("doi"), F.max("doi").alias("other"), F.min_by("title", "doi").alias("title"), F.max("score").alias("score"), F.min_by("source", "doi").alias("source"))
    return one.where("doi = other").drop("other")


def augment_dois(requests: DataFrame, works: DataFrame) -> DataFrame:
    """``requests`` with the DOI of their title, null if unknown or ambiguous.

    Requests that share a normalised title resolve once; the least request_id's
    metadata decides. Other columns are kept, but for one named ``doi``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in requests.columns if c != "doi"]).alias("row")
    keyed = staged(_dealt(requests).select(T.normalize_title(F.col("title")).alias("key"), row))
    first = F.struct("row.first_author", "row.year", "row.source_url")
    asked = staged(keyed.groupBy("key").agg(F.min_by(first, "row.request_id").alias("m")).select("key", "m.*"))
    best = select_best_candidate(asked, merge_candidates(title_candidates(asked.select(F.col("key").alias("title")), works)))
    return keyed.join(best.select("key", "doi"), "key", "left").select("row.*", "doi")


def resolve_references(entries: DataFrame, works: DataFrame, pmc_ids: DataFrame, handles: DataFrame, show_all: bool = False, most: int = MAX_AUGMENTED) -> DataFrame:
    """(page_id, pos, doi, mode) of entries (page_id, pos, text, doi, doi_in_text, pmcid) that need a DOI shown.

    hidden: only a link holds it (with ``show_all`` any DOI); pmc: mapped from its
    PubMed Central id; augment: found by title, for entries that name a year, the
    first ``most`` of a page, unless the handle check denies it.
    """
    rows = entries.where(F.length("text") >= MIN_CITATION)
    mode = (
        F.when(F.col("doi").isNotNull(), F.when(~F.col("doi_in_text") | F.lit(show_all), "hidden"))
        .when(F.col("pmcid").isNotNull(), "pmc")
        .when(F.col("text").rlike(r"\b(?:18|19|20)\d{2}\b"), "augment")
    )
    rows = rows.withColumn("mode", mode).where("mode IS NOT NULL")
    hidden = rows.where("mode = 'hidden'").select("page_id", "pos", "doi", "mode")
    known = pmc_ids.where("doi IS NOT NULL").groupBy("pmcid").agg(F.min("doi").alias("doi"))
    pmc = rows.where("mode = 'pmc'").drop("doi").join(known, "pmcid").select("page_id", "pos", "doi", "mode")
    order = Window.partitionBy("page_id").orderBy("pos")
    todo = rows.where("mode = 'augment'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    # a reference's text is all that is known of it, so equal texts are one request
    asked = todo.select(F.col("text").alias("title")).distinct().select(
        F.col("title").alias("request_id"), "title", F.lit(None).cast("string").alias("first_author"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("source_url")
    )
    found = augment_dois(asked, works).where("doi IS NOT NULL").select(F.col("title").alias("text"), "doi")
    augmented = todo.drop("doi").join(found, "text").select("page_id", "pos", "doi", "mode")
    checked = validate_dois(augmented, handles)
    denied = checked.where("valid = false").select("page_id", "doi").distinct()
    return (
        hidden.unionByName(pmc.join(denied, ["page_id", "doi"], "left_anti").select("page_id", "pos", "doi", "mode"))
        .unionByName(checked.where("NOT (valid <=> false)").select("page_id", "pos", "doi", "mode"))
    )


def resolve_search_rows(rows: DataFrame, works: DataFrame, handles: DataFrame) -> DataFrame:
    """(row_id, resolved_doi, doi_source, outcome) of search results (row_id, title, first_author, year, source_url, doi, confident)."""
    checked = validate_dois(rows, handles).withColumn("sure", F.coalesce("confident", F.lit(False)) & F.col("doi").isNotNull())
    done = F.col("sure") | F.coalesce(F.col("valid"), F.lit(False))
    asked = checked.where(~done & (F.coalesce("title", F.lit("")) != "")).select(F.col("row_id").alias("request_id"), "title", "first_author", "year", "source_url")
    found = augment_dois(asked, works).select(F.col("request_id").alias("row_id"), F.col("doi").alias("augmented"))
    both = checked.join(found, "row_id", "left")
    has, aug = F.col("doi").isNotNull(), F.col("augmented")
    outcome = (
        F.when(F.col("sure"), "confident").when(F.coalesce("valid", F.lit(False)), "validated")
        .when(has & (aug == F.col("doi")), "cross-validated").when(has & aug.isNotNull(), "conflict")
        .when(has, "extracted-invalid").when(aug.isNotNull(), "augmented-only").otherwise("none")
    )
    both = both.withColumn("outcome", outcome)
    extracted = F.col("outcome").isin("confident", "validated", "cross-validated")
    doi = F.when(extracted, F.col("doi")).when(F.col("outcome").isin("conflict", "augmented-only"), aug)
    source = F.when(extracted, "extracted").when(doi.isNotNull(), "augmented")
    return both.select("row_id", doi.alias("resolved_doi"), source.alias("doi_source"), "outcome")


def augment_pages_from_title(titles: DataFrame, page_dois: DataFrame, works: DataFrame) -> DataFrame:
    """(page_id, doi) found by title for pages (page_id, title, first_author, year, url, scholarly) that have no DOI in ``page_dois``."""
    bare = titles.where(F.col("scholarly") & F.col("title").isNotNull()).join(page_dois.select("page_id").distinct(), "page_id", "left_anti")
    asked = bare.select(F.col("page_id").alias("request_id"), "title", "first_author", "year", F.col("url").alias("source_url"))
    return augment_dois(asked, works).where("doi IS NOT NULL").select(F.col("request_id").alias("page_id"), "doi")


def self_check_accuracy(rows: DataFrame) -> DataFrame:
    """Counts over rows (expected, resolved): total, resolved, correct, incorrect, unresolved.

    Routing words after the expected DOI are dropped.
    """
    known = D.normalise_doi(F.regexp_replace("expected", r"(?i)/(?:full|abstract|pdf|epdf|html|meta)/?\z", ""))
    right = F.coalesce(F.col("resolved") == known, F.lit(False))
    return rows.where(known.isNotNull()).agg(
        F.count("*").alias("total"), F.count("resolved").alias("resolved"), F.count_if(right).alias("correct"),
        F.count_if(F.col("resolved").isNotNull() & ~right).alias("incorrect"), F.count_if(F.col("resolved").isNull()).alias("unresolved"),
    )
