"""Titles meet exactly, with few pairs scored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import text as T
from citeloom.operators import resolve

WORKS = "doi string, title string, first_author string, year int, urls array<string>, source string"
ASK = "request_id long, title string, first_author string, year int, source_url string"


def works_of(spark, titles):
    return spark.createDataFrame([(f"10.1/{k}", t, None, None, None, "s") for k, t in enumerate(titles)], WORKS)


def edited(rng, title, n):
    letters = list(title)
    for _ in range(n):
        k = int(rng.integers(len(letters) + 1))
        kind = rng.integers(3)
        if kind == 0:
            letters.insert(k, "abcdeinorst "[rng.integers(12)])
        elif letters and kind == 1:
            letters.pop(min(k, len(letters) - 1))
        elif letters:
            letters[min(k, len(letters) - 1)] = "abcdeinorst "[rng.integers(12)]
    return "".join(letters)


@pytest.mark.parametrize("threshold", [88.0, 100.0, 75.0])
def test_all_pairs_at_the_threshold(spark, threshold):
    """Edits within and between words, words run together, titles that others hold: all that all pairs have."""
    rng = np.random.default_rng(5)
    words = ["immunopathologist", "sleep", "of", "cells", "x1", "memory", "randomised", "trial", "a", "hemoglobin", "2004", "under_score", "zz"]
    titles = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)]
    asks = [edited(rng, titles[rng.integers(60)], int(rng.integers(0, 6))) for _ in range(60)] + ["Immunopathologists", "", None, "sleep " * 40, "q"]
    rows = spark.createDataFrame(list(enumerate(asks)), "request_id long, title string")
    works = works_of(spark, titles + [None, "..."])
    got = [(r.key, r.doi) for r in resolve.title_candidates(rows, works, top=10_000, threshold=threshold).collect()]
    key = T.normalize_title(F.col("title"))
    pairs = rows.select(key.alias("key")).where("key <> ''").distinct().crossJoin(works.where("title IS NOT NULL").select("doi", key.alias("norm")).where("norm <> ''"))
    want = {(r.key, r.doi) for r in pairs.where(T.token_set_ratio(F.col("key"), F.col("norm")) >= threshold).collect()}
    assert len(got) == len(set(got)) and set(got) == want
    if threshold == 88.0:
        assert ("immunopathologists", f"10.1/{titles.index('immunopathologist')}") in want or "immunopathologist" not in titles


def test_titles_that_share_no_word(spark):
    works = works_of(spark, ["Immunopathologist", "Unrelated words entirely", "Memorysleepstudies"])
    asks = spark.createDataFrame([(1, "immunopathologists", None, None, None), (2, "sleep memory studies", None, None, None)], ASK)
    assert {r.request_id: r.doi for r in resolve.augment_dois(asks, works).collect()} == {1: "10.1/0", 2: "10.1/2"}  # spelt in the order of their sorted words


def test_few_pairs_leave_the_blocks(spark):
    """On titles that share a word each, few pairs reach the edit distance, however the blocks fall."""
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("ber", "lav", "gold", "spri", "choc", "mid", "cor") for b in ("ender", "olate", "nroden", "night", "ling", "alion")]
    title = lambda: " ".join([*rng.choice(words, 5), "trial"])
    table = lambda n, name: resolve._titles(spark.createDataFrame(list({(title(),) for _ in range(n)}), f"{name} string"), name).withColumn("id", F.monotonically_increasing_id())
    keys, titles = table(400, "key").persist(), table(500, "norm").persist()
    found = resolve.spelled_alike(keys, titles, 0.12).collect()
    pairs = {(r.a, r.b) for r in found}
    assert len(pairs) == len(found) < 0.05 * keys.count() * titles.count()
    texts = lambda t: {r.id: " ".join(r.tokens) for r in t.collect()}
    a, b = texts(keys), texts(titles)
    cross = spark.createDataFrame([(i, j, x, y) for i, x in a.items() for j, y in list(b.items())[:60]], "a long, b long, x string, y string")
    near = cross.where(F.levenshtein("x", "y") <= 0.12 * F.greatest(F.length("x"), F.length("y"))).collect()
    assert {(r.a, r.b) for r in near} <= pairs


def test_blocks_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 3)
    test_titles_that_share_no_word(spark)
    test_all_pairs_at_the_threshold(spark, 88.0)


def test_columns_of_a_request_stay(spark):
    works = works_of(spark, ["Sleep and memory in young adults"])
    asks = spark.createDataFrame([(1, "sleep and memory in young adults", None, None, None, "mine", 5, "old")], ASK + ", key string, `a.b` int, doi string")
    row = resolve.augment_dois(asks, works).first()
    assert (row["key"], row["a.b"], row["doi"], row["request_id"]) == ("mine", 5, "10.1/0", 1)
    assert resolve.augment_dois(asks.limit(0), works).count() == 0 and resolve.augment_dois(asks, works.limit(0)).first()["doi"] is None


@pytest.mark.parametrize("short", [8, 3])
def test_the_index_settles_what_many_works_share(spark, monkeypatch, short):
    """Few words in many titles: the first works of each source are those of all pairs, and no such title meets all others; titles too long for the index count."""
    monkeypatch.setattr(resolve, "SHORT", short)
    left = []
    monkeypatch.setattr(resolve, "_all_rivals", lambda keys, *a, rest=resolve._all_rivals: left.append(keys.count()) or rest(keys, *a))
    rng = np.random.default_rng(8)
    words = ["large", "small", "ring", "bolt", "plate", "trial"]
    title = lambda: " ".join([*rng.choice(words, rng.integers(1, 4)), "trial", str(rng.integers(20))])
    works = spark.createDataFrame([(f"10.1/{k:03}", title(), None, None, None, "st"[k % 2]) for k in range(300)], WORKS)
    rows = spark.createDataFrame([(k, title() + ": results" * (k % 2)) for k in range(60)] + [(60, "largering")], "request_id long, title string")
    got = {(r.key, r.doi) for r in resolve.title_candidates(rows, works, top=3).collect()}
    key, ratio = T.normalize_title(F.col("title")), T.token_set_ratio(F.col("key"), F.col("norm"))
    pairs = rows.select(key.alias("key")).distinct().crossJoin(works.select("doi", "source", key.alias("norm")))
    pairs = pairs.withColumns({"shared": F.size(F.array_intersect(T.title_tokens(F.col("key")), T.title_tokens(F.col("norm")))), "score": ratio}).where("shared > 0 OR score >= 88").toPandas()
    pairs["apart"] = (pairs["key"].str.len() - pairs["norm"].str.len()).abs()
    first = pairs.sort_values(["shared", "apart", "doi"], ascending=[False, True, True]).groupby(["key", "source"]).head(3)
    assert got == set(first[first.score >= 88][["key", "doi"]].itertuples(index=False, name=None)) and got
    assert short < 8 or left == [1]


def test_a_title_of_many_works_is_scored_once(spark, monkeypatch):
    """Works with one title are one title for the index and the score; the first works of each source by DOI are still found."""
    seen = []

    def counted(df, a, b, name, rest=T.with_token_set_ratio):
        seen.append((df.select(a, b, "source").count(), df.select(a, b, "source").distinct().count()))
        return rest(df, a, b, name)

    monkeypatch.setattr(T, "with_token_set_ratio", counted)
    works = spark.createDataFrame([(f"10.1/{k:03}", f"large ring trial {k // 2 % 3}", None, None, None, "st"[k % 2]) for k in range(90)], WORKS)
    rows = spark.createDataFrame([(k, f"Large ring: trial {k}") for k in range(3)], "request_id long, title string")
    got = {(r.key, r.doi) for r in resolve.title_candidates(rows, works).collect()}
    assert got == {(f"large ring trial {t}", f"10.1/{k:03}") for t in range(3) for k in range(30) if k // 2 % 3 == t}
    assert seen == [(6, 6)]
