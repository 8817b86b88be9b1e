"""The registered queries at the smallest scale: SQL where there is some, plain versions of stages elsewhere."""

import os

import duckdb
import pandas as pd
import pytest

from citeloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    order = sorted(want.columns)
    sort = lambda df: df[order].sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)


def test_language_held_out(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = Q.op4_language_id(spark, SF).join(langs, "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = Q.op9_quality_model(spark, SF).join(labels, "doc_id").toPandas()
    assert (got[got.quality == 1].kept).mean() > 0.97


def test_pipeline(spark):
    """Each stage's rows against its input's."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(stage(spark, seen[-1], SF).cache())
        if name != "pack":
            assert seen[-1].columns == docs.columns, name
    raw, good, unique, clean, mixed, packed = seen
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert set(ids(good)) <= set(ids(raw)) and set(ids(unique)) <= set(ids(good)) and ids(clean) == ids(unique)
    assert clean.where(r"text RLIKE '[A-Za-z0-9]@[A-Za-z0-9]+[.]'").count() == 0
    assert set(ids(mixed)) <= set(ids(clean))
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert P.run(spark, SF).count() == packed.count()
