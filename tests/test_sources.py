"""Readers that split files, and snapshots in versions."""

import csv
import datetime as dt
import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.sources import readers, writers

HEADER = ["Title", "RetractionNature", "RetractionDate", "RetractionDOI", "OriginalPaperDOI"]


def text_of(rows, end="\r\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def rows_of(n, seed=0):
    rng = np.random.default_rng(seed)
    odd = ['a "quoted" one', "two\nlines", 'x",\n"y', "", "plain, with comma", "crlf\r\ninside", '""', "\n\n", "é€😀"]
    natures = ["Retraction", "", "Correction"]
    return [[odd[rng.integers(len(odd))], natures[k % 3], "8/1/2020 0:00" if k % 4 else "never", f"10.9/{k}" if k % 5 else "", f" 10.1/{k} "] for k in range(n)]


@pytest.mark.parametrize("split", ["64b", "7b", "1m"])
@pytest.mark.parametrize("end", ["\r\n", "\n"])
def test_csv_in_splits(spark, tmp_path, split, end):
    """Splits within records, quotes, and blank lines: as the standard library parses the whole file."""
    rows = rows_of(40)
    (tmp_path / "n.csv").write_bytes(("﻿" * (end == "\n") + text_of([HEADER, *rows], end) + end + text_of([["last", "Retraction", "1/2/2003 4:05", "", "10.1/z"]], end)).encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert split == "1m" or lines.rdd.getNumPartitions() > 4
        got = readers.read_notice_csv(spark, str(tmp_path)).orderBy("seq").collect()
        records = [r.record for r in readers.csv_records(spark, str(tmp_path)).orderBy("n").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = rows + [["last", "Retraction", "1/2/2003 4:05", "", "10.1/z"]]
    stamp = lambda t: dt.datetime(2020, 8, 1) if t.startswith("8") else dt.datetime(2003, 1, 2, 4, 5) if t.startswith("1") else None
    assert [(r.original_doi, r.nature, r.event_time, r.notice_doi) for r in got] == [(w[4].strip(), w[1], stamp(w[2]), w[3]) for w in want]
    assert [next(csv.reader(io.StringIO(r, newline="")))[0] for r in records[1:]] == [w[0] for w in want]


def test_csv_files_in_order(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}.csv").write_text(text_of([HEADER, *[["t\n", "Retraction", "", "", f"10.1/{k}.{i}"] for i in range(5)]]))
    got = readers.read_notice_csv(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.original_doi for r in got] == [f"10.1/{k}.{i}" for k in range(3) for i in range(5)] and {r.nature for r in got} == {"Retraction"}
    assert {(r.event_time, r.notice_doi) for r in got} == {(None, "")}
    (tmp_path / "part-9.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.read_notice_csv(spark, str(tmp_path))


def test_csv_of_a_header_alone_or_nothing(spark, tmp_path):
    (tmp_path / "n.csv").write_text(",".join(HEADER) + "\n")
    assert readers.read_notice_csv(spark, str(tmp_path / "n.csv")).count() == 0
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        readers.read_notice_csv(spark, str(tmp_path / "e.csv"))


def test_short_rows_have_empty_fields(spark, tmp_path):
    (tmp_path / "n.csv").write_text(",".join(HEADER) + "\nt,Retraction\n")
    row = readers.read_notice_csv(spark, str(tmp_path / "n.csv")).first()
    assert (row.original_doi, row.nature, row.event_time, row.notice_doi) == ("", "Retraction", None, "")


def test_snapshot_survives_a_failed_write(spark, tmp_path):
    """Whatever step a write fails at, readers find the version before, and one that began on an old version ends on it."""
    at = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        writers.read_snapshot(spark, at)
    writers.write_snapshot(spark.range(3), at)
    held = writers.read_snapshot(spark, at)
    broken = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        writers.write_snapshot(broken, at)
    assert writers.read_snapshot(spark, at).count() == 3
    done = writers.write_snapshot(spark.range(7), at)
    os.remove(f"{done.removeprefix('file:')}/_SUCCESS")  # killed before its last step
    assert writers.read_snapshot(spark, at).count() == 3
    for n in (8, 9):
        writers.write_snapshot(spark.range(n), at)
    assert writers.read_snapshot(spark, at).count() == 9 and held.count() == 3
    writers.write_snapshot(spark.range(10), at)
    assert len([v for v in os.listdir(at) if os.path.exists(f"{at}/{v}/_SUCCESS")]) == writers.KEEP


def test_notices_are_replaced_by_kind(spark, tmp_path):
    for kind in ("retraction", "concern"):
        n = spark.createDataFrame([("10.1/a", "10.9/n", kind)], "origin_doi string, notice_doi string, kind string")
        writers.write_notices(n, str(tmp_path / "out"))
        assert [r.kind for r in writers.read_notices(spark, str(tmp_path / "out")).collect()] == [kind]


def envelope(n, seed=0):
    rng = np.random.default_rng(seed)
    odd = ["plain", 'a "quoted" one', "brace },{ inside", "end },", "back\\slash\\", "[{", "é€\n", "}}", '\\"},']
    stats = {"n_replications_total": 1, "n_reproductions_total": 0, "n_originals_total": 2}
    out = {}
    for k in range(n):
        record = {"title": odd[rng.integers(len(odd))], "authors": "Lee", "record": {"stats": stats, "replications": [{"title": odd[rng.integers(len(odd))], "year": 2000 + k % 20}, {}]}}
        out[f"10.1/K{k}"] = None if k % 7 == 3 else {"title": "no stats"} if k % 11 == 5 else record
    return out


@pytest.mark.parametrize("split", ["64b", "900b", "1m"])
@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("around", [({}, {}), ({"meta": {"results": {"x": {"title": "no"}}, "n": [1]}, "v": 1}, {"after": {"y": {"z": 2}}})])
def test_envelopes_in_splits(spark, tmp_path, split, indent, around):
    """One long line or many, splits within texts and records, keys beside the results: the records that a parser of the whole file finds."""
    records = [envelope(40), envelope(3, 1), {}]
    for k, r in enumerate(records):
        r = {key.replace("K", f"K{k}."): v for key, v in r.items()}
        records[k] = r
        (tmp_path / f"{k}.json").write_text(json.dumps({**around[0], "results": r, **around[1]}, indent=indent, separators=None if indent else (",", ":")))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {r.key: r.record and json.loads(r.record) for r in readers.envelope_records(spark, str(tmp_path)).collect()}
        good, counts = readers.read_evidence_json(spark, str(tmp_path))
        titles = {r.doi: r.title for r in good.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {k: v for r in records for k, v in r.items()}
    assert {k: v for k, v in got.items() if v is not None} == {k: v for k, v in want.items() if v is not None}
    valid = {k.lower(): v["title"] for k, v in want.items() if v and "record" in v}
    assert titles == valid and counts.first().records == len(valid)
    assert counts.first().malformed == sum(1 for v in want.values() if v and "record" not in v)


def test_works_files(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"DOI":"10.1234/A","title":["T"],"author":[{"family":"Lee"}],"issued":{"date-parts":[[2001,2]]},"URL":"u"}\n{"DOI":"10.1234/b"}\nnot json\n')
    assert [(r.doi, r.title, r.first_author, r.year, r.urls) for r in readers.read_works_json(spark, str(tmp_path / "w.json"), "crossref").collect()] == [("10.1234/a", "T", "Lee", 2001, ["u"])]
