"""The piece codec against its library, whitening and the trie against plain versions."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import piece_codec, prefix_trie, queries, whitening


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_codec.model_path())


ODD = [
    "", " ", "a", " a", "a ", "  a  b  ", "\n", "a\n\nb\t c", "▁a ▁▁b", "<s> </s> <unk> <0x41>", "😀x", "\x00a", "ＡＢ", " " * 100 + "x", "x" + " " * 37,
    " " * 31 + "\n" + " " * 15, "a" * 19, "ab" * 99, "日本語" * 50, "-" * 1000, "=/=" * 333, "é é", "word." * 2000, "n" * 50_000, "0123456789" * 9, "don't «x»  (y)…",
]


def test_codec_is_the_library(spark, library):
    rows = [(k, t) for k, t in enumerate([*ODD, None, ODD[5]])] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "a.b": F.lit(2)})
    got = {r.id: r for r in piece_codec.encode(docs, decoded=True).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        want = library.encode(t or "", add_eos=True)
        assert got[k].ids == want and got[k].decoded == library.decode(want)
    back = piece_codec.decode(piece_codec.encode(docs)).collect()
    assert {r.id: r.decoded for r in back} == {k: r.decoded for k, r in got.items()}
    assert piece_codec.encode(docs.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdeinorst   .,'-_\n▁éß日́😀0$"), max_size=120) | st.text(max_size=60))
def test_codec_of_any_text(text):
    from sentencepiece import SentencePieceProcessor

    model = piece_codec.merges(piece_codec.model_path())
    library = SentencePieceProcessor(model_file=piece_codec.model_path())
    want = library.encode(text, add_eos=True)
    (got,) = model.encode([text])
    assert got.tolist() == want and model.decode(got).decode() == library.decode(want)


def test_codec_forgets_words(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE", 5)
    monkeypatch.setattr(piece_codec, "LONGEST", 4)
    monkeypatch.setattr(piece_codec, "FLAT", 12)
    model = piece_codec.Merges(piece_codec.model_path())
    for _ in range(2):
        texts = ["some words of which few are kept", "of few, of many longerwordsthanthat", None]
        assert [x.tolist() for x in model.encode(texts)] == [library.encode(t or "", add_eos=True) for t in texts]
        assert len(model.known) <= 5


def test_codec_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op11_piece_codec(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def plain_whitening(x, weights):
    """(n, deviations, whitened, explained) of rows x, of which each distinct one weighs as given."""
    distinct, at, copies = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    w = copies if weights == "copies" else np.ones(len(distinct), int)
    n, total = int(w.sum()), (distinct * w[:, None]).sum(0)
    z = distinct - total / n
    e, v = np.linalg.eigh((z * w[:, None]).T @ z / n)
    e, v = e[::-1][:4], v[:, ::-1][:, :4]
    return n, ((n * distinct - total) ** 2).sum(1)[at], (z @ v / np.sqrt(e))[at], e / np.trace((z * w[:, None]).T @ z / n)


def hold(rows, x, ids, weights="one"):
    n, deviation, white, explained = plain_whitening(x, weights)
    got = {(r[0], r.component): r for r in rows}
    assert len(got) == len(rows) == len(ids) * min(4, x.shape[1])
    for c in range(min(4, x.shape[1])):
        sign = np.sign(got[ids[0], c + 1].whitened * white[0, c]) or 1
        for k, i in enumerate(ids):
            r = got[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation[k])
            assert r.whitened == pytest.approx(sign * white[k, c], abs=1e-8)
            assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_query(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.floor(256 * np.stack([np.asarray(v, float) for v in table.embedding])).astype(int)
    hold(queries.op12_whitening(spark, sf).collect(), x, table.vec_id.tolist())


@pytest.mark.parametrize("weight", ["one", "copies"])
def test_whitening_of_copies_and_lengths(spark, weight):
    """A third of all rows are copies of one vector; two lengths have fits of their own; odd rows are left out."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(60, 6)), rng.normal(size=(40, 3))
    a[:20] = a[0]
    rows = [(k, v.tolist()) for k, v in enumerate(a)] + [(100 + k, v.tolist()) for k, v in enumerate(b)]
    odd = [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan")] * 3), (203, [float("inf"), 0.0, 0.0]), (204, []), (205, [7.0, 7.0])]
    got = whitening.whiten(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("a.b", F.lit(0)), weight=weight).collect()
    hold([r for r in got if r.vec_id < 100], np.floor(256 * a).astype(int), list(range(60)), weight)
    hold([r for r in got if 100 <= r.vec_id < 200], np.floor(256 * b).astype(int), list(range(100, 140)), weight)
    alone = [r for r in got if r.vec_id >= 200]
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(alone, key=lambda r: r.component)] == [
        (205, 1, 1, 0, None, None, None), (205, 2, 1, 0, None, None, None)
    ]


def test_whitening_of_huge_entries_repeated_rows_and_nothing(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [-0.0, 0.5]), (3, [-0.0, 0.5]), (None, [0.0, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(table).collect()
    assert len(got) == 10 and {r.n for r in got} == {3} and {r.deviation for r in got if r.vec_id in (1, 2)} == {None}
    assert whitening.whiten(table.limit(0)).count() == 0
    # the exact sum of squares needs more than doubles
    x = np.array([[(1 << 40) + 1], [3], [5]], object)
    n, total = 3, [(1 << 40) + 9]
    assert whitening.deviations(x.astype(np.int64), n, total) == [None if v >= 1 << 63 else v for v in ((n * x - total[0]) ** 2).sum(1).tolist()]


def plain_trie(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conv[c].append(((t is not None, t or 0), role or "", text or ""))
    members, children, total = defaultdict(list), defaultdict(list), {}
    for c, turns in conv.items():
        turns.sort()
    for c, turns in conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = [t[1:] for t in conv.get(c - int(math.fmod(c, 100)), [])[:h]] + [t[1:] for t in turns[h:]]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        total[p] = (sum(total[q][0] for q in children[p]) or 1, own + sum(total[q][1] for q in children[p]))
    ends = {p: ",".join(str(c) for c, end in sorted(m) if end) for p, m in members.items()}
    least = {p: min(m)[0] for p, m in members.items()}
    return {
        (least[p], len(p), least[p[:-1]] if p else None, len(m), len(children[p]), *total[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in members.items()
    }


def holds_trie(table):
    got = prefix_trie.trie(table).collect()
    want = plain_trie(table.select("conv_id", "turn", "role", "text").collect())
    assert len(got) == len(want) and {tuple(r) for r in got} == want


SCHEMA = "conv_id long, turn long, role string, text string"


def test_trie_of_small_texts(spark):
    """Shared prefixes, missing families, nulls in any column, ties, repeated rows, negative ids and a clashing column."""
    rng = np.random.default_rng(3)
    pick = lambda *x: x[rng.integers(len(x))]
    rows = [
        (None if rng.random() < 0.02 else pick(0, 0, 100, 200) + int(rng.integers(-60, 60)), pick(None, 0, 1, 2, 3, 4, 5, 6), pick("user", None, "b"), pick("a", "bb", "é€", None, ""))
        for _ in range(900)
    ]
    holds_trie(spark.createDataFrame(rows, SCHEMA).withColumns({"d1": F.lit(1), "a.b": F.lit(2)}).repartition(5))


def test_trie_of_long_and_common_conversations(spark):
    """A conversation with a third of all rows, copies of it, one that leaves it late, and many that share a first turn."""
    text = lambda t: "x" * (t % 5)
    rows = [(c, t, "u", text(t)) for c in (100, 101, 102) for t in range(70)]
    rows += [(103, t, "u", text(t) if t < 40 else "y") for t in range(65)] + [(c, 0, "u", "hi") for c in range(300, 420)]
    holds_trie(spark.createDataFrame(rows, SCHEMA))
    holds_trie(spark.createDataFrame([(c, t, "u", str(c % 7 if t > 1 else 0)) for c in range(1000, 1060) for t in range(4)], SCHEMA))


def test_trie_of_one_turn_or_none(spark):
    holds_trie(spark.createDataFrame([(7, 0, "u", "x")], SCHEMA))
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 30)
    members = spark.range(500).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 9 == 0, 2).otherwise(1).cast("long").alias("e1"), F.lit(5).cast("long").alias("e2"))
    got = {r.e1: r.sha256 for r in prefix_trie.hashed_ids(members.repartition(3)).collect()}
    ids = {e: ",".join(str(k) for k in range(500) if (k % 9 == 0) == (e == 2)) for e in (1, 2)}
    assert got == {e: hashlib.sha256(v.encode()).hexdigest() for e, v in ids.items()}
