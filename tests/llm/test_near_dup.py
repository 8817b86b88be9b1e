import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm import embedding_dedup as E
from citeloom.llm import shingle_join as J
from citeloom.llm import simhash_dedup as S
from citeloom.llm.common import connected_components

from .helpers import components, groups, texts


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = words.encode().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    given = [None, "", "  \n", "One", "one two", "A b C d", "É É É é", "a b", *texts(1, 50), " ".join(["x", "y", "z"] * 400)]
    assert S.fingerprint_texts(given).tolist() == [plain_fingerprint(t) for t in given]


def test_spark_hash_is_the_same(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b ß")).alias("h")).first()
    assert row.h & (2**64 - 1) == xxhash.xxh64_intdigest("a b ß".encode(), 42)


@pytest.mark.parametrize("block", [4096, 7])
def test_links_of_close_fingerprints(spark, block):
    """Bits flipped at random, all within a few centres; small blocks deal a heavy band out."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {0, 1, 2**63}
    for _ in range(240):
        f = int(centres[rng.integers(0, 12)])
        for b in rng.integers(0, 64, rng.integers(0, 6)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    rows = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    got = {r.node: r.component for r in connected_components(S.fingerprint_links(rows, block=block)).collect()}
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    assert groups([got.get(f, f) for f in signed]) == groups(want)


def test_near_duplicates_of_documents(spark):
    base = texts(5, 30)
    docs = [*base, *base[:5], base[0] + " extra", None, "", base[1]]
    rows = [(k, t, 1, 2) for k, t in enumerate(docs)] + [(None, base[2], 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long, root long")
    got = {r.id: r for r in S.near_duplicates(df).collect()}
    fps = [plain_fingerprint(t) for t in docs]
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert [got[k].component_id for k in range(len(docs))] == want
    assert S.near_duplicates(df.limit(0)).count() == 0


def shingles(text, n=5):
    words = (text or "").split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))}


@pytest.mark.parametrize("block", [4096, 5])
def test_keep_one_of_near_copies(spark, monkeypatch, block):
    """Texts with a changed word fall together with their original at 0.8 and more; other texts stay."""
    monkeypatch.setattr(S.wide_links, "__defaults__", (S.WIDE, block))
    rng = np.random.default_rng(4)
    names = [f"w{k}" for k in range(3000)]
    docs, group = [], []
    for g in range(60):
        words = list(rng.choice(names, 150))
        for c in range(int(rng.integers(1, 8))):
            own = list(words)
            for k in rng.integers(0, 150, int(rng.integers(0, 2)) if c else 0):
                own[k] = "changed"
            docs.append(" ".join(own))
            group.append(g)
    docs += [None, "", " \n", docs[0], "half " + " ".join(docs[5].split()[:75]) + " other".join(map(str, range(90)))]
    group += [100, 100, 100, group[0], 101]
    names = ["row", "fp", "doc", "key", "first", "__row_id", "__fp"]
    rows = [(k, t, *range(len(names))) for k, t in enumerate(docs)]
    df = spark.createDataFrame(rows + [(None, docs[3], *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == sorted({g: k for k, g in reversed(list(enumerate(group)))}.values())
    assert all(r[n] == k and r.text == docs[r.doc_id] for r in got for k, n in enumerate(names))
    assert S.keep_one(df.union(df)).count() == len(set(group)) and S.keep_one(df.limit(0)).count() == 0
    fps = S.wide_fingerprints(docs)
    apart = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum())
    close = [apart(i, j) for i in range(len(docs)) for j in range(i) if group[i] == group[j] and len(shingles(docs[i]) & shingles(docs[j])) >= 0.9 * len(shingles(docs[i]) | shingles(docs[j]))]
    assert np.mean(np.array(close) <= S.WIDE) > 0.97 and min(apart(i, j) for i in range(len(docs)) for j in range(i) if group[i] != group[j]) > S.WIDE


def test_keep_one_joins_similar_texts_that_fingerprints_miss(spark):
    """Components of all pairs that are close by fingerprint or share four fifths of their shingles, over pairs about that similarity and a group that shares most."""
    rng = np.random.default_rng(12)
    names = np.array([f"w{k}" for k in range(3000)])

    def changed(words, n, at=None):
        out, at = list(words), int(rng.integers(0, len(words) - n)) if at is None else at
        out[at : at + n] = rng.choice(names, n)
        return out

    docs = []
    for _ in range(120):
        words = list(rng.choice(names, int(rng.integers(60, 200))))
        docs += [words, changed(words, max(1, round(len(words) * rng.uniform(0.09, 0.12)) - 4))]
    words = list(rng.choice(names, 100))
    docs += [changed(words, 10, at) for at in range(0, 90, 2)]  # each shares most with many
    docs += [changed(words, 40, at) for at in range(0, 60, 2)]
    docs += [["a"], ["a", "b"], list("abcde"), list("abcde") * 9, list("abcde") * 8, list("abcd") * 9]  # few distinct shingles
    docs = [" ".join(x) for x in docs] + [None, "", " "]
    sets, fps = [{x for x in shingles(t) if x} for t in docs], S.wide_fingerprints(docs)
    pairs = [(i, j) for i in range(len(docs)) for j in range(i)]
    similar = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    close = [(i, j) for i, j in pairs if np.bitwise_count(fps[i] ^ fps[j]).sum() <= S.WIDE]
    want, without = components(len(docs), similar + close), components(len(docs), close)
    assert len(set(similar) - set(close)) > 20 and len(set(want)) < len(set(without)) - 20
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in S.keep_one(rows).collect()) == sorted(set(want))


def test_hot_shingles_are_handed_on():
    key, h = np.arange(200), np.repeat([1, 2, 3, 4], [1, J.HOT, J.HOT + 1, 200 - 2 * J.HOT - 2])
    a, b, hot = J._pairs(key, h)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for j in range(1, J.HOT + 1) for i in range(1, j)}
    assert hot.tolist() == list(range(J.HOT + 1, 200))


def test_parities_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    held = [base[:n] for n in (0, 1, 31, 32, 33, 60, 70, 500, 520, 4000, 4700)] + [np.concatenate([base[50:n], base[-9:], base[-9:]]) for n in (60, 500, 4000)] + [base[2500:]]
    size, first, parity, sets = J.describe(held, base[:40])
    sets = [set(np.frombuffer(x, np.uint64).tolist()) for x in sets]
    assert sets == [set(x.tolist()) for x in held] and size.tolist() == list(map(len, sets))
    assert [len(x) // 6 for x in first] == [n - -(-4 * n // 5) + 1 if n else 0 for n in size]
    pairs = [(i, j) for i in range(len(held)) for j in range(len(held))]
    apart = J.parities_apart([parity[i] for i, _ in pairs], [parity[j] for _, j in pairs])
    differ = np.array([len(sets[i] ^ sets[j]) for i, j in pairs])
    assert (apart <= differ).all() and (apart[differ == 1] == 1).all() and apart[pairs.index((9, 14))] > 1000


@pytest.mark.parametrize("block", [4096, 37])
def test_every_link_of_wide_fingerprints(spark, block):
    """Pairs that differ in as many bits as may be, chained or apart, are all found; one bit more links nothing."""
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, (400, 256), dtype=np.uint8)
    flip = lambda row, n: row ^ np.isin(np.arange(256), rng.choice(256, n, replace=False)).astype(np.uint8)
    near = np.array([flip(b, S.WIDE) for b in bits[:300]])
    far = np.array([flip(b, S.WIDE + 1) for b in bits[300:]])
    rows = [(k, np.packbits(b).tobytes()) for k, b in enumerate([*bits, *near, *far, flip(near[0], S.WIDE)])]
    got = {(min(r), max(r)) for r in S.wide_links(spark.createDataFrame(rows, "key long, fp binary"), len(rows), block=block).collect()}
    chain = {(0, 400), (400, 800), (0, 800)}
    assert {p for p in got if p not in chain} == {(k, 400 + k) for k in range(1, 300)} and len(got & chain) >= 2


@pytest.mark.parametrize("dense", [4, 10**9])
def test_links_of_wide_fingerprints_by_bands(monkeypatch, dense):
    """Two large blocks: by bands few pairs are looked at, and links and components are those of all pairs, also where the bands are left."""
    rng = np.random.default_rng(8)
    words = rng.integers(0, 2**64, (9000, S.WORDS), dtype=np.uint64)

    def flip(row, n):
        out = row.copy()
        for b in rng.choice(256, n, replace=False):
            out[b // 64] ^= np.uint64(1 << int(b % 64))
        return out

    words[4500:4800] = [flip(words[k], S.WIDE) for k in range(300)]  # the farthest that link
    words[4800:5000] = [flip(words[k], S.WIDE + 1) for k in range(300, 500)]
    words[5000:5040] = [flip(words[500], int(n)) for n in rng.integers(0, 30, 40)]  # a group, across and within a block
    words[600:640] = [flip(words[500], int(n)) for n in rng.integers(0, 30, 40)]
    for block in (np.arange(9000) // 4500, np.zeros(9000, int)):
        want = S._linked(words, block, S.WIDE)
        with monkeypatch.context() as m:
            m.setattr(S, "_FEW", 0)
            m.setattr(S, "_DENSE", dense)
            assert [x.tolist() for x in S._linked(words, block, S.WIDE)] == [x.tolist() for x in want]
        assert {(k, 4500 + k) for k in range(300)} <= set(zip(want[1].tolist(), want[0].tolist())) and not {*range(4800, 5000)} & {*want[0].tolist()}
    assert sum(n for n, _, _ in S._meetings(words[:4500], words[4500:], S.WIDE)) < 0.01 * 4500**2


def test_wide_fingerprints():
    """Each word of a fingerprint is the majority of a mix of the shingles' hashes."""
    given = [None, "one two", "a b c d e f", *texts(3, 30)]
    got = S.wide_fingerprints(given)
    for t, own in zip(given, got):
        words = (t or "").split()
        parts = [" ".join(words[k : k + 5]) for k in range(len(words) - 4)] or ([" ".join(words)] if words else [])
        for k in range(4):
            mixed = []
            for p in parts:
                x = (xxhash.xxh64_intdigest(p, 42) ^ (k * 0x2545F4914F6CDD1D & 2**64 - 1)) * 0x9E3779B97F4A7C15 % 2**64
                x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 % 2**64
                mixed.append(x ^ x >> 32)
            assert int(own[k]) == sum(1 << b for b in range(64) if mixed and 2 * sum(h >> b & 1 for h in mixed) > len(mixed))


def test_connected_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def vectors(seed, n=300, near=120):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    for k in range(near):
        x[n - 1 - k] = x[k % 17] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.15, 0.3])
    return x


@pytest.mark.parametrize("chunk", [2048, 40])
def test_embedding_links(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    x = vectors(2)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(900, (2 * x[0]).tolist(), 0), (901, None, 0), (902, [0.0] * 16, 0), (903, [None] + [1.0] * 15, 0), (904, [float("nan")] * 16, 0), (905, [1.0, 2.0], 0), (906, [3.0], 0), (907, [2.0, 4.1], 0), (908, [-1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key int")
    got = {r.vec_id: r for r in E.link(df).collect()}
    assert len(got) == len(rows)
    y = np.concatenate([x, 2 * x[:1]])
    unit = y / np.linalg.norm(y, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(y), dtype=bool)
    ids = [*range(len(x)), 900]
    found = sum(got[i].n_links for i in ids)
    assert all(got[i].n_links <= linked[k].sum() for k, i in enumerate(ids))
    assert found >= 0.97 * linked.sum()
    want = components(len(y), np.argwhere(linked).tolist())
    assert sum(got[i].component_id != ids[want[k]] for k, i in enumerate(ids)) <= 3
    assert [(got[k].n_links, got[k].component_id) for k in (905, 907, 908)] == [(1, 905), (1, 905), (0, 908)]  # of another length
    for odd in (901, 902, 903, 904, 906):
        assert (got[odd].n_links, got[odd].component_id, got[odd].kept) == (0, odd, True)
    assert E.link(df.limit(0)).count() == 0


def test_recall_without_links_is_not_measured(spark):
    rows = [(k, [float(k == 0), float(k == 1), float(k == 2)]) for k in range(3)]
    assert {r.audit_recall for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == {None}


@pytest.mark.parametrize("chunk, centroids, part", [(2048, 4096, 8192), (64, 4096, 8192), (16, 4096, 8192), (16, 8, 20)])
def test_every_link_of_hot_and_chained_groups(spark, monkeypatch, chunk, centroids, part):
    """A hot group, a chain whose ends don't link, and pairs: as brute force has them, at several sizes of chunks.

    The last case needs more centroids than are fitted at once.
    """
    monkeypatch.setattr(E, "CHUNK", chunk)
    monkeypatch.setattr(E, "CENTROIDS", centroids)
    monkeypatch.setattr(E, "PART", part)
    monkeypatch.setattr(E, "_exact", None)  # the search alone
    rng = np.random.default_rng(9)
    hot = rng.normal(size=(1, 24)) + 0.1 * rng.normal(size=(120, 24))
    turn = np.arange(40) * 0.4
    chain = np.stack([np.cos(turn), np.sin(turn), *np.zeros((22, 40))], 1)
    pair = rng.normal(size=(40, 24))
    x = np.concatenate([hot, chain, pair, pair + 0.05 * rng.normal(size=pair.shape)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in E.link(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[k].n_links for k in range(len(x))] == linked.sum(1).tolist()
    assert [got[k].component_id for k in range(len(x))] == components(len(x), np.argwhere(linked).tolist())


def test_float_vectors_and_copies(spark):
    rows = [(k, [1.0, 2.0, float(k % 2)]) for k in range(6)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {k: (5, 0) for k in range(6)}  # cosine of the two kinds is over 0.9


@pytest.mark.parametrize("chunk", [2048, 40])
def test_links_lost_outside_a_hot_group_are_found(spark, monkeypatch, chunk):
    """A search that misses every small group, beside a hot group with nearly all links."""
    search = E._search
    monkeypatch.setattr(E, "_search", lambda *a: search(*a).where("links > 5"))
    monkeypatch.setattr(E, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(31, 16))
    x = np.concatenate([x[:1] + 0.02 * rng.normal(size=(60, 16)), x[1:16], x[1:16] + 0.02 * rng.normal(size=(15, 16))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in E.link(rows).collect()}
    assert [got[k].n_links for k in range(len(x))] == linked.sum(1).tolist()
    assert [got[k].component_id for k in range(len(x))] == components(len(x), np.argwhere(linked).tolist())


def test_a_group_of_many_chunks(spark, monkeypatch):
    """A group that fills fifteen chunks, beside pairs: the search alone finds every link."""
    monkeypatch.setattr(E, "CHUNK", 40)
    monkeypatch.setattr(E, "_exact", None)
    rng = np.random.default_rng(9)
    pair = rng.normal(size=(60, 24))
    x = np.concatenate([rng.normal(size=(1, 24)) + 0.1 * rng.normal(size=(600, 24)), pair, pair + 0.05 * rng.normal(size=pair.shape)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in E.link(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[k].n_links for k in range(len(x))] == linked.sum(1).tolist()
    assert {r.audit_recall for r in got.values()} == {1.0}
