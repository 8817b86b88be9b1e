import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from citeloom.llm import chat, language_id, mixing, packing, pii, quality_model, quality_rules, token_store

from .helpers import WORDS, texts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(v if (v := int(c) * (1 + i % 2)) < 10 else v - 9 for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


PII = [
    None, "", "none", "a@b.c", "a@b.c_d@e.f.g x@y", "a@b..c", "--@-.-", "é😀 me.x+1@mail-2.example.com.", "@@a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1 255.255.255.255 001.02.3.4",
    "1.2.3.256", "4111 1111 1111 1111", "4111-1111 1111-1112", "4111111111111111 4111  1111", "card 0000000000000000000000", "+1 (988) 555-2485.", "+12 3", "++44 20 7946 0958", "+1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
    "+4111111111111111 mail a@b.co 10.0.0.1", "\n+1 234 567 890\n", "x" * 3000 + "@", "1" * 3000, "a." * 1500 + "@b.c",
]


def test_pii_base_spans(spark):
    rng = np.random.default_rng(1)
    noise = ["".join(rng.choice(list("a1 .@+-(5)é\n"), 60)) for _ in range(200)]
    rows = list(enumerate([*PII, *noise]))
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    for k, text in rows:
        want = plain_spans(text)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text, want, got[k].spans)
        assert got[k].n_email == want.count("email:") and got[k].n_phone == want.count("phone:")


def plain_entities(kind, value):
    digits = re.sub("[^0-9]", "", value)
    low = value.lower()
    whole, group = {"email": (low, low.split("@")[-1]), "ip": (low, ".".join(value.split(".")[:2])), "card": (digits, digits[:6]), "phone": (digits, digits[:5])}[kind]
    return [("value", kind, whole), ("group", kind, group)]


def plain_terms(rows):
    """{row: spans of disclosing terms with the bits that they leave} by the definition, over all rows."""
    df, near, holds = defaultdict(set), defaultdict(set), defaultdict(set)
    for k, text in rows:
        for t in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()):
            df[t].add(k)
        good = set(plain_spans(text).split(","))
        for kind, pattern in PATTERNS.items():
            found = list(re.finditer(pattern, text or ""))
            for n, m in enumerate(found):
                if f"{kind}:{m.start()}:{m.end()}" not in good:
                    continue
                left = text[found[n - 1].end() if n else 0 : m.start()]
                right = text[m.end() : found[n + 1].start() if n + 1 < len(found) else len(text)]
                left = regex.sub(r"^[\p{L}\p{N}]+", "", left[-200:]) if len(left) > 200 else left
                right = regex.sub(r"[\p{L}\p{N}]+$", "", right[:200]) if len(right) > 200 else right
                words = lambda x: regex.findall(r"[\p{L}\p{N}]+", x.lower())
                for e in plain_entities(kind, m[0]):
                    holds[k].add(e)
                    for t in words(left)[-8:] + words(right)[:8]:
                        near[e, t].add(k)
    out = defaultdict(dict)
    for k, text in rows:
        base = [tuple(map(int, x.split(":")[1:])) for x in plain_spans(text).split(",") if x]
        for m in regex.finditer(r"[\p{L}\p{N}]+", text or "") if base else ():
            t = m[0].lower()
            left = min(-np.log2(max(len(near.get((e, t), ())), 1e-300) / (len(df[t]) + 1)) for e in holds[k])
            if left <= 1.0 and not any(a < m.end() and m.start() < b for a, b in base):
                out[k][m.start(), m.end()] = left
    return out


def test_pii_against_brute_force(spark):
    """Whole results over the smallest table and over odd texts."""
    given = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] if os.path.isdir("/root/testdata/sf0.001") else []
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(60)]
    made = [" ".join([*rng.choice(words, 12), f"u{k % 9}@d{k % 4}.org", *rng.choice(words, 12), f"10.{k % 3}.0.{k % 7}"]) for k in range(60)]
    rows = given + [(100_000 + k, t) for k, t in enumerate([*made, *PII, "far " + "gap " * 90 + "a9@b.org " + "tail " * 90 + "end far"])]
    want = plain_terms(rows)
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        terms = {(int(a), int(b)) for kind, a, b in (x.split(":") for x in got[k].spans.split(",") if x) if kind == "term"}
        assert terms == set(want[k]), text
        assert got[k].n_removed == sum(v <= 0.6 for v in want[k].values()) and got[k].n_generalised == sum(v > 0.6 for v in want[k].values())
        assert got[k].base_sha256 == hashlib.sha256(plain_spans(text).encode()).hexdigest()


def test_pii_terms_that_disclose(spark):
    """A name that is only ever beside one address goes, wherever it stands in those rows; common words stay."""
    rows = [(k, f"please ask Zorblatt at z@b.org about the item today {'and ' * k}" + "and " * 30 + "zorblatt") for k in range(4)]
    rows += [(10 + k, f"please ask about the item today at number{k} and") for k in range(60)] + [(100, "please ask about the item today at Quux q@b.net and"), (101, None), (102, "Quux")]
    names = ["row", "doc", "base", "terms", "entity", "left", "__row", "__base", "__terms", "__spans"]
    df = spark.createDataFrame([(*r, "s", *range(len(names))) for r in rows], "doc_id int, text string, source string, " + ", ".join(f"`{n}` int" for n in names))
    out = pii.sanitise(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[k].text == f"please ask <TERM> at <EMAIL> about the item today {'and ' * k}" + "and " * 30 + "<TERM>" for k in range(4))
    assert got[100].text == "please ask about the item today at Quux <EMAIL> and" and got[101].text is None  # half of two rows, and one unseen
    assert all(got[10 + k].text == rows[4 + k][1] for k in range(60))
    assert all(r[n] == k for r in got.values() for k, n in enumerate(names))
    once = {r.doc_id: r.text for r in pii.sanitise(df.where("doc_id <> 102")).collect()}
    assert once[100] == "please ask about the item today at <Name> <EMAIL> and"
    assert pii.sanitise(df.limit(0)).count() == 0


def test_pii_many_spans_in_one_text(spark):
    text = " ".join(f"host{k} 10.{k // 62500 % 250}.{k // 250 % 250}.{k % 250}" for k in range(20_000))
    got = pii.digest(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert got.n_ip == 20_000


def plain_chats(rows):
    by = defaultdict(set)
    for c, t, r, x in rows:
        if c is not None:
            by[c].add((t is not None, t or 0, r or "user", x or ""))
    told = {c: tuple((r, x) for _, _, r, x in sorted(v)) for c, v in by.items()}
    keep = {c: t for c, t in told.items() if not any(o != c and u[: len(t)] == t and (len(u) > len(t) or o < c) for o, u in told.items())}
    return {c: "".join(f"<|{r}|>\n{x}\n" for r, x in t) for c, t in keep.items()}


@pytest.mark.parametrize("block", [256, 2])
def test_chats(spark, block):
    say = lambda c, n, first="hi": [(c, k, "user" if k % 2 == 0 else "assistant", first if k == 0 else f"t{k}") for k in range(n)]
    rows = [*say(1, 3), *say(2, 7), *say(3, 7), *say(4, 2, "other"), *say(5, 1), (6, None, None, None), (6, 1, "user", "x"), (7, 5, "a", "1"), (7, 5, "a", "2"), (None, 0, "user", "lost"), *say(8, 5), (8, 5, "user", "differs"), *say(5, 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, position int")
    parts = defaultdict(dict)
    for r in chat.format_chats(df, block).collect():
        parts[r.conv_id][r.part] = r.chat
    assert {c: "".join(p[k] for k in sorted(p)) for c, p in parts.items()} == plain_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_language_spans(spark):
    en, de = "the quick brown fox jumps over the lazy dog and runs away", "der schnelle braune fuchs springt über den faulen hund und läuft weg"
    ru = "быстрая лиса прыгает через собаку и убегает"
    rows = [(k, t, lang) for k in range(30) for t, lang in ((f"{en} {k}", "en"), (f"{de} {k}", "de"), (f"{ru} {k}", "ru"))]
    model = language_id.train(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert model["langs"] == ["de", "en", "ru"]
    mixed = f"{en}. {de}! {ru}"
    asked = [en, de, ru, mixed, None, "", "123 !?", "漢字", "THE DOG RUNS"]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(asked)], "doc_id int, text string, score int")
    got = {r.id: r for r in language_id.identify(df, model).collect()}
    assert [got[k].lang_pred for k in range(3)] == ["en", "de", "ru"] and got[8].lang_pred == "en"
    assert [s.lang for s in got[3].spans] == ["en", "de", "ru"]
    assert [(got[k].lang_pred, got[k].score) for k in (4, 5, 6)] == [("und", 0.0)] * 3
    assert got[7].lang_pred in model["langs"] and 0 <= got[7].score <= 1
    none = language_id.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.identify(df, none).collect()} == {"und"}


def plain_language(train, asked):
    """The operator by its definition, a word and a language at a time."""
    words = lambda t: regex.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (t or "").lower()))
    script = lambda c: next((n for lo, hi, n in language_id.SCRIPTS if lo <= ord(c) <= hi), "other")

    def grams(w):
        return language_id._trigrams([w])[0].tolist()

    grams = lru_cache(None)(grams)
    langs = sorted({x for _, x in train})
    counts, letters = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, x in train:
        for w in words(t):
            counts[x].update(grams(w))
            letters[x][script(w[0])] += len(w)
    used = len(set().union(*counts.values()))
    logp = {x: defaultdict(lambda c=sum(counts[x].values()): np.log(0.5 / (c + 0.5 * used)), {b: np.log((n + 0.5) / (sum(counts[x].values()) + 0.5 * used)) for b, n in counts[x].items()}) for x in langs}
    share = {x: {s: n / sum(letters[x].values()) for s, n in letters[x].items()} for x in langs}

    def barred(x, s):
        return -1e4 if share[x].get(s, 0) < language_id.USES and any(v.get(s, 0) >= language_id.USES for v in share.values()) else 0.0

    out = []
    for t in asked:
        own = words(t)
        value, back = {x: 0.0 for x in langs}, []
        for k, w in enumerate(own):
            top = max(value.values()) - language_id.SWITCH if k else -np.inf
            from_ = {x: x if value[x] >= top else max(value, key=lambda v: value[v]) for x in langs} if k else {}
            value = {x: (max(value[x], top) if k else 0.0) + sum(logp[x][b] for b in grams(w)) + barred(x, script(w[0])) for x in langs}
            back.append(from_)
        state, n = max(value, key=lambda v: value[v]) if own else None, Counter()
        for k in range(len(own) - 1, -1, -1):
            n[state] += len(own[k])
            state = back[k].get(state)
        best = max(sorted(n), key=lambda x: n[x]) if n else "und"
        out.append((best, n[best] / sum(n.values()) if n else 0.0))
    return out


def test_language_against_brute_force(spark):
    """Every prediction over the smallest table."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    rows = [(r.doc_id, (r.text or "")[:3000], r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learn = [(t, x) for k, t, x in rows if x is not None and zlib.crc32(str(k).encode()) % 4 != 2]
    model = language_id.train(df.where(~language_id.held_out(F.col("doc_id"))))
    got = {r.id: (r.lang_pred, r.score) for r in language_id.identify(df, model).collect()}
    for (k, _, _), (lang, score) in zip(rows, plain_language(learn, [t for _, t, _ in rows])):
        assert got[k][0] == lang and got[k][1] == pytest.approx(score), k


def test_more_languages_than_a_byte_holds(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(300 * 6)]
    rows = [(k * 10 + j, " ".join(rng.choice(words[6 * k : 6 * k + 6], 30)), f"l{k:03d}") for k in range(300) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = language_id.identify(df, language_id.train(df)).join(df.select(F.col("doc_id").alias("id"), "lang"), "id")
    assert got.where("lang_pred = lang").count() == 900


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(4)
    counts = np.array([3, 0, 5, 1, 4])
    score = rng.normal(size=(counts.sum(), 3)) * 3
    states = language_id.viterbi(score, counts, 2.0)
    at = 0
    for n in counts:
        own = score[at : at + n]
        value = lambda path, own=own: sum(own[t, s] for t, s in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        if n:
            best = max(value(p) for p in np.ndindex(*[3] * n))
            assert value(states[at : at + n].tolist()) == pytest.approx(best)
        at += n


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(packing.tokenizer_path())


ODD = ["", None, "don't I'll 'S x's's", "<|endoftext|> a", "é́ ﬁ ǅ İ", "a\x1cb c", "a b　c", "x" * 500 + " 12.34,5", "\x00 a\x7fb", "naïve's", "word " * 5000]


def test_word_ids(tokenizer):
    words = packing.word_ids(packing.tokenizer_path())
    for text in [*ODD, *texts(9, 20)]:
        assert words.text(text) == np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes(), text


def test_packing(spark, tokenizer):
    docs = [*ODD, *texts(3, 200)]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs)] + [(None, "a b", 1), (3, ODD[3], 1)], "doc_id long, text string, start int")
    rows = packing.pack_documents(df).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for k, t in enumerate(docs):
        if k == 3:
            continue
        ids, at = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[k], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += r.length
        assert at == len(ids)
    for own in seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(seq) <= sum(r.length for r in rows) / 2048 * 1.05 + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_differencing_evens_out():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 512, 600).tolist()
    bins = packing.difference(sizes, 80)
    assert sorted(i for b in bins for i in b) == list(range(600)) and len(bins) <= 80
    sums = [sum(sizes[i] for i in b) for b in bins]
    assert max(sums) - min(sums) < 40
    assert all(sum(sizes[i] for i in b) <= 2048 for b in packing.windows(sizes, 2048))
    assert packing.difference([8, 7, 6, 5, 4], 2) and packing.difference([], 3) == []


def test_token_store(spark, tokenizer, tmp_path):
    docs = [*ODD, *texts(6, 150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string").repartition(5).cache()
    out = f"file://{tmp_path}/store"
    manifest = token_store.build(df, out, length=64, shard=50).cache()
    rows = sorted(manifest.collect(), key=lambda r: r.shard)
    total = sum(r.n_sequences for r in rows)
    assert [r.first_slot for r in rows] == [50 * r.shard for r in rows] and all(r.n_sequences == 50 for r in rows[:-1])
    back = {r.slot: np.frombuffer(r.ids, "<u2") for r in token_store.read_sequences(spark, out, manifest, 0, 64).collect()}
    assert sorted(back) == list(range(total))
    number = token_store.permute(np.arange(total), total, inverse=True)
    stream = [back[s] for s in np.argsort(number)]
    # each partition's texts one after another, in order, filled up to whole sequences
    want = defaultdict(list)
    for r in df.select(F.spark_partition_id().alias("p"), "text").collect():
        want[r.p] += [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
    assert [i for x in stream for i in x.tolist()] == [i for p in sorted(want) for i in want[p] + [1] * (-len(want[p]) % 64)]
    assert [back[s].tolist() for s in token_store.permute(np.arange(total), total)] == [x.tolist() for x in stream]
    assert sum(r.n_tokens for r in rows) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in docs)
    late = token_store.read_sequences(spark, out, manifest, 73, 64).collect()
    assert sorted(r.slot for r in late) == list(range(73, total)) and all(np.array_equal(np.frombuffer(r.ids, "<u2"), back[r.slot]) for r in late)
    assert token_store.build(df.limit(0), f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000, 65537])
def test_feistel_permutes(n):
    slots = token_store.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert token_store.permute(slots, n, inverse=True).tolist() == list(range(n))
    assert n < 100 or (slots != token_store.permute(np.arange(n), n, key=5)).any()


def plain_targets(sizes, weights):
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        left = total - sum(fixed.values())
        goal = {s: w * left / sum(free.values()) for s, w in free.items()}
        over = {s: 3 * sizes[s] for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            return {**goal, **fixed}
        fixed |= over


def test_mixing(spark):
    rng = np.random.default_rng(8)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 30))), s) for k, s in enumerate(rng.choice(["a", "b", "c", "dé", "e"], 600, p=[0.03, 0.02, 0.6, 0.05, 0.3]))]
    rows += [(1000 + k, "x y z", None) for k in range(20)] + [(2000, None, "a"), (None, "q", "b"), (2001, "", "zero"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, h int")
    plan = mixing.plan_mix(df).collect()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORDS.findall(t or ""))
    names = sorted([s for s in size if s is not None]) + [None]
    want = plain_targets(size, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    taken = defaultdict(int)
    for r in plan:
        assert (r.source_size, r.target) == (size[r.source], pytest.approx(want[r.source]))
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in names)
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(df.repartition(7)).collect()))
    dotted = mixing.mix(df.withColumn("a.b", F.lit(1)))
    assert dotted.columns[-1] == "a.b" and dotted.count() == mixing.mix(df).count()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.plan_mix(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def plain_base(text):
    words = WORDS.findall(text)
    seen, covered = defaultdict(list), set()
    for k in range(len(words) - 7):
        seen[tuple(words[k : k + 8])].append(k)
    for at in seen.values():
        if len(at) > 1:
            covered |= {q for k in at for q in range(k, k + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_base_counts():
    given = ["", " \n\t", "a\nb\na\n\n \na ", "#|é😀 x y", "a b c d e f g h " * 3, "w " * 30, "  b", "a\x0bb\x1cc", *texts(7, 60, 3), *texts(8, 20)]
    assert quality_rules.base_counts(given).tolist() == [plain_base(t) for t in given]


def plain_kneser_ney(halves, order):
    """({n-gram: probability by each half's model}, counts) of all n-grams of both halves, by the definition of modified Kneser-Ney."""
    tables = {order: [Counter(), Counter()]}
    for f, samples in enumerate(halves):
        for t in samples:
            padded = "\x02" * (order - 1) + t
            tables[order][f].update(padded[k : k + order] for k in range(len(t)))
    for m in range(order - 1, 0, -1):
        tables[m] = [Counter(g[1:] for g in tables[m + 1][f]) for f in (0, 1)]
    out = []
    for f in (0, 1):
        p = {}
        for m in range(1, order + 1):
            seen = set(tables[m][0]) | set(tables[m][1])
            own = tables[m][f]
            n = [max(1, sum(v == k for v in own.values())) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), k - 0.1) for k in (1, 2, 3)]
            cut = lambda v, d=d: d[min(v, 3) - 1] if v else 0.0
            total, mass = Counter(), defaultdict(float)
            for g, v in own.items():
                total[g[:-1]] += v
                mass[g[:-1]] += cut(v)
            for g in seen:
                c, below = g[:-1], p[g[1:]] if m > 1 else 1 / (len(seen) + 1)
                p[g] = (own[g] - cut(own[g])) / total[c] + mass[c] / total[c] * below if total[c] else below
        out.append(p)
    return out, tables[order]


def test_kneser_ney(spark):
    samples = [*texts(11, 40, 12), "é😀 漢字 é😀x"]
    rows = spark.createDataFrame([("en", t) for t in samples], "lang string, text string")
    half = [F.sum(f"n{f}").alias(f"n{f}") for f in (0, 1)]
    model = quality_rules.kneser_ney(quality_rules.count_ngrams(rows).groupBy("lang", "key").agg(*half)).collect()
    (p0, p1), (n0, n1) = plain_kneser_ney([[t for t in samples if quality_rules.fold_of(t) == f] for f in (0, 1)], quality_rules.ORDER)
    assert {r.key for r in model} == set(n0) | set(n1)
    assert all((r.n0, r.n1) == (n0[r.key], n1[r.key]) and r.p0 == pytest.approx(p0[r.key]) and r.p1 == pytest.approx(p1[r.key]) for r in model)


def plain_judge(rows):
    """{id: (score, kept)} of rows (id, text, lang), by the definition."""
    order, folds = quality_rules.ORDER, quality_rules.fold_of
    clean = [(k, t or "", x or "") for k, t, x in rows]
    models = {x: plain_kneser_ney([[t for _, t, y in clean if folds(t) == f and x in (y, None)] for f in (0, 1)], order) for x in [*{x for *_, x in clean}, None]}
    mean = {}
    for x, ((p0, p1), (n0, n1)) in models.items():
        total = n0.total() + n1.total()
        mean[x] = (sum(v * np.log(p1[g]) for g, v in n0.items()) + sum(v * np.log(p0[g]) for g, v in n1.items())) / total if total else 0.0
    scores = {}
    for k, t, x in clean:
        padded, other = "\x02" * (order - 1) + t, 1 - folds(t)
        own, every = ([np.log(models[y][0][other][padded[i : i + order]]) for i in range(len(t))] for y in (x, None))
        parts = [(sum(own[i : i + 64]), sum(every[i : i + 64]), len(own[i : i + 64])) for i in range(0, len(t), 64)]
        weak = [a < (mean[x] - 0.5) * n for a, _, n in parts]
        foreign = sum(n for (_, _, n), w in zip(parts, weak) if w) <= 0.5 * len(t)
        scores[k] = sum(max(a, b) if w and foreign else a for (a, b, _), w in zip(parts, weak)) / len(t) if t else None
    counts = {k: plain_base(t) for k, t, _ in clean}
    failed = {k: c[0] < 20 or 100 * c[4] > 30 * c[0] for k, c in counts.items()}
    out = {}
    for x in {x for *_, x in clean}:
        own = sorted(np.floor(scores[k] / 0.001) for k, t, y in clean if y == x and not failed[k] and t)
        q = [own[int(np.ceil(share * len(own))) - 1] * 0.001 for share in (0.25, 0.75)] if own else None
        for k, t, y in clean:
            if y == x:
                room = (q[1] - q[0]) * np.sqrt(1 + 100 / max(1, counts[k][0])) if q else 0
                gap = min(scores[k] - (q[0] - 3 * room), (q[1] + 6 * room) - scores[k]) if q and t else None
                out[k] = (scores[k], not failed[k] and gap is not None and gap >= 0, gap)
    return out


def test_quality_rules_against_brute_force(spark):
    """Scores and verdicts of a whole table by the definition."""
    rng = np.random.default_rng(4)
    rows = [(k, t, "en" if k % 3 else "de") for k, t in enumerate(texts(13, 90, 30))]
    rows += [(900 + k, "".join(chr(c) for c in rng.integers(33, 126, 300)) + " x" * 30, "en") for k in range(4)]
    rows += [(950, None, "en"), (951, "w1 w2 " * 40, None), (952, rows[1][1], "en"), (953, rows[3][1] + " " + rows[1][1], "de"), (954, "漢字 " * 50 + rows[4][1], "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).cache()
    df.count()
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    for k, (score, kept, gap) in plain_judge(rows).items():
        assert (got[k].log_probability is None and score is None) or got[k].log_probability == pytest.approx(score, abs=1e-5), k
        assert got[k].kept == kept or (gap is not None and abs(gap) < 1e-4), k


def test_quality_rules(spark):
    rng = np.random.default_rng(2)
    clean = [" ".join(rng.choice(["the", "and", "house", "river", "stone", "walks", "green", "over", "light", "water"], 60)) for _ in range(200)]
    noise = "".join(chr(c) for c in rng.integers(33, 126, 400))
    rows = [(k, t, "en") for k, t in enumerate(clean)] + [(900, " ".join(noise[k : k + 7] for k in range(0, 400, 7)), "en"), (901, None, None), (902, "a b", "en"), (903, "same words again here now " * 20, "en")]
    df = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, lang string, kept boolean")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert sum(not got[k].kept for k in range(200)) == 0
    assert not got[900].base_failed and not got[900].kept
    assert [got[k].base_failed for k in (901, 902, 903)] == [True] * 3 and not any(got[k].kept for k in (901, 902, 903))
    assert quality_rules.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 26, 60, 10**6])
def test_slices_that_end_with_the_texts(monkeypatch, size):
    """A slice that is full with the last text is the last one."""
    monkeypatch.setattr(quality_rules, "_SLICE", size)
    given = ["the quick fox runs over it", "", "the slow dog walks under it", "a"]
    for k in range(1, len(given) + 1):
        parts = [given[:k][part] for part in quality_rules._slices(given[:k])]
        assert sum(parts, []) == given[:k] and all(parts)
        assert [len(quality_rules._grams(part)[1]) for part in parts] == [sum(map(len, part)) for part in parts]
    assert [len(x) for x in quality_rules._grams([])] == [0, 0, 0] and list(quality_rules._slices([])) == [slice(0, 0)]


def test_quality_rules_of_a_text_that_fills_a_slice(spark):
    """The last text of its language and half, alone or after another, is as long as a slice."""
    long = "the quick fox runs over the house and walks by a green river " * (quality_rules._SLICE // 60)
    rows = [(0, "the quick fox runs over the house and walks by a green river", "en"), (1, long, "en"), (2, long + "home", "en"), (3, long + "abc", "de"), (4, None, "en")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).collect()}
    assert [got[k].n_words for k in range(5)] == [len((t or "").split()) for _, t, _ in rows] and all(got[k].log_probability < 0 for k in range(4))


def test_quality_model(spark):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice(["the", "and", "house", "river", "stone."], 40)) for _ in range(300)]
    bad = [" ".join(w + "***" for w in rng.choice(["THE", "AND", "HOUSE"], 40)) for _ in range(100)]
    rows = [(k, t, "en", f"s{k % 3}", k) for k, t in enumerate(good + bad)] + [(None, good[0], "en", None, 0), (900, None, None, None, 0), (901, good[1] * 500, "en", "s1", 0)]
    names = ["score", "y", "content", "meta", "doc", "__score"]
    docs = spark.createDataFrame([(*r[:4], *range(len(names))) for r in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in names))
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(0, 400, 2)] * 2 + [(5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality_model.classify(docs, labels).collect()}
    held = [k for k in range(400) if k % 2]
    assert np.mean([got[k] == (k < 300) for k in held]) > 0.98
    kept = quality_model.filter_quality(docs, labels)
    assert kept.columns == docs.columns and 290 <= kept.count() <= 305
    assert all(r[n] == k for r in kept.collect() for k, n in enumerate(names))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(k or -1 for k, v in [(r.doc_id, r.kept) for r in quality_model.classify(docs, labels).collect()] if v)
    assert quality_model.classify(docs, labels.limit(0)).where("kept AND score = 0.5").count() == docs.count()
    assert quality_model.classify(docs.limit(0), labels).count() == 0
    assert quality_model.filter_quality(docs.select("doc_id", "text"), labels).count() > 0


def test_co_training_sums_over_all_unlabelled_rows(spark):
    """The sums in Spark against one array: the same weights, and rows beyond any sample move them."""
    rng = np.random.default_rng(1)
    y = (rng.random(60) < 0.5).astype(float)
    make = lambda t, n, d: np.float16(np.concatenate([rng.normal(size=(n, d)) + 1.5 * (2 * t[:, None] - 1) / d, np.ones((n, 1))], 1))
    views = tuple(make(y, 60, d).astype(float) for d in (5, 3))
    t = (rng.random(20_000) < 0.5).astype(float)
    pools = tuple(make(t, 20_000, d) for d in (5, 3))
    rows = spark.createDataFrame([(a.tobytes(), b.tobytes()) for a, b in zip(*pools)], "content binary, meta binary").repartition(7).cache()
    plain = lambda x: lambda of, size: of(tuple(p[x].astype(float) for p in pools)) if len(pools[0][x]) else np.zeros(size)
    one = quality_model.co_train(views, y, plain(slice(None)))
    spread = quality_model.co_train(views, y, lambda of, size: quality_model.total(rows, of, size))
    few = quality_model.co_train(views, y, plain(slice(0, 8000)))
    for a, b, c in zip(one["weights"], spread["weights"], few["weights"]):
        assert np.allclose(a, b, atol=1e-5) and not np.allclose(a, c, atol=1e-5)
    counts = np.bincount(rng.integers(0, quality_model._BINS, 10_000), minlength=quality_model._BINS)
    low, high = quality_model.thresholds(counts, 0.1)
    assert abs(low + 27) < 0.7 and abs(high - 27) < 0.7 and quality_model.thresholds(np.eye(1, quality_model._BINS, 3000)[0], 0.1) == (-3.0, 3.0)
