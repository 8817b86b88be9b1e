"""The pipeline held against a plain version, stage by stage, over a whole small table.

Each plain stage gets the rows that the stage before it kept.
"""

import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex

from citeloom.llm import mixing, packing, quality_model
from citeloom.llm import simhash_dedup as S

from .helpers import components
from .test_text_ops import PATTERNS, luhn, plain_terms

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain_quality(docs, labels):
    """The ids that co-training on arrays keeps; every labelled document is fitted on."""
    labels = labels[labels.quality.isin([0, 1])].groupby("doc_id").quality.min()
    content, meta = quality_model.views_of(docs.text.tolist(), docs.lang.tolist(), docs.source.tolist())
    place = {k: i for i, k in enumerate(docs.doc_id)}
    known = sorted((k for k in labels.index if k in place), key=lambda k: (zlib.crc32(repr(int(k)).encode()), k))
    at = [place[k] for k in known]
    free = [i for i, k in enumerate(docs.doc_id) if k not in set(labels.index)]
    pool = tuple(x[free].astype(float) for x in (content, meta))
    model = quality_model.co_train(tuple(x[at].astype(float) for x in (content, meta)), labels[known].to_numpy(float), lambda of, size: of(pool))
    return set(docs.doc_id[quality_model.score_rows(model, (content, meta)) >= 0.5])


def plain_unique(docs):
    """The least id of each component of all pairs of wide fingerprints."""
    fps = S.wide_fingerprints(docs.text.tolist())
    links = [(i, j) for i in range(len(docs)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]).sum(1) <= S.WIDE)]
    ids = docs.doc_id.to_numpy()
    least = {}
    for k, root in zip(ids, components(len(docs), links)):
        least[root] = min(k, least.get(root, k))
    return set(least.values())


def plain_base(text):
    """(start, end, tag) of the personal data of a text."""
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                yield m.start(), m.end(), f"<{kind.upper()}>"


def plain_sanitised(docs):
    """{id: text} with personal data and disclosing terms replaced."""
    terms, out = plain_terms(list(zip(docs.doc_id, docs.text))), {}
    for k, text in zip(docs.doc_id, docs.text):
        spans = list(plain_base(text))
        for (a, b), left in terms.get(k, {}).items():
            shape = "<number>" if regex.fullmatch(r"\p{N}+", text[a:b]) else "<Name>" if regex.match(r"\p{Lu}", text[a:b]) else "<word>"
            spans.append((a, b, "<TERM>" if left <= 0.6 else shape))
        done, at = [], 0
        for a, b, new in sorted(spans, key=lambda s: s[0]):
            if a >= at:
                done += [text[at:a], new]
            at = max(at, b)
        out[k] = text if text is None else "".join(done) + text[at:]
    return out


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as P

    tokenizers = pytest.importorskip("tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    at = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [at.toPandas()]
    for name, stage in P.STAGES:
        at = P.materialise(stage(spark, at, SF))
        seen.append(at.toPandas())
    raw, good, unique, clean, mixed, packed = seen

    assert set(good.doc_id) == plain_quality(raw, pd.read_parquet(f"{SF}/labels.parquet")) and len(good) < len(raw)
    assert set(unique.doc_id) == plain_unique(good) and len(unique) < len(good)
    want = plain_sanitised(unique)
    assert dict(zip(clean.doc_id, clean.text)) == want and (clean.sort_values("doc_id").text.to_numpy() != unique.sort_values("doc_id").text.to_numpy()).any()

    con = duckdb.connect()
    con.register("documents", clean)
    plan = con.sql(mixing.SQL).df()
    copies = Counter(mixed.doc_id)
    assert all(copies[r.doc_id] * r.size == r.taken for r in plan.itertuples()) and set(copies) <= set(plan.doc_id)
    assert (mixed.text == mixed.doc_id.map(dict(zip(clean.doc_id, clean.text)))).all()

    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packed.itertuples():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(copies)
    for k, own in pieces.items():
        ids = [*tokenizer.encode(want[k], add_special_tokens=False).ids, 1]
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert (r.doc_tokens, len(part), r.ids_crc32) == (len(ids), r.length, zlib.crc32(part.tobytes()))
        times = Counter(i for r in own for i in range(r.start, r.start + r.length))
        assert times == Counter(dict.fromkeys(range(len(ids)), copies[k]))
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in own])
        assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= packed.length.sum() / 2048 * 1.05 + 1
