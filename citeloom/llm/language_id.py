"""Language spans: script ranges narrow candidates, Viterbi with a switching penalty labels words.

The model counts letter trigrams (with word ends) of labelled texts by language,
hashed to ``BUCKETS`` counters, and letters by script. A word's score under a
language is the sum of its trigrams' log probabilities; languages that hardly
ever use the word's script are no candidates. Viterbi over the words of a text
charges ``SWITCH`` for a change of language, which gives spans; the text's
language is that with the most letters.

The model's size is bounded by languages times ``BUCKETS`` and does not grow with
the corpus, so it travels with the tasks. Counts cover all training rows.

Null texts and texts without a letter are ``und`` with score 0. Rows are
labelled by themselves: repeated rows and null ids are kept. Without training
rows everything is ``und``. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SWITCH = 12.0
SMOOTH = 0.5
UNKNOWN = "und"
#: Languages with less than this share of letters in a script don't count as its users.
USES = 0.002
_SLICE = 4_000_000  # characters handled at once

#: Unicode ranges of scripts, fixed values.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x2FA1F, "Han"),
]
NAMES = ["other", *dict.fromkeys(name for *_, name in SCRIPTS)]


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + the number of its script."""
    table = np.zeros(0x110000, np.uint8)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    for lo, hi, name in SCRIPTS:
        table[lo : hi + 1] *= 1 + NAMES.index(name)
    return table


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``_SLICE`` characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _trigrams(texts: list[str]):
    """Words of lower-cased texts: (trigram buckets, first trigram, script, letters and beginning of each word).

    Runs of letters are words; what lies between is left out.
    """
    code = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _letters()[code]
    letter = script > 0
    begin = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1  # exclusive
    clean = np.where(letter, code, 32).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = (clean[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (clean[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (clean[2:] * np.uint64(0x165667B19E3779F9))
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    middle = letter[1:-1]
    bucket = (key[middle] >> np.uint64(48)).astype(np.int64) % BUCKETS
    size = end - begin
    first = np.cumsum(size) - size
    return bucket, first, script[begin].astype(np.int64) - 1, size, begin


def _text_words(texts: list[str], begin: np.ndarray) -> np.ndarray:
    """How many words each text has, by where the texts begin."""
    at = np.cumsum([1] + [len(t) + 1 for t in texts])
    return np.diff(np.searchsorted(begin, at))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model of rows with a text and a language: languages, log probabilities, script candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for lang, own in pdf.groupby("lang")["text"]:
                own = [t.lower() for t in own]
                for a, b in _parts(own):
                    bucket, _, script, size, _ = _trigrams(own[a:b])
                    grams[lang] = grams.get(lang, 0) + np.bincount(bucket, minlength=BUCKETS)
                    scripts[lang] = scripts.get(lang, 0) + np.bincount(script, weights=size, minlength=len(NAMES))
        for lang in grams:
            some = np.flatnonzero(grams[lang])
            yield pd.DataFrame({"lang": lang, "slot": some, "n": grams[lang][some]})
            some = np.flatnonzero(scripts[lang])
            yield pd.DataFrame({"lang": lang, "slot": BUCKETS + some, "n": scripts[lang][some].astype(np.int64)})

    def arrow(batches):
        for pdf in run(batches):
            yield pa.RecordBatch.from_pandas(pdf.astype({"slot": "int64", "n": "int64"}), preserve_index=False)

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.mapInArrow(arrow, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    table = np.zeros((len(langs), BUCKETS + len(NAMES)))
    table[counts["lang"].map({x: k for k, x in enumerate(langs)}), counts["slot"]] = counts["n"]
    grams, letters = table[:, :BUCKETS], table[:, BUCKETS:]
    used = max(1, int((grams.sum(0) > 0).sum()))
    logp = np.log((grams + SMOOTH) / (grams.sum(1, keepdims=True) + SMOOTH * used)) if langs else grams
    share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
    barred = np.where(share >= USES, 0.0, -1e4)
    barred[:, share.max(0, initial=0.0) < USES] = 0.0  # nobody's script: all remain
    return {"langs": langs, "logp": np.ascontiguousarray(logp.T, np.float32), "barred": np.ascontiguousarray(barred.T)}


def viterbi(score: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of each word; texts of ``counts`` words lie one after another in ``score``."""
    states = np.zeros(len(score), np.int32)
    order = np.argsort(-counts, kind="stable")
    n = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    if not len(score):
        return states
    longest = int(n[0])
    active = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t words
    stay = np.zeros(score.shape, bool)
    best = np.zeros(len(score), np.int32)
    value = score[first[: active[0]]].copy()
    end = np.zeros(len(counts), np.int32)
    for t in range(1, longest + 1):
        a = active[t] if t < longest else 0
        done = slice(a, len(value))
        end[done] = value[done].argmax(1)
        if not a:
            break
        value = value[:a]
        at = first[:a] + t
        top = value.argmax(1)
        jump = value[np.arange(a), top] - penalty
        stay[at] = value >= jump[:, None]
        best[at] = top
        value = np.maximum(value, jump[:, None]) + score[at]
    state = end.copy()
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        states[at] = state[:a]
        if t:
            keep = stay[at, state[:a]]
            state[:a] = np.where(keep, state[:a], best[at])
    return states


def label(texts: list[str], model: dict, penalty: float = SWITCH):
    """For each text (language, score, spans); a span is (language, first word, words)."""
    langs, out = model["langs"], []
    for a, b in _parts(texts):
        own = [t.lower() for t in texts[a:b]]
        bucket, first, script, size, begin = _trigrams(own)
        counts = _text_words(own, begin)
        if not langs or not len(size):
            out += [(UNKNOWN, 0.0, [])] * len(own)
            continue
        score = np.add.reduceat(model["logp"][bucket], first, axis=0, dtype=np.float64) + model["barred"][script]
        states = viterbi(score, counts, penalty)
        text = np.repeat(np.arange(len(own)), counts)
        letters = np.zeros((len(own), len(langs)))
        np.add.at(letters, (text, states), size)
        total, top = letters.sum(1), letters.argmax(1)
        change = np.flatnonzero(np.append(True, (states[1:] != states[:-1]) | (text[1:] != text[:-1])))
        spans: list[list] = [[] for _ in own]
        offset = np.cumsum(counts) - counts
        for i, j in zip(change, np.append(change[1:], len(states))):
            spans[text[i]].append((langs[states[i]], int(i - offset[text[i]]), int(j - i)))
        for k in range(len(own)):
            out.append((langs[top[k]], float(letters[k, top[k]] / total[k]), spans[k]) if total[k] else (UNKNOWN, 0.0, []))
    return out


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH) -> DataFrame:
    """(id, lang_pred, score, spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = label([t or "" for t in batch.column(1).to_pylist()], shared.value, penalty)
            spans = [[{"lang": x, "first_word": i, "n_words": n} for x, i, n in s] for *_, s in found]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)],
                names=["id", "lang_pred", "score", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Rows that the model may not learn from: crc32 of the id's text, modulo 4, is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2
