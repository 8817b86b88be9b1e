"""Quality classifier by co-training.

Two logistic classifiers see a document from different sides: its text content
(hashed words and pairs of words, shares of character classes, word shapes and
repetition) and the page metadata around it (source, language and length). Over
``ROUNDS`` each one labels the unlabelled documents that it is surest of, for
the other to learn from. Both are then calibrated on labelled documents that
neither learned from, and their calibrated log odds add up to a score for every
document.

Labelled rows come from a bounded sample, at most ``LABELLED`` documents chosen
by hash. Unlabelled rows are all rows: features are computed once and written to
the shared folder; in each round a histogram of calibrated log odds over all of
them gives the thresholds of the surest ``SURE`` share, and each step of Newton's
method adds up gradients and Hessians in Spark. A view teaches only what it is
``CERTAIN`` of, by what its odds turn out to be worth on labelled documents. Pseudo-labels together weigh ``WEIGHT``
times the labelled rows, however many they are. A document is kept at ``score
>= KEEP``.

Null and empty texts have all-zero content and score like other documents. A
document labelled more than once has its worst label; of rows that share an id
one stands for the labelled document. Rows are scored by themselves: repeated
rows and null ids are kept, and missing ``lang`` and ``source`` columns are taken
as null. Without labels of both classes every document is kept with score 0.5.
Other columns pass through ``filter_quality`` whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

LABELLED = 8_000
ROUNDS = 3
STEPS = 5
LONGEST = 2.0  # of a weight's change in a step
SURE = 0.1  # share of the unlabelled rows that a view labels in a round, half for each class
CERTAIN = 3.0  # calibrated log odds
WEIGHT = 0.3
KEEP = 0.5
WORDS = 64  # buckets of hashed words, and as many of pairs
_ONE_HOT = 64
_BINS = 6_000  # of log odds from -30 to 30
_GROUPS = 32

CLASSES = ("letters", "upper", "digits", "white space", "symbols", "punctuation", "bars", "exclamation marks", "other")
_CLASS = np.full(256, 8, np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in "#*$%&<>@^~_=+/\\{}[]"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()?-"]] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("!")] = 7


def content_features(text: str | None) -> np.ndarray:
    """Shares of byte classes, word shapes and repetition, and of hashed words and pairs of words, over the whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(CLASSES) + 5 + 2 * WORDS)
    if not raw:
        return out
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=len(CLASSES)) / len(raw)
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x]
    out[: len(CLASSES)] = share
    h = np.fromiter(map(zlib.crc32, raw.lower().split()), np.uint32, len(words))
    out[len(CLASSES) : len(CLASSES) + 5] = len(set(words)) / n, len(raw) / n / 10, (h[1:] == h[:-1]).mean() if n > 1 else 0, len(set(lines)) / max(1, len(lines)), 1.0
    pairs = (h[1:] * np.uint32(0x9E3779B1)) ^ h[:-1]
    for at, own in ((-2 * WORDS, h), (-WORDS, (pairs * np.uint32(0x85EBCA6B)) >> np.uint32(8))):
        # lengths of one, so that long and short texts have features of one size
        counts = np.bincount(own % WORDS, minlength=WORDS)
        out[at : at + WORDS or None] = counts / max(1.0, np.sqrt((counts**2).sum()))
    return out


def metadata_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Hashed source and language, and length."""
    out = np.zeros(_ONE_HOT + 2)
    for name in (f"source={source}", f"lang={lang}"):
        out[zlib.crc32(name.encode("utf-8", "surrogatepass")) % _ONE_HOT] = 1.0
    out[-2:] = np.log1p(len(text or "")) / 10, 1.0
    return out


def views_of(texts, langs, sources) -> tuple[np.ndarray, np.ndarray]:
    """Both views of rows, in half precision as they are stored."""
    stack = lambda rows, width: np.array(rows, np.float16).reshape(-1, width)
    return (
        stack([content_features(t) for t in texts], len(CLASSES) + 5 + 2 * WORDS),
        stack([metadata_features(*x) for x in zip(texts, langs, sources)], _ONE_HOT + 2),
    )


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        step *= min(1.0, LONGEST / np.abs(step).max()) if step.any() else 1.0
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient, Hessian and rows of the logistic loss, as one flat array."""
    p = _sigmoid(x @ w)
    return np.concatenate([x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [len(y)]])


def total(rows: DataFrame, of: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray], size: int) -> np.ndarray:
    """Sum over rows (content, meta) of what ``of`` gives for a batch; added up in a fixed order, in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                out += of(tuple(_matrix(batch.column(k)) for k in ("content", "meta")))
        yield pa.RecordBatch.from_pydict({"task": [TaskContext.get().partitionId()], "sums": pa.array([out.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, least = np.zeros(size), None
        for batch in batches:
            for task, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                least = task if least is None else least
                out += np.frombuffer(sums)
        if least is not None:
            yield pa.RecordBatch.from_pydict({"task": [least], "sums": pa.array([out.tobytes()], pa.binary())})

    kind = "task long, sums binary"
    parts = rows.select("content", "meta").mapInArrow(run, kind).repartition(_GROUPS, "task").sortWithinPartitions("task").mapInArrow(add, kind).collect()
    return sum((np.frombuffer(r["sums"]) for r in sorted(parts, key=lambda r: r["task"])), np.zeros(size))


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float16).reshape(len(values), -1).astype(np.float64)


def thresholds(counts: np.ndarray, share: float) -> tuple[float, float]:
    """Log odds at and below, and at and above, which half of ``share`` of a histogram lies; never beyond what a view is sure of by sign."""
    k = max(1.0, counts.sum() * share / 2)
    edge = lambda c: int(np.searchsorted(np.cumsum(c), k))
    width = 60 / _BINS
    return min(-CERTAIN, -30 + width * (edge(counts) + 1)), max(CERTAIN, 30 - width * (edge(counts[::-1]) + 1))


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Callable, rounds: int = ROUNDS, steps: int = STEPS) -> dict:
    """Weights of both views and their calibrations.

    ``y`` is 0 or 1; each third row is held for calibration. ``pool(of, size)``
    sums ``of`` over the unlabelled rows.
    """
    hold = np.arange(len(y)) % 3 == 2
    given = [v[~hold] for v in views]
    weights = [fit(x, y[~hold], np.ones((~hold).sum())) for x in given]

    def calibrated():
        """Scale and shift of each view's log odds, by labelled documents that it did not learn from."""
        return [fit(np.stack([views[v][hold] @ weights[v], np.ones(hold.sum())], 1), y[hold], np.ones(hold.sum()), ridge=0.01) for v in (0, 1)]

    for _ in range(rounds):
        frozen = [(w * c[0], c[1]) for w, c in zip(weights, calibrated())]

        def histogram(x, frozen=frozen):
            at = [np.clip(((x[v] @ frozen[v][0] + frozen[v][1] + 30) / 60 * _BINS).astype(np.int64), 0, _BINS - 1) for v in (0, 1)]
            return np.concatenate([np.bincount(a, minlength=_BINS).astype(float) for a in at])

        counts = pool(histogram, 2 * _BINS)
        if not counts.sum():
            break
        limits = [thresholds(counts[v * _BINS : (v + 1) * _BINS], SURE) for v in (0, 1)]
        sizes = [len(w) + len(w) ** 2 + 1 for w in weights]
        for _ in range(steps):

            def slopes(x, frozen=frozen, limits=limits, weights=weights):
                out = []
                for v in (0, 1):  # learns from what the other view is sure of
                    odds = x[1 - v] @ frozen[1 - v][0] + frozen[1 - v][1]
                    low, high = limits[1 - v]
                    sure = (odds <= low) | (odds >= high)
                    out.append(_slopes(x[v][sure], (odds[sure] > 0).astype(float), weights[v]))
                return np.concatenate(out)

            sums, moved = pool(slopes, sum(sizes)), 0.0
            for v, part in enumerate(np.split(sums, [sizes[0]])):
                d = len(weights[v])
                own = _slopes(given[v], y[~hold], weights[v])
                each = WEIGHT * len(given[v]) / part[-1] if part[-1] else 0.0  # all pseudo-labels together weigh a share of the labels
                g = own[:d] + each * part[:d] + weights[v]
                h = (own[d:-1] + each * part[d:-1]).reshape(d, d) + np.eye(d)
                step = np.linalg.solve(h, g)
                step *= min(1.0, LONGEST / np.abs(step).max()) if step.any() else 1.0
                weights[v] = np.round(weights[v] - step, 6)
                moved = max(moved, np.abs(step).max())
            if moved < 1e-3:
                break
    held, scales = np.flatnonzero(hold), calibrated()
    both = np.stack([views[v][held] @ weights[v] * scales[v][0] + scales[v][1] for v in (0, 1)] + [np.ones(len(held))], 1)
    return {"weights": weights, "scales": scales, "blend": fit(both, y[held], np.ones(len(held)), ridge=0.01)}


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content, meta) of every row; both views as bytes of half floats."""
    rows = docs.select(F.col(id_col).alias("id"), *[F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("text", "lang", "source")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            content, meta = views_of(*[batch.column(k).to_pylist() for k in ("text", "lang", "source")])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r.tobytes() for r in x], pa.binary()) for x in (content, meta)]], names=["id", "content", "meta"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, content binary, meta binary")


def train(features: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict | None:
    """Fit on a bounded sample of labelled rows and on all unlabelled rows of ``features``."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    ids = known.join(features.select("id").distinct(), "id").orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    chosen = features.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min(F.struct("content", "meta")).alias("x"))  # LABELLED rows at most
    got = sorted(chosen.select("id", "y", "x.*").collect(), key=lambda r: (zlib.crc32(repr(r["id"]).encode()), r["id"]))
    y = np.array([r["y"] for r in got], float)
    if len(set(y.tolist())) < 2 or len(y) < 12:
        return None
    views = tuple(_matrix(pa.array([r[k] for r in got], pa.binary())) for k in ("content", "meta"))
    some = features.where("id IS NOT NULL").join(known.select("id"), "id", "left_anti")
    free = materialise(some.unionByName(features.where("id IS NULL")).select("content", "meta"))
    return co_train(views, y, lambda of, size: total(free, of, size))


def score_rows(model: dict | None, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probability of good quality."""
    if model is None:
        return np.full(len(views[0]), 0.5)
    both = [views[v].astype(np.float64) @ model["weights"][v] * model["scales"][v][0] + model["scales"][v][1] for v in (0, 1)]
    odds = both[0] * model["blend"][0] + both[1] * model["blend"][1] + model["blend"][2]
    return _sigmoid(odds)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score, kept) of every document."""
    rows = materialise(features(docs))
    model = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = score_rows(model, tuple(_matrix(batch.column(k)) for k in ("content", "meta")))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), pa.array(own >= KEEP)], names=["doc_id", "score", "kept"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, score double, kept boolean")


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier keeps, with all their columns."""
    model = train(materialise(features(docs)), labels)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc = batch.column(0)
            names = [doc.type.field(k).name for k in range(doc.type.num_fields)]
            texts, langs, sources = (doc.field(names.index(c)).to_pylist() if c in names else [None] * len(doc) for c in ("text", "lang", "source"))
            keep = pa.array(score_rows(model, views_of(texts, langs, sources)) >= KEEP)
            yield pa.RecordBatch.from_arrays([doc.filter(keep)], names=["doc"])

    return whole.mapInArrow(run, whole.schema).select("doc.*")
