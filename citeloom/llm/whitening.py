"""Embedding whitening by the weighted covariance of distinct vectors.

An entry c becomes the whole number x = floor(256 c), and identical x vectors
are one. Each distinct vector enters the fit with a weight, 1 or the number of its
copies: sums of weights and of x, exact, then one centred matrix product a task,
added up by rows of the covariance. Its leading eigenvectors project the centred
vectors, each distinct one once, scaled to variance 1; copies are joined back.

A null vector and one that holds a null, infinite or undefined entry are left
out. An x beyond a long becomes the nearest long. Vectors of another length share
no covariance, so each length has a fit of its own; an empty vector has no
component and no row. A component whose variance is below ``LEAST`` of the
whole, as with a single distinct vector, has a null ``whitened``; without any
variance ``explained`` and ``identity_error`` are null too. ``deviation`` is null
where a long can't hold it. Repeated rows and rows without an id are returned
like all others; other columns are not read. The driver and each task hold
five vectors for each length, and tasks matrices of up to ``HELD`` numbers; vectors
of more than ``WIDEST`` entries are refused. Vectors count as identical by a hash of
128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SCALE = 256
COMPONENTS = 4
LEAST = 1e-12
WIDEST = 4096
HELD = 1 << 23
#: Partial matrices of so many groups of tasks are added up first.
DEAL = 64

_LONG = 1 << 63


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x, d1, d2): whole-numbered vectors with a hash of 128 bits."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.expr("vec IS NOT NULL AND forall(vec, c -> coalesce(abs(c) < double('infinity'), false))"))
    most = float(_LONG - 1024)  # the largest double that is a long
    x = F.transform("vec", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(most)), F.lit(-most))).cast("long"))
    return rows.select("id", x.alias("x")).withColumns({f"d{k}": F.xxhash64(F.lit(k), "x") for k in (1, 2)})


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, x) for the vectors of each length in a batch, of which column ``at`` holds x."""
    sizes = pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        column = batch.column(at) if len(rows) == len(sizes) else batch.column(at).take(pa.array(rows))
        if d:
            yield d, rows, column.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)


def _weights(batch: pa.RecordBatch, weight: str) -> np.ndarray:
    return batch.column(0).to_numpy() if weight == "copies" else np.ones(batch.num_rows, np.int64)


def sums(distinct: DataFrame, weight: str = "one") -> dict[int, tuple[int, list[int]]]:
    """By length: the sum of weights, and of x by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            weights = _weights(batch, weight)
            for d, rows, x in _by_length(batch, 1):
                w, most = weights[rows], float(np.abs(x.astype(np.float64)).max())
                kind = np.int64 if most * float(w.sum()) < 2.0**62 else object
                part = (x.astype(kind) * w.astype(kind)[:, None]).sum(0).astype(object)
                was = total.get(d, [0, 0])
                total[d] = [was[0] + int(w.sum()), was[1] + part]
        out = [(d, k, n, Decimal(int(s))) for d, (n, part) in total.items() for k, s in enumerate(part)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["length", "k", "n", "s"])

    parts = distinct.select("copies", "x").mapInArrow(run, "length int, k int, n long, s decimal(38,0)")
    found: dict[int, list] = {}
    for r in parts.groupBy("length", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("length", "k").toLocalIterator():
        found.setdefault(r.length, [r.n, []])[1].append(int(r.s))
    return {d: (n, s) for d, (n, s) in found.items()}


def covariance(distinct: DataFrame, fit: dict[int, tuple[int, list[int]]], weight: str = "one") -> DataFrame:
    """(length, i, row): the rows of each length's centred covariance."""
    means = {d: np.array([s / n for s in total]) for d, (n, total) in fit.items()}
    if max(means, default=0) > WIDEST:
        raise ValueError(f"vectors of more than {WIDEST} entries are not supported")
    schema = "length int, deal int, i int, row array<double>"

    def rows(held: dict[int, np.ndarray], deal: int) -> Iterator[pa.RecordBatch]:
        for d, v in held.items():
            ends = pa.array(np.arange(d + 1, dtype=np.int32) * d)
            columns = [pa.array(np.full(d, d, np.int32)), pa.array(np.full(d, deal, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, names=["length", "deal", "i", "row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        deal = TaskContext.get().partitionId() % DEAL
        for batch in batches:
            weights = _weights(batch, weight)
            for d, at, x in _by_length(batch, 1):
                z = x - means[d]
                held[d] = held.get(d, 0.0) + (z * weights[at][:, None]).T @ z
                if sum(v.size for v in held.values()) > HELD:
                    yield from rows(held, deal)
                    held.clear()
        yield from rows(held, deal)

    def add(table: pa.Table) -> pa.Table:
        column = table.column("row").combine_chunks()
        total = column.flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        first = table.slice(0, 1)
        return first.set_column(first.schema.get_field_index("row"), "row", pa.array([total.tolist()], pa.list_(pa.float64())))

    parts = distinct.select("copies", "x").mapInArrow(run, schema)
    parts = parts.groupBy("length", "i", "deal").applyInArrow(add, schema)
    return parts.groupBy("length", "i").applyInArrow(add, schema).select("length", "i", "row")


def fit(distinct: DataFrame, weight: str = "one", components: int = COMPONENTS) -> dict[int, dict]:
    """By length: n, sums, and the leading components with their eigenvalues and shares of the trace."""
    totals, models = sums(distinct, weight), {}
    found = materialise(covariance(distinct, totals, weight))
    for d, (n, total) in totals.items():
        v = np.array([r.row for r in found.where(F.col("length") == d).orderBy("i").collect()]) / n
        e, vectors = np.linalg.eigh((v + v.T) / 2)
        top = np.argsort(-e, kind="stable")[:components]
        trace = float(np.trace(v))
        explained = [float(e[k]) / trace if trace > 0 else None for k in top]
        scale = [1 / np.sqrt(e[k]) if trace > 0 and e[k] > LEAST * trace else np.nan for k in top]
        models[d] = {"n": n, "sums": total, "components": vectors[:, top].T, "scale": np.array(scale), "explained": explained}
    return models


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)^2, exact; null beyond a long."""
    reach = float(np.abs(x.astype(np.float64)).max()) * n + max(map(abs, total))
    if reach < 2.0**62 and reach * reach * x.shape[1] < 2.0**62:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(1)
    return [v if v < _LONG else None for v in exact.tolist()]


def project(distinct: DataFrame, models: dict[int, dict]) -> DataFrame:
    """(d1, d2, length, n, deviation, whitened): each distinct vector on the components of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _by_length(batch, 2):
                m = models[d]
                w = (x - np.array([s / m["n"] for s in m["sums"]])) @ m["components"].T * m["scale"]
                at, k = pa.array(rows), w.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(w.ravel(), mask=np.isnan(w.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(rows), d, np.int32)), pa.array(np.full(len(rows), m["n"], np.int64)), pa.array(deviations(x, m["n"], m["sums"]), pa.int64()), lists],
                    names=["d1", "d2", "length", "n", "deviation", "whitened"],
                )

    return distinct.select("d1", "d2", "x").mapInArrow(run, "d1 long, d2 long, length int, n long, deviation long, whitened array<double>")


def identity_error(projected: DataFrame, models: dict[int, dict], weight: str = "one") -> dict[int, float | None]:
    """By length: how far the whitened vectors' covariance, by the fit's weights, is from the identity."""
    k = max((len(m["components"]) for m in models.values()), default=0)
    if not k:
        return {}
    w = [F.get("whitened", F.lit(i)) for i in range(k)]
    size = F.col("copies").cast("double") if weight == "copies" else F.lit(1.0)
    means = projected.groupBy("length").agg(F.sum(size).alias("size"), *[(F.sum(w[i] * size) / F.sum(size)).alias(f"m{i}") for i in range(k)])
    centred = projected.join(F.broadcast(means), "length")  # a row for each length, as the models are
    z = [w[i] - F.col(f"m{i}") for i in range(k)]
    moments = [(F.sum(z[i] * z[j] * size) / F.first("size") - F.lit(float(i == j))) for i in range(k) for j in range(i + 1)]
    found = centred.groupBy("length").agg(F.array_max(F.array(*[F.abs(m) for m in moments])).alias("error")).collect()
    return {r.length: r.error for r in found}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", weight: str = "one", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    if weight not in ("one", "copies"):
        raise ValueError("weight must be one or copies")
    rows = materialise(whole(vectors, id_col, vec_col))
    distinct = materialise(rows.groupBy("d1", "d2").agg(F.first("x").alias("x"), F.count("*").alias("copies")))
    models = fit(distinct, weight, components)
    projected = materialise(project(distinct, models))
    counted = projected.join(distinct.select("d1", "d2", "copies"), ["d1", "d2"]) if weight == "copies" else projected
    errors = identity_error(counted, models, weight)
    spark = rows.sparkSession
    known = [(d, errors.get(d), k + 1, x) for d, m in models.items() for k, x in enumerate(m["explained"])]
    per = spark.createDataFrame(known, "length int, identity_error double, component int, explained double")
    out = rows.select("id", "d1", "d2").join(projected, ["d1", "d2"])
    out = out.select("id", "length", "n", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    out = out.withColumn("component", F.col("k") + 1).join(F.broadcast(per), ["length", "component"])  # a row for each length and component
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
