"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors link at a cosine of ``COSINE`` or more, in double precision. Equal
vectors are joined first. Clusters around fitted centroids overlap: a vector
belongs to its ``overlap`` nearest. Each cluster shard builds a graph from
nearest candidates and a few random far ones, pruned robustly (a candidate is
dropped when a chosen neighbour is closer to it by ``ALPHA``); a vector's
neighbour lists from all its shards are united. The search walks greedily from
the shard's medoids, the query's own node and its neighbours in any shard towards
the query, then expands every node in range until no new one appears. Each cosine is computed,
so nothing below the limit links. Every vector whose id is divisible by ``ASKED``
(by its hash, where ids are no whole numbers) is held against all vectors; if
their recall is under ``RECALL`` the search is repeated with wider overlap and
beam, and after three tries all vectors are compared.

A shard with more than ``CHUNK`` vectors is dealt into chunks, each with a graph
of its own, and each pair of chunks is a task. A task reports link counts and
local components, never all pairs; a pair in several shards counts in the first
that its vectors share, and joins their components wherever it is found.

Centroids are as many as keep shards at about ``CHUNK`` vectors, but none that
would link with another: a group so dense that it draws many of them would else
fall apart into more shards than a vector belongs to. It is one shard, dealt into
chunks. They are fitted
on at most ``SAMPLE`` vectors; where more than ``CENTROIDS`` are needed, those are
fitted within cells, each on at most ``SEEDS`` of its vectors a centroid. All
vectors are indexed. Vectors of different lengths don't link; those of
another length than most are compared with all of their own length. Vectors that
are null, zero, or hold null or non-finite components link with nothing. The
recall of a table whose audited queries have no link is null: not measured.
Repeated rows link like other equal vectors. Labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, materialise
from .simhash_dedup import fold

COSINE = 0.9
SLACK = 0.1
CHUNK = 2048
OVERLAP = 4
BEAM = 32
DEGREE = 32
CANDIDATES = 64
ALPHA = 1.2
MEDOIDS = 8
SAMPLE = 32_768
CENTROIDS = 4096
SEEDS = 16
PART = 8192
AUDIT = 4096
ASKED = 20
RECALL = 0.97


def packed(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """((id, vec), kind): components as bytes of their own type, null where a vector can't link; ``kind`` names that type.

    Vectors travel as they came, floats in half the bytes of doubles; tasks turn
    them into unit vectors of doubles.
    """
    column = F.col(vec_col)
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "<f8"
    column = column if kind == "<f4" else column.cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                x = None if x is None or not len(x) or any(c is None for c in x) else np.array(x, kind)
                out.append(x.tobytes() if x is not None and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "vec"])

    name = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(F.col(id_col).alias("id"), column.alias("v")).mapInArrow(run, f"id {name}, vec binary"), kind


def matrix(column, kind: str) -> np.ndarray:
    """Unit vectors of doubles."""
    values = column.to_pylist()
    x = np.frombuffer(b"".join(values), kind).reshape(len(values), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_centroids(sample: np.ndarray, k: int, steps: int = 4) -> np.ndarray:
    """Spherical k-means of a bounded sample."""
    rng = np.random.default_rng(0)
    centre = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(steps):
        own = np.concatenate([(sample[i : i + 4096] @ centre.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        size = np.sqrt((total**2).sum(1, keepdims=True))
        centre = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centre)
    return centre


def spread(centre: np.ndarray, cosine: float) -> np.ndarray:
    """Of centroids those that would not link with one before them, so that a dense group is one shard and not many."""
    kept = centre[:1]
    for c in centre[1:]:
        if (kept @ c).max() < cosine:
            kept = np.concatenate([kept, c[None]])
    return kept


def fit_spread(sample: np.ndarray, k: int, cosine: float) -> np.ndarray:
    """Up to ``k`` centroids that don't link; those that a dense group loses are fitted anew to what lies outside of it."""
    centre = spread(fit_centroids(sample, k), cosine)
    far = np.concatenate([(sample[i : i + 4096] @ centre.T).max(1) < cosine for i in range(0, len(sample), 4096)])
    if len(centre) < k and far.any():
        centre = spread(np.concatenate([centre, fit_centroids(sample[far], k - len(centre))]), cosine)
    return centre


def build_graph(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each vector of a chunk, robustly pruned, with reverse edges."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    near = min(candidates, n - 1)
    pool = np.argpartition(-cos, near - 1, axis=1)[:, :near]
    rng = np.random.default_rng(n)
    pool = np.concatenate([pool, rng.integers(0, n, (n, 8))], 1)
    closeness = np.take_along_axis(cos, pool, 1)
    order = np.argsort(-closeness, axis=1, kind="stable")
    pool, closeness = np.take_along_axis(pool, order, 1), np.take_along_axis(closeness, order, 1)
    alive = pool != np.arange(n)[:, None]
    far = np.sqrt(np.maximum(2 - 2 * closeness, 0))
    rows = np.arange(n)
    chosen = np.full((n, degree), -1)
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        own = pool[rows, first]
        chosen[some, k] = own[some]
        between = np.sqrt(np.maximum(2 - 2 * cos[own[:, None], pool], 0))
        alive &= alpha * between > far
        alive[rows, first] = False
        alive &= pool != own[:, None]
    a, k = np.nonzero(chosen >= 0)
    b = chosen[a, k]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def range_search(base: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, seeds: list[np.ndarray], beam: int, cosine: float = COSINE, slack: float = SLACK):
    """Yield positions (query, base) at ``cosine`` or more found by greedy search and range expansion.

    ``graph`` has a row of neighbours for each base vector, filled up with -1; a
    query's search begins at ``entries`` and at its own ``seeds``.
    """
    n = len(base)
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        sim = np.full((len(q), n + 1), -3.0)  # the last column takes the filling
        done = np.zeros((len(q), n + 1), bool)
        done[:, n] = True

        def visit(rows, nodes, q=q, sim=sim):
            fresh = sim[rows, nodes] < -2.5
            fresh &= nodes >= 0
            at = np.unique(rows[fresh] * (n + 1) + nodes[fresh])
            rows, nodes = at // (n + 1), at % (n + 1)
            for i in range(0, len(rows), 100_000):
                r, m = rows[i : i + 100_000], nodes[i : i + 100_000]
                sim[r, m] = np.einsum("ij,ij->i", q[r], base[m])

        every = np.arange(len(q))
        visit(np.repeat(every, len(entries)), np.tile(entries, len(q)))
        part = seeds[lo : lo + 256]
        visit(np.repeat(every, [len(x) for x in part]), np.concatenate(part).astype(np.int64))
        width = min(4, n)
        for _ in range(-(-beam // width)):
            open_ = np.where(done, -4.0, sim)
            best = np.argpartition(-open_, width - 1, axis=1)[:, :width]
            rows = np.repeat(every, width)
            nodes = best.ravel()
            live = open_[rows, nodes] > -2.5
            rows, nodes = rows[live], nodes[live]
            if not len(rows):
                break
            done[rows, nodes] = True
            visit(np.repeat(rows, graph.shape[1]), graph[nodes].ravel())
        while True:
            rows, nodes = np.nonzero((sim >= cosine - slack) & ~done)
            if not len(rows):
                break
            done[rows, nodes] = True
            for i in range(0, len(rows), 20_000):
                visit(np.repeat(rows[i : i + 20_000], graph.shape[1]), graph[nodes[i : i + 20_000]].ravel())
        rows, nodes = np.nonzero(sim[:, :n] >= cosine)
        yield rows + lo, nodes


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """Of a chunk: the vector nearest to the mean, and those nearest to a few cluster means."""
    centre = np.concatenate([x.mean(0, keepdims=True), fit_centroids(x, min(k - 1, len(x)), 2)])
    return np.unique((x @ centre.T).argmax(0))


def _task(table: pa.Table, beam: int, cosine: float, kind: str) -> pa.Table:
    """Links of one pair of chunks (i, j) of a shard: weights and local components."""
    table = table.sort_by([("chunk", "ascending"), ("key", "ascending")])
    shard, i, j = (table.column(c)[0].as_py() for c in ("shard", "i", "j"))
    x, key, weight, chunk = matrix(table.column("vec"), kind), *(table.column(c).to_numpy() for c in ("key", "copies", "chunk"))
    shards = np.array(table.column("shards").to_pylist())
    base, query = np.flatnonzero(chunk == j), np.flatnonzero(chunk == i)
    count, label = np.zeros(len(key), np.int64), np.arange(len(key))
    if len(base) and len(query):
        lists = table.column("near").to_pylist()
        own_key = key[base]

        def inside(b: int) -> np.ndarray:
            near = np.array(lists[b] or [], np.int64)
            at = np.minimum(np.searchsorted(own_key, near), len(own_key) - 1)
            return at[own_key[at] == near]

        rows = [inside(b) for b in base]
        graph = np.full((len(base), max(1, max(map(len, rows)))), -1)
        for k, r in enumerate(rows):
            graph[k, : len(r)] = r
        found: list[np.ndarray] = []
        seeds = [np.array([k]) for k in range(len(base))] if i == j else [inside(q) for q in query]
        for a, b in range_search(x[base], graph, medoids(x[base]), x[query], seeds, beam, cosine):
            a, b = query[a], base[b]
            if i == j:  # either end may find a pair
                found.append(np.minimum(a, b)[a != b] * len(key) + np.maximum(a, b)[a != b])
            else:
                found.append(a * len(key) + b)
        pairs = np.unique(np.concatenate(found))
        for lo in range(0, len(pairs), 500_000):
            a, b = pairs[lo : lo + 500_000] // len(key), pairs[lo : lo + 500_000] % len(key)
            common = np.full(len(a), np.iinfo(np.int64).max)
            for m in range(shards.shape[1]):
                both = (shards[b] == shards[a, m][:, None]).any(1)
                common = np.where(both, np.minimum(common, shards[a, m]), common)
            fold(label, a, b)
            mine = common == shard
            a, b = a[mine], b[mine]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
    some = np.flatnonzero((count > 0) | (label != np.arange(len(key))))
    return pa.table({"key": key[some], "links": count[some], "root": key[label[some]]})


def nearest(x: np.ndarray, centre: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, cosines) of the ``most`` nearest of ``centre`` to each vector, the nearest first."""
    most, number, cosine = min(most, len(centre)), [], []
    for i in range(0, len(x), 512):
        cos = x[i : i + 512] @ centre.T
        own = np.argpartition(-cos, most - 1, axis=1)[:, :most]
        at = np.take_along_axis(cos, own, 1)
        order = np.argsort(-at, axis=1, kind="stable")
        number.append(np.take_along_axis(own, order, 1))
        cosine.append(np.take_along_axis(at, order, 1))
    return np.concatenate(number), np.concatenate(cosine)


def _placed(reps: DataFrame, centre: np.ndarray, overlap: int, kind: str) -> DataFrame:
    """``reps`` with ``shards``, the numbers of each vector's nearest centroids; written."""
    shared = reps.sparkSession.sparkContext.broadcast(centre)  # SAMPLE vectors at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = nearest(matrix(batch.column("vec"), kind), shared.value, overlap)[0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "shards"])

    return materialise(reps.mapInArrow(assign, "key long, copies long, vec binary, shards array<long>"))


def _placed_in_cells(reps: DataFrame, cells: np.ndarray, k: int, overlap: int, kind: str, cosine: float) -> DataFrame:
    """As ``_placed`` for about ``k`` centroids, fitted within ``cells``.

    A vector looks at the centroids of its nearest cells. They never meet in one
    place: vectors of a cell are dealt into parts of about ``PART``, and each part
    gets the centroids of its cell.
    """
    each = -(-k // len(cells))
    placed = _placed(reps, cells, overlap, kind)
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("key"), "key"))
    sample = placed.select("key", "vec", F.get("shards", F.lit(0)).alias("cell")).withColumn("rank", rank).where(F.col("rank") <= SEEDS * each)

    def fit(table: pa.Table) -> pa.Table:
        centre = fit_spread(matrix(table.column("vec"), kind), each, cosine)
        return pa.table({"cell": table.column("cell")[:1], "centres": pa.array([centre.tobytes()], pa.binary())})

    fitted = sample.select("cell", "vec").groupBy("cell").applyInArrow(fit, "cell long, centres binary")
    rows = placed.select("key", "vec", F.explode("shards").alias("cell"))
    parts = materialise(rows.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts")))
    rows = rows.join(parts, "cell").select("cell", F.expr("pmod(xxhash64(key), parts)").alias("part"), "key", "vec")
    fitted = fitted.join(parts, "cell").select("cell", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "centres")

    def assign(own: pa.Table, centres: pa.Table) -> pa.Table:
        key, shard, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if own.num_rows and centres.num_rows:  # a cell that is nobody's nearest has no centroids
            x = matrix(own.column("vec"), kind)
            number, cosine = nearest(x, np.frombuffer(centres.column("centres")[0].as_py()).reshape(-1, x.shape[1]), overlap)
            key = np.repeat(own.column("key").to_numpy(), number.shape[1])
            shard, cosine = own.column("cell")[0].as_py() * each + number.ravel(), cosine.ravel()
        return pa.table({"key": key, "shard": shard, "cosine": cosine})

    told = rows.groupBy("cell", "part").cogroup(fitted.groupBy("cell", "part")).applyInArrow(assign, "key long, shard long, cosine double")
    best = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "shard")))["shard"].alias("best"))
    same_size = F.transform(F.sequence(F.lit(0), F.lit(overlap - 1)), lambda i: F.coalesce(F.get("best", i), F.get("best", F.lit(0))))
    return materialise(reps.join(best.select("key", same_size.alias("shards")), "key").select("key", "copies", "vec", "shards"))


def _search(reps: DataFrame, n: int, overlap: int, beam: int, cosine: float, kind: str) -> DataFrame:
    """(key, links, root) of linked vectors, from rows (key, copies, vec)."""
    k = max(1, -(-n * overlap // CHUNK))
    first = k if k <= CENTROIDS else int(np.ceil(np.sqrt(k)))
    sample = reps.orderBy(F.xxhash64("key"), "key").limit(min(SAMPLE, 64 * first)).select("vec").toArrow()
    centre = fit_spread(matrix(sample.column("vec"), kind), first, cosine)
    placed = _placed(reps, centre, overlap, kind) if k <= CENTROIDS else _placed_in_cells(reps, centre, k, overlap, kind, cosine)
    members = placed.select("key", "copies", "vec", "shards", F.explode(F.array_distinct("shards")).alias("shard"))
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    members = members.join(sizes, "shard").withColumn("chunk", F.expr("pmod(xxhash64(key, shard), chunks)"))

    def graph(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        lists = build_graph(matrix(table.column("vec"), kind))
        return pa.table({"key": key, "near": pa.array([key[x].tolist() for x in lists], pa.list_(pa.int64()))})

    edges = members.select("shard", "chunk", "key", "vec").groupBy("shard", "chunk").applyInArrow(graph, "key long, near array<long>")
    union = edges.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # overlap lists each
    tasks = (
        members.join(union, "key").withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
        .withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
        .select("shard", "i", "j", "chunk", "key", "copies", "vec", "shards", "near")
    )
    out = tasks.groupBy("shard", "i", "j").applyInArrow(lambda t: _task(t, beam, cosine, kind), "key long, links long, root long")
    return materialise(out)


def audit(reps: DataFrame, queries: DataFrame, found: DataFrame, cosine: float, kind: str) -> float | None:
    """Recall of ``queries`` (key) against all vectors: the mean of queries with links.

    Queries with more than ``DEGREE`` links and the others are judged apart; the
    lesser counts. None if no query has a link. Queries are dealt into blocks of
    about ``AUDIT`` and vectors into blocks of about ``PART``; a pair of blocks is a task.
    """
    asked = materialise(reps.join(queries, "key", "left_semi").select("key", "vec"))
    m, n = (max(1, -(-rows.count() // size)) for rows, size in ((asked, AUDIT), (reps, PART)))

    def run(own: pa.Table, base: pa.Table) -> pa.Table:
        key, truth = own.column("key").to_numpy(), np.zeros(own.num_rows, np.int64)
        if own.num_rows and base.num_rows:
            x, y = matrix(own.column("vec"), kind), matrix(base.column("vec"), kind)
            other, weight = base.column("key").to_numpy(), base.column("copies").to_numpy()
            for i in range(0, len(x), 512):
                near = (x[i : i + 512] @ y.T >= cosine) & (key[i : i + 512, None] != other[None, :])
                truth[i : i + 512] = near @ weight
        return pa.table({"key": key, "truth": truth})

    own = lambda k: F.expr(f"pmod(xxhash64(key), {k}L)")
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = asked.withColumn("i", own(m)).withColumn("j", every(n)).groupBy("i", "j")
    right = reps.select("key", "copies", "vec").withColumn("j", own(n)).withColumn("i", every(m)).groupBy("i", "j")
    truth = left.cogroup(right).applyInArrow(run, "key long, truth long").groupBy("key").agg(F.sum("truth").alias("truth"))
    seen = found.groupBy("key").agg(F.sum("links").alias("links"))
    share = F.least(F.coalesce("links", F.lit(0)) / F.col("truth"), F.lit(1.0))
    means = truth.join(seen, "key", "left").where("truth > 0").groupBy(F.col("truth") > DEGREE).agg(F.avg(share).alias("mean"))
    return means.agg(F.min("mean")).first()[0]


def _exact(reps: DataFrame, cosine: float, kind: str) -> DataFrame:
    """As ``_search``, by comparing all pairs of vectors of one length; each pair of chunks is a task."""

    def run(table: pa.Table) -> pa.Table:
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        x, key, weight, chunk = matrix(table.column("vec"), kind), *(table.column(c).to_numpy() for c in ("key", "copies", "chunk"))
        base, query = np.flatnonzero(chunk == j), np.flatnonzero(chunk == i)
        count, label = np.zeros(len(key), np.int64), np.arange(len(key))
        for lo in range(0, len(query), 256):
            own = query[lo : lo + 256]
            a, b = np.nonzero(x[own] @ x[base].T >= cosine)
            a, b = own[a], base[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            np.add.at(count, a, weight[b])
            np.add.at(count, b, weight[a])
            fold(label, a, b)
        some = np.flatnonzero(count)
        return pa.table({"key": key[some], "links": count[some], "root": key[label[some]]})

    rows = reps.withColumn("size", F.length("vec"))
    sizes = rows.groupBy("size").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks"))
    rows = rows.join(sizes, "size").withColumn("chunk", F.expr("pmod(xxhash64(key), chunks)")).withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
    tasks = rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).select("size", "i", "j", "chunk", "key", "copies", "vec")
    return materialise(tasks.groupBy("size", "i", "j").applyInArrow(run, "key long, links long, root long"))


def link(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept, audit_recall) of every row."""
    rows, kind = packed(vectors, id_col, vec_col)
    rows = materialise(rows.withColumns({"d1": F.xxhash64(F.lit(1), "vec"), "d2": F.xxhash64(F.lit(2), "vec")}))
    lengths = rows.where("vec IS NOT NULL").groupBy(F.length("vec").alias("b")).count()
    usual = lengths.orderBy(F.desc("count"), "b").first()
    reps = rows.where("vec IS NOT NULL").groupBy("d1", "d2").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    reps = materialise(reps.withColumn("key", F.monotonically_increasing_id()))
    main = F.length("vec") == (usual["b"] if usual else -1)
    points = reps.where(main).select("key", "copies", "vec")
    whole = rows.schema["id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    asked = rows.where((F.col("id") if whole else F.xxhash64("id")) % ASKED == 0).select("d1", "d2").distinct()
    asked = materialise(reps.join(asked, ["d1", "d2"], "left_semi").select("key"))
    n, recall, overlap, beam = points.count(), None, OVERLAP, BEAM
    found = materialise(points.select("key", F.lit(0).cast("long").alias("links"), F.col("key").alias("root")).limit(0))
    for _ in range(3 if n > 1 else 0):
        found = _search(points, n, overlap, beam, cosine, kind)
        recall = audit(points, asked, found, cosine, kind)
        if recall is None or recall >= RECALL:
            break
        overlap, beam = overlap + 2, 2 * beam
    if recall is not None and recall < RECALL:
        found = _exact(points, cosine, kind)
        recall = audit(points, asked, found, cosine, kind)
    if lengths.count() > 1:
        found = found.unionByName(_exact(reps.where(~main).select("key", "copies", "vec"), cosine, kind))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))).toDF("key", "root")
    told = reps.select("d1", "d2", "key", "least", "copies").join(links, "key", "left").join(parts, "key", "left")
    told = materialise(told.withColumn("root", F.coalesce("root", "key")))
    least = told.groupBy("root").agg(F.min("least").alias("component"))
    told = told.join(least, "root").select("d1", "d2", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"))
    linked = rows.where("vec IS NOT NULL").select("id", "d1", "d2").join(told, ["d1", "d2"]).select("id", "component", "n")
    alone = rows.where("vec IS NULL").select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("n"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"),
        F.col("component").eqNullSafe(F.col("id")).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"),
    )
