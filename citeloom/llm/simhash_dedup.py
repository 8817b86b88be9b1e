"""SimHash near-duplicates by a binary-trie self-join.

Two settings share the walk over the trie. It takes pairs of trie nodes
together, adds up differing bits and prunes a pair of nodes when the budget is
exceeded.

``near_duplicates``: fingerprints of 64 bits link when they differ in at most
``BUDGET`` bits. Four bands of 16 bits cannot all differ within a budget of
three, so each linked pair agrees on a band: for each band the fingerprints are
rotated to start with it and shuffled on its value, which deals out the top of
the trie. A band value with more than ``BLOCK`` distinct fingerprints is dealt
out further, by the trie's next bits: each pair of prefixes within the budget is
a task of its own, so no link is lost.

``keep_one``: fingerprints of 256 bits over shingles of five words link when
they differ in at most ``WIDE`` bits, as texts whose shingles have a Jaccard
similarity of 0.8 do on average. The fingerprint is an estimate, so texts whose
sets of shingles have that similarity link too, whatever their fingerprints:
``shingle_join`` finds them all. For the fingerprints no band must agree at such a distance, but one
of thirteen differs in ``APART`` bits at most. Distinct fingerprints are dealt
into at most ``DEALT`` blocks, and each pair of blocks is a group of its own:
for each band one block is looked up in a table of the other, with those bits
turned over, and the pairs that meet are compared whole. No pair within the
budget is lost. Some 0.33 % of all pairs meet, so at size the time still grows
with the square of the distinct texts, at that share.

Copies share one fingerprint and are joined as one. A task reports the
components it finds as stars, never all pairs. Null and word-less texts have
fingerprint zero and link like any other. Repeated rows are kept as rows by
``near_duplicates``; rows without an id are kept and never give a component its
id. Other columns are not read and pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingle_join
from .common import connected_components, materialise, partitions, slices

BUDGET = 3
BLOCK = 4096
SHINGLE = 3
SEED = 42
WORDS = 4  # of 64 bits in a wide fingerprint
WIDE = 38
WIDE_SHINGLE = 5
APART = 2  # bits by which a band of a wide fingerprint differs at most
WIDE_BLOCK = 1 << 15  # wide fingerprints in a block, until there are ``DEALT`` blocks
DEALT = 16  # blocks of wide fingerprints, each sent to as many groups
WIDEST = 1 << 19  # fingerprints in a block, whatever their number
_TILE = 8192
_FEW = _TILE**2  # pairs of two blocks that are compared without bands
_TABLE = 20  # bits of a band at most
_MET = 1 << 16  # pairs that meet at a time
_DENSE = 4  # bands are left when they have let one of so many pairs through
DEEPEST = 16  # bits by which a heavy band is dealt out
_LANES = np.uint64(0x0101010101010101)
_FLUSH = 1_000_000
_COMPARED = 200_000  # pairs in leaves at a time


def _hashes(text: str | None, n: int) -> list[int]:
    """XXH64 of each n-word shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    return [digest(view[i:j], SEED) for i, j in zip([0, *(g + 1 for g in gaps)], [*gaps[n - 1 :], len(joined)])]


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes: bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    blocks = -(-n // 255)  # a byte lane holds sums of up to 255 bits
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    own = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    start = np.repeat(first - 255 * own, blocks) + 255 * np.arange(blocks.sum())
    bits = np.zeros(len(full), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, start)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), own, axis=0)
        for k, most in enumerate((2 * sums > n[:, None]).T):
            bits |= most.astype(np.uint64) << np.uint64(8 * k + b)
    out[full] = bits
    return out


def fingerprint_texts(texts, n: int = SHINGLE) -> np.ndarray:
    """Fingerprints of texts as unsigned 64-bit integers."""
    parts, held, counts, size = [], [], [], 0
    for text in texts:
        h = _hashes(text, n)
        held.append(np.array(h, np.uint64))
        counts.append(len(h))
        size += len(h)
        if size >= _FLUSH:
            parts.append(_majority(np.concatenate(held), np.array(counts)))
            held, counts, size = [], [], 0
    if counts:
        parts.append(_majority(np.concatenate(held), np.array(counts)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def wide_fingerprints(texts, n: int = WIDE_SHINGLE) -> np.ndarray:
    """Fingerprints of ``WORDS`` unsigned 64-bit integers, from as many mixes of each shingle's hash."""
    return _wide([np.array(_hashes(t, n), np.uint64) for t in texts])


def _wide(held: list[np.ndarray]) -> np.ndarray:
    counts = np.array([len(h) for h in held])
    out = np.zeros((len(held), WORDS), np.uint64)
    parts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(counts) // _FLUSH)) + 1, [len(held)]))
    for lo, hi in zip(parts, parts[1:]):
        if hi > lo and counts[lo:hi].any():
            h = np.concatenate(held[lo:hi])
            for k in range(WORDS):
                with np.errstate(over="ignore"):
                    x = (h ^ np.uint64(k * 0x2545F4914F6CDD1D & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
                    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    x ^= x >> np.uint64(32)
                out[lo:hi, k] = _majority(x, counts[lo:hi])
    return out


def _wide_hashes(text: str | None) -> list[int]:
    return _hashes(text, WIDE_SHINGLE)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed 64-bit integer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fp": fingerprint_texts(pdf["text"], n).view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, fp long")


def fold(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labels of linked positions, in place; each label becomes the least position of its component."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (jumped := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = jumped


def trie_pairs(fp: np.ndarray, nodes: np.ndarray, depth: int, budget: int = BUDGET, leaf: int = 64, wide: int = 50_000):
    """Yield positions (i, j) of fingerprints within ``budget`` bits.

    ``fp`` has a row of words for each fingerprint and is sorted inside each node. ``nodes`` has a row (a_from, a_to,
    b_from, b_to) for each pair of trie nodes whose first ``depth`` bits agree;
    a node paired with itself stands for the pairs inside it.
    """
    ones: dict[int, np.ndarray] = {}

    def middle(lo, hi, d):
        if d not in ones:
            ones[d] = np.concatenate(([0], np.cumsum((fp[:, d // 64] >> np.uint64(63 - d % 64)) & np.uint64(1)).astype(np.int64)))
        return hi - (ones[d][hi] - ones[d][lo])

    stack = [(depth, nodes, np.zeros(len(nodes), np.int16))]
    while stack:
        d, n, diff = stack.pop()
        if len(n) > wide:  # bounded memory: the second half waits
            half = len(n) // 2
            stack += [(d, n[half:], diff[half:]), (d, n[:half], diff[:half])]
            continue
        size = (n[:, 1] - n[:, 0]) * (n[:, 3] - n[:, 2])
        small = (size <= leaf) | (d == 64 * fp.shape[1])
        if small.any():
            parts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(size[small]) // _COMPARED)) + 1, [small.sum()]))
            for lo, hi in zip(parts, parts[1:]):
                s, count = n[small][lo:hi], size[small][lo:hi]
                width = s[:, 3] - s[:, 2]
                pair = np.repeat(np.arange(len(s)), count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                i, j = s[pair, 0] + at // width[pair], s[pair, 2] + at % width[pair]
                near = (np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= budget) & ((s[pair, 0] != s[pair, 2]) | (i < j))
                if near.any():
                    yield i[near], j[near]
        n, diff = n[~small], diff[~small]
        if not len(n):
            continue
        am, bm = middle(n[:, 0], n[:, 1], d), middle(n[:, 2], n[:, 3], d)
        same = n[:, 0] == n[:, 2]
        kids = [
            (np.stack([n[:, 0], am, n[:, 2], bm], 1), diff, None),
            (np.stack([am, n[:, 1], bm, n[:, 3]], 1), diff, None),
            (np.stack([n[:, 0], am, bm, n[:, 3]], 1), diff + 1, None),
            (np.stack([am, n[:, 1], n[:, 2], bm], 1), diff + 1, ~same),  # in a self-pair the mirror image
        ]
        rows, diffs = [], []
        for kid, k, only in kids:
            keep = (kid[:, 1] > kid[:, 0]) & (kid[:, 3] > kid[:, 2]) & (k <= budget)
            keep = keep if only is None else keep & only
            rows.append(kid[keep])
            diffs.append(k[keep])
        stack.append((d + 1, np.concatenate(rows), np.concatenate(diffs)))


def _rotated(fp: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Fingerprints turned to start with their band."""
    turn = 16 * band.astype(np.uint64) % np.uint64(64)
    return np.where(turn == 0, fp, (fp << turn) | (fp >> ((np.uint64(64) - turn) % np.uint64(64))))


def _stars(words: np.ndarray, node: np.ndarray, keys: list[np.ndarray], depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) nodes linked in whole groups of rows, as stars of local components; ``keys`` are band, value, i, j, block."""
    order = np.lexsort((*words.T[::-1], *keys[::-1]))
    words, keys = words[order], [k[order] for k in keys]
    change = np.zeros(len(order), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    lo = np.flatnonzero(change)
    hi = np.append(lo[1:], len(order))
    i, j, block = (k[lo] for k in keys[2:])
    own = i == j
    first = np.flatnonzero(~own & (block == i))
    first = first[first + 1 < len(lo)]
    first = first[np.all([k[lo[first + 1]] == k[lo[first]] for k in keys[:4]], axis=0) & (block[first + 1] == j[first])]
    nodes = np.concatenate([
        np.stack([lo[own], hi[own], lo[own], hi[own]], 1),
        np.stack([lo[first], hi[first], lo[first + 1], hi[first + 1]], 1),
    ])
    labels = np.arange(len(order))
    for a, b in trie_pairs(words, nodes, depth, budget):
        fold(labels, a, b)
    moved = labels != np.arange(len(order))
    node = node[order]
    return node[moved], node[labels[moved]]


def _walk(rows: DataFrame, stars) -> DataFrame:
    """(a, b) from rows with band, value, i, j, block; whole groups are taken together, many small ones at a time."""
    keys = ["band", "value", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1)
            if not last.all():
                yield pd.DataFrame(dict(zip("ab", stars(pdf[~last]))))
            held = pdf[last]
        if held is not None:
            yield pd.DataFrame(dict(zip("ab", stars(held))))

    parts = rows.repartition(partitions(rows.sparkSession), *keys)
    return parts.sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def _group_keys(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [pdf[c].to_numpy(np.int64) for c in ("band", "value", "i", "j", "block")]


def _masks(spark: SparkSession, most: int, budget: int) -> DataFrame:
    """(bits, masks): for each number of bits the differences of prefixes within the budget."""
    some = [sorted({sum(1 << x for x in c) for k in range(budget + 1) for c in combinations(range(d), k)}) for d in range(most + 1)]
    return spark.createDataFrame(list(enumerate(some)), "bits int, masks array<long>")


def fingerprint_links(fps: DataFrame, budget: int = BUDGET, block: int = BLOCK) -> DataFrame:
    """(a, b) edges whose components are those of all pairs of fingerprints within ``budget`` (3 at most) bits."""
    if not 0 <= budget <= 3:
        raise ValueError("four bands need a budget of three bits at most")
    band = F.posexplode(F.array(*[F.shiftrightunsigned("fp", 48 - 16 * k).bitwiseAND(0xFFFF) for k in range(4)]))
    rows = fps.select("fp", band.alias("band", "value"))
    # a heavy band's fingerprints by the next bits of the trie, which double the nodes at each level
    heavy = rows.groupBy("band", "value").count().where(F.col("count") > block)
    bits = F.least(F.ceil(F.log2(F.col("count") / block)), F.lit(DEEPEST)).cast("int")
    heavy = heavy.select("band", "value", bits.alias("bits")).join(_masks(fps.sparkSession, DEEPEST, budget), "bits")
    shift = lambda way, by: F.call_function(way, F.col("fp"), by.cast("int"))
    turned = shift("shiftleft", 16 * F.col("band") + 16).bitwiseOR(shift("shiftrightunsigned", 48 - 16 * F.col("band")))
    turned = F.when(F.col("band") == 3, F.col("fp")).otherwise(turned)  # the bits after the band
    rows = rows.join(heavy, ["band", "value"], "left").withColumn("bits", F.coalesce("bits", F.lit(0)))
    rows = rows.withColumn("block", F.when(F.col("bits") > 0, F.call_function("shiftrightunsigned", turned, 64 - F.col("bits"))).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("mask", F.explode(F.coalesce("masks", F.array(F.lit(0).cast("long"))))).withColumn("other", F.col("block").bitwiseXOR(F.col("mask")))
    rows = rows.select("fp", "band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")

    def stars(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        fp = pdf["fp"].to_numpy(np.int64)
        own = _rotated(np.ascontiguousarray(fp).view(np.uint64), pdf["band"].to_numpy(np.uint64))
        return _stars(own[:, None], fp, _group_keys(pdf), 16, budget)

    return _walk(rows, stars)


def _near(a: np.ndarray, b: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` of all fingerprints that differ in ``budget`` bits at most, by tiles; two words of each pair are looked at before the rest."""
    columns = np.ascontiguousarray(b.T)
    for lo in range(0, len(b), _TILE):
        first, second = columns[:2, lo : lo + _TILE]
        for top in range(0, len(a), 16):
            rows = a[top : top + 16]
            apart = np.bitwise_count(rows[:, 0, None] ^ first)
            apart += np.bitwise_count(rows[:, 1, None] ^ second)
            i, j = np.nonzero(apart <= budget)
            if len(i):
                i, j = i + top, j + lo
                near = np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64) <= budget
                yield i[near], j[near]


def _band(words: np.ndarray, at: int, width: int) -> np.ndarray:
    """The ``width`` bits of each fingerprint from bit ``at`` on."""
    k, shift = divmod(at, 64)
    out = words[:, k] >> np.uint64(shift)
    if shift + width > 64:
        out |= words[:, k + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << width) - 1)).astype(np.int64)


def _meetings(a: np.ndarray, b: np.ndarray, budget: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pairs of which some band differs in ``APART`` bits at most: how many met, and the positions in ``a`` and ``b`` of those whose first half is within ``budget``.

    All pairs within ``budget`` bits are among them, some more than once.
    """
    bands = max(budget // (APART + 1) + 1, -(-64 * WORDS // _TABLE))
    for k in range(bands):
        low = k * 64 * WORDS // bands
        width = (k + 1) * 64 * WORDS // bands - low
        masks = [sum(1 << x for x in c) for m in range(APART + 1) for c in combinations(range(width), m)]
        own, other = (_band(x, low, width) for x in (a, b))
        i, j = np.argsort(own), np.argsort(other)  # neighbours are looked up one after another
        own, count = own[i], np.bincount(other, minlength=1 << width)
        first, some = np.cumsum(count) - count, count > 0
        halves = [(np.ascontiguousarray(a[i, w]), np.ascontiguousarray(b[j, w])) for w in (0, 1)]
        for mask in masks:
            turned = own ^ mask
            whose = np.flatnonzero(some[turned])
            turned = turned[whose]
            times, start = count[turned], first[turned]
            upto = np.cumsum(times)
            parts = np.concatenate(([0], np.flatnonzero(np.diff(upto // _MET)) + 1, [len(times)]))
            for lo, hi in zip(parts, parts[1:]):
                n = times[lo:hi]
                before = upto[lo:hi] - n
                met = int(n.sum())
                at = np.arange(met) + np.repeat(start[lo:hi] - before + before[:1], n)
                by = np.repeat(whose[lo:hi], n)
                (x, y), (z, v) = halves
                near = np.flatnonzero(np.bitwise_count(x[by] ^ y[at]) + np.bitwise_count(z[by] ^ v[at]) <= budget)
                yield met, i[by[near]], j[at[near]]


def _close(a: np.ndarray, b: np.ndarray, budget: int, apart) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` of fingerprints that differ in ``budget`` bits at most; pairs that are not ``apart`` any more may be left out."""
    pairs = len(a) * len(b)
    left = pairs // _DENSE if pairs > _FEW else -1
    for met, i, j in _meetings(a, b, budget) if left >= 0 else ():
        left -= met
        if left < 0:
            break
        if len(i) and (open_ := apart(i, j)).any():
            i, j = i[open_], j[open_]
            near = np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64) <= budget
            yield i[near], j[near]
    if left < 0:
        yield from _near(a, b, budget)


def _linked(words: np.ndarray, block: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions linked in one group of two blocks, or of one with itself, as stars of local components."""
    labels = np.arange(len(words))
    sides = sorted((np.flatnonzero(block == k) for k in np.unique(block)), key=len)
    held: list[np.ndarray] = []
    for i, j in _close(words[sides[0]], words[sides[-1]], budget, lambda i, j: labels[sides[0][i]] != labels[sides[-1][j]]):
        held.append(np.stack([sides[0][i], sides[-1][j]]))
        if sum(h.shape[1] for h in held) > _COMPARED:
            fold(labels, *np.concatenate(held, axis=1))
            held = []
    if held:
        fold(labels, *np.concatenate(held, axis=1))
    moved = np.flatnonzero(labels != np.arange(len(words)))
    return moved, labels[moved]


def wide_links(fps: DataFrame, n: int, budget: int = WIDE, block: int = WIDE_BLOCK) -> DataFrame:
    """(a, b) edges whose components are those of all pairs of the ``n`` rows (key, fp) whose wide fingerprints differ in at most ``budget`` bits."""
    blocks = max(1, min(-(-n // block), DEALT), -(-n // WIDEST))
    rows = (
        fps.withColumn("block", F.expr(f"pmod(xxhash64(key), {blocks}L)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        .select("key", "fp", F.lit(0).alias("band"), F.lit(0).alias("value"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    )

    def stars(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        out = [(np.zeros(0, np.int64),) * 2]
        for (i, j), own in pdf.groupby(["i", "j"], sort=False):
            if i != j and own["block"].nunique() < 2:
                continue
            words, key = np.frombuffer(b"".join(own["fp"]), np.uint64).reshape(len(own), WORDS), own["key"].to_numpy(np.int64)
            out.append(tuple(key[at] for at in _linked(words, own["block"].to_numpy(), budget)))
        return tuple(np.concatenate(x) for x in zip(*out))

    return _walk(rows, stars)


def classes(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(fp, root) for each distinct fingerprint; those of one component share a root."""
    distinct = materialise(fps.select("fp").distinct())
    found = connected_components(fingerprint_links(distinct, budget)).withColumnRenamed("node", "fp")
    return distinct.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): component_id is the least id in the component."""
    rows = materialise(fingerprints(docs, id_col, text_col))
    roots = materialise(classes(rows))
    by_fp = rows.groupBy("fp").agg(F.min("id").alias("least"))
    least = roots.join(by_fp, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(roots.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, the one with the least id (first of repeated rows); columns stay as they are."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    at = docs.columns.index(text_col)
    late = shingle_join.late_shingles(docs.select(F.col(f"`{text_col}`").alias("text")), _wide_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held = [np.array(_wide_hashes(t), np.uint64) for t in batch.column(0).field(at).to_pylist()]
            fps = [x.tobytes() for x in _wide(held)]
            size, first, parity, sets = shingle_join.describe(held, late)
            keys = pa.array(map(shingle_join.set_key, fps, sets), pa.int64())
            more = [pa.array(fps, pa.binary()), keys, pa.array(size, pa.int64()), pa.array(first, pa.binary()), pa.array(parity, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["doc", "row", "fp", "key", "size", "first", "parity"])

    def sets(some: DataFrame) -> DataFrame:
        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = [np.unique(np.array(_wide_hashes(t), np.uint64)).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["key", "set"])

        return some.select("key", F.col("doc").getField(text_col).alias("text")).mapInArrow(own, "key long, set binary")

    more = {"fp": F.lit(b""), "key": F.lit(0).cast("long"), "size": F.lit(0).cast("long"), "first": F.lit(b""), "parity": F.lit(b"")}
    rows = materialise(whole.mapInArrow(run, whole.withColumns(more).schema))
    own = F.col("doc").getField(id_col)
    least = F.struct(own.isNull().alias("no_id"), own.alias("id"), F.col("row"))
    nodes = materialise(rows.groupBy("key").agg(F.min(least).alias("least"), *[F.first(c).alias(c) for c in ("fp", "size", "parity")]))
    n = nodes.count()
    found = connected_components(wide_links(nodes.select("key", "fp"), n)).withColumnRenamed("node", "key")
    nodes = materialise(nodes.drop("fp").join(found, "key", "left").withColumn("root", F.coalesce("component", "key")).drop("component"))
    joined = shingle_join.join_components(rows, nodes, n, sets)
    groups = nodes.select("least", "root").join(joined, "root", "left").groupBy(F.coalesce("component", "root").alias("root"))
    kept = groups.agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")
