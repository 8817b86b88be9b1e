"""Quality rules: base counts and n-gram perplexity bands.

Perplexity comes from a modified Kneser-Ney model of letters, order ``ORDER``,
for each language, and one of all languages together. Spark counts n-grams over
the whole corpus; counts of counts, contexts and continuation counts are
aggregations, and the recursive probabilities joins, over the table of n-gram
types. An n-gram is kept whole, so types grow with the corpus and nothing is
folded together.

A model that has seen a document would find it likely, whatever it says. So the
corpus is dealt into two halves by a hash of the text (copies fall together),
both are counted, and a document is scored by the model of the other half.

Scoring gathers nothing on the driver: the first pass over the documents gives
the n-gram types of each input partition, these are joined with the model, and
written as one file for each input partition. The second pass reads the file of
its own partition as sorted hash arrays. Documents must come in the same
partitions twice, as a written table does; an n-gram that is missing from a
partition's file is an error.

A text's score is the mean log probability of its letters. Pieces of ``PIECE``
letters that are ``FOREIGN`` less likely than their language's mean are scored
by the model of all languages, if they are no more than ``MOST_FOREIGN`` of the
text: so a quotation in another language makes no outlier, a text that is not in
its language does. A document is rejected when its score lies outside its
language's band: the quartiles of the documents that pass the base rules, taken
from a histogram, widened by ``UNLIKELY`` times their distance below and by
``PREDICTABLE`` times above, where near copies of a text lie, and more for short
documents, whose means scatter more.

Null texts have no words and fail the base rules. A null language is a language
of its own. Rows are judged by themselves: repeated rows and null ids are kept.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialise, shared_dir

ORDER = 4
UNLIKELY = 3.0
PREDICTABLE = 6.0
SHORT = 100  # words at which a band is wider by the square root of two
PIECE = 64
FOREIGN = 0.5
MOST_FOREIGN = 0.5
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT = 30  # per cent
STEP = 0.001  # of the histogram of scores
_START = "\x02"  # pads the beginning of a text
_SLICE = 2_000_000
_KIND = np.zeros(256, np.uint8)  # of a byte: 1 continues a code point, 2 white space, 3 a symbol
_KIND[0x80:0xC0] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 2
_KIND[[ord(c) for c in "#*$%&|<>"]] = 3


def base_counts(texts: list[str]) -> np.ndarray:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each text."""
    out = np.zeros((len(texts), 5), np.int64)
    hashes = []
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=4)
        lines = Counter(x for x in raw.split(b"\n") if x.strip())
        out[k, :4] = len(words), kinds[0] + kinds[3], kinds[3], lines.total() - len(lines)
        hashes.append(np.fromiter(map(hash, words), np.int64, len(words)))
    n = out[:, 0]
    words = np.concatenate(hashes).view(np.uint64) if hashes else np.zeros(0, np.uint64)
    if len(words) < WINDOW:
        return out
    text = np.repeat(np.arange(len(texts)), n)
    begins = len(words) - WINDOW + 1
    rolled = np.zeros(begins, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + words[j : j + begins]
            rolled ^= rolled >> np.uint64(31)
        rolled = (rolled ^ text[:begins].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + text[:begins].astype(np.uint64)
    inside = text[:begins] == text[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    same = pa.array(rolled[at]).dictionary_encode().indices.to_numpy()
    twice = at[np.bincount(same)[same] >= 2] if len(at) else at
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    out[:, 4] = np.bincount(text, weights=np.cumsum(edge[:-1]) > 0, minlength=len(texts))
    return out


def fold_of(text: str) -> int:
    """The half of the corpus that a text counts for."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) & 1


def _hash(windows: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, rows of code points."""
    out = np.zeros(len(windows), np.uint64)
    with np.errstate(over="ignore"):
        for c in windows.T:
            out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xD6E8FEB86659FD93)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, hashes, sizes): the n-gram that ends at each character of the texts, and the characters of each text."""
    pad = _START * (ORDER - 1)
    code = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.arange(sizes.sum()) + np.repeat((ORDER - 1) * np.arange(len(texts)), sizes)
    windows = np.lib.stride_tricks.sliding_window_view(code, ORDER) if len(code) >= ORDER else np.zeros((0, ORDER), np.uint32)
    return windows[first], _hash(windows)[first], sizes


def _strings(code: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    width = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).sum(1)
    data = code.astype("<u4").tobytes().decode("utf-32-le").encode()
    offsets = np.concatenate(([0], np.cumsum(width))).astype(np.int32)
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _slices(texts: list[str]) -> Iterator[slice]:
    """Slices of some ``_SLICE`` characters; none is empty but that of no texts."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _SLICE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts) or not texts:
        yield slice(start, len(texts))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(p, lang, key, n0, n1): counts of every n-gram of the highest order in both halves by input partition, from rows (lang, text)."""

    def merge(held: list[pa.Table]) -> list[pa.Table]:
        names = ["lang", "key", "n0", "n1"]
        return [pa.concat_tables(held).group_by(names[:2]).aggregate([("n0", "sum"), ("n1", "sum")]).rename_columns(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            groups: dict[tuple, list[str]] = {}
            for lang, text in zip(*(batch.column(k).to_pylist() for k in ("lang", "text"))):
                groups.setdefault((lang, fold_of(text)), []).append(text)
            for (lang, fold), own in groups.items():
                for part in _slices(own):
                    code, h, _ = _grams(own[part])
                    seen = pa.array(h).dictionary_encode().indices.to_numpy()
                    n = np.bincount(seen) if len(seen) else np.zeros(0, np.int64)
                    at = np.zeros(len(n), np.int64)
                    at[seen] = np.arange(len(seen))  # any place of each
                    held.append(pa.table({"lang": pa.array([lang] * len(n), pa.string()), "key": _strings(code[at]), f"n{fold}": n, f"n{1 - fold}": np.zeros_like(n)}).select(["lang", "key", "n0", "n1"]))
            if sum(map(len, held)) > 2_000_000:
                held = merge(held)
        p = TaskContext.get().partitionId()
        for table in merge(held) if held else []:
            table = table.add_column(0, "p", pa.array(np.full(len(table), p)))
            yield from table.to_batches(max_chunksize=100_000)

    return docs.mapInArrow(run, "p long, lang string, key string, n0 long, n1 long")


def _discounts(types: DataFrame) -> DataFrame:
    """(lang, d<fold>_<1, 2, 3>): modified Kneser-Ney discounts of both halves from counts of counts."""
    n = [F.greatest(F.count_if(F.col(f"n{f}") == k), F.lit(1)).alias(f"c{f}_{k}") for f in (0, 1) for k in (1, 2, 3, 4)]
    c = lambda f, k: F.col(f"c{f}_{k}")
    y = lambda f: c(f, 1) / (c(f, 1) + 2 * c(f, 2))
    d = [F.least(F.greatest(k - (k + 1) * y(f) * c(f, k + 1) / c(f, k), F.lit(0.1)), F.lit(k - 0.1)).alias(f"d{f}_{k}") for f in (0, 1) for k in (1, 2, 3)]
    return types.groupBy("lang").agg(*n).select("lang", *d)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, key, n0, n1, p0, p1): of each n-gram of the highest order the counts of both halves, and its probability by the model of each.

    Takes rows (lang, key, n0, n1). An n-gram that a half has not seen backs off
    there; all of a language's n-grams are known to its probabilities.
    """
    tables = {order: counts}
    for m in range(order - 1, 0, -1):  # continuation counts: in how many types of the next order it is the end
        ends = tables[m + 1].groupBy("lang", F.substring("key", -m, m).alias("key"))
        tables[m] = materialise(ends.agg(*[F.count_if(F.col(f"n{f}") > 0).alias(f"n{f}") for f in (0, 1)]))
    lower = None
    for m in range(1, order + 1):
        types = join_small(tables[m], materialise(_discounts(tables[m])), "lang", "key")
        cut = lambda f: F.when(F.col(f"n{f}") == 0, 0.0).when(F.col(f"n{f}") == 1, F.col(f"d{f}_1")).when(F.col(f"n{f}") == 2, F.col(f"d{f}_2")).otherwise(F.col(f"d{f}_3"))
        types = types.withColumns({"context": F.substring("key", 1, m - 1), "cut0": cut(0), "cut1": cut(1)})
        sums = [F.sum(f"n{f}").alias(f"total{f}") for f in (0, 1)] + [F.sum(f"cut{f}").alias(f"mass{f}") for f in (0, 1)]
        context = types.groupBy("lang", "context").agg(*sums, F.count("*").alias("width"))
        rows = types.join(context, ["lang", "context"])
        if m == 1:
            below = lambda f: 1.0 / (F.col("width") + 1)  # a character of the language, or one not seen
        else:
            rows = rows.withColumn("end", F.substring("key", -(m - 1), m - 1))
            rows = rows.join(lower.select("lang", F.col("key").alias("end"), F.col("p0").alias("b0"), F.col("p1").alias("b1")), ["lang", "end"])
            below = lambda f: F.col(f"b{f}")
        p = lambda f: F.when(F.col(f"total{f}") > 0, (F.col(f"n{f}") - F.col(f"cut{f}")) / F.col(f"total{f}") + F.col(f"mass{f}") / F.col(f"total{f}") * below(f)).otherwise(below(f))
        lower = materialise(rows.select("lang", "key", "n0", "n1", p(0).alias("p0"), p(1).alias("p1")))
    return lower


#: The model of all languages; no language code holds this character.
_ALL = "\x02"


def model_files(rows: DataFrame) -> str:
    """Write the model as each input partition needs it, and return the folder.

    Files of (lang, key, own0, own1, all0, all1): log probabilities for the texts of each half, by the model of the
    other one. An empty key stands for a language's mean log probability.
    """
    parts = materialise(count_ngrams(rows), compression="zstd")
    types = materialise(parts.groupBy("lang", "key").agg(*[F.sum(f"n{f}").alias(f"n{f}") for f in (0, 1)]))
    every = types.groupBy(F.lit(_ALL).alias("lang"), "key").agg(*[F.sum(f"n{f}").alias(f"n{f}") for f in (0, 1)])
    model = kneser_ney(types.unionByName(every))
    value = lambda name: [F.log(f"p{1 - f}").cast("float").alias(f"{name}{f}") for f in (0, 1)]
    own = model.where(F.col("lang") != _ALL)
    mean = own.groupBy("lang").agg(((F.sum(F.col("n0") * F.log("p1") + F.col("n1") * F.log("p0"))) / F.sum(F.col("n0") + F.col("n1"))).cast("float").alias("mean"))
    told = own.select("lang", "key", *value("own")).join(model.where(F.col("lang") == _ALL).select("key", *value("all")), "key")
    each = parts.select("p", "lang", "key").join(told, ["lang", "key"])
    names = ["own0", "own1", "all0", "all1"]
    means = parts.select("p", "lang").distinct().join(mean, "lang").select("p", "lang", F.lit("").alias("key"), *[F.col("mean").alias(n) for n in names])
    at, n = shared_dir(rows.sparkSession), max(1, parts.select("p").distinct().count())
    each.unionByName(means).select("p", "lang", "key", *names).repartition(n, "p").write.option("compression", "zstd").partitionBy("p").parquet(at)
    return at


class Model:
    """The sorted hash arrays of one input partition, by language."""

    def __init__(self, at: str, p: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(at)
        self.means, self.arrays = {}, {}
        if store.get_file_info(f"{base}/p={p}").type == fs.FileType.NotFound:
            return
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(f"{base}/p={p}")) if f.path.endswith(".parquet"))
        table = pa.concat_tables([pq.ParquetFile(store.open_input_file(f)).read() for f in files])
        for lang, rows in table.select(["lang"]).to_pandas().groupby("lang").indices.items():
            own = table.take(pa.array(rows))
            whole = own.filter(pc.not_equal(own.column("key"), ""))
            self.means[lang] = own.filter(pc.equal(own.column("key"), "")).column("own0")[0].as_py()
            code = np.frombuffer("".join(whole.column("key").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
            h = _hash(code)
            order = np.argsort(h)
            self.arrays[lang] = h[order], {c: whole.column(c).to_numpy()[order] for c in ("own0", "own1", "all0", "all1")}

    def look(self, lang: str, fold: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of n-grams by hash: by the language's model and by that of all."""
        hashes, values = self.arrays.get(lang, (np.zeros(0, np.uint64), {}))
        seen = pa.array(h).dictionary_encode()
        key, place = seen.dictionary.to_numpy(), seen.indices.to_numpy()
        at = np.minimum(np.searchsorted(hashes, key), max(len(hashes) - 1, 0))
        if len(key) and (not len(hashes) or (hashes[at] != key).any()):
            raise ValueError("the documents changed between the passes")
        return tuple(values[f"{name}{fold}"][at][place].astype(np.float64) for name in ("own", "all"))


def text_scores(texts: list[str], lang: str, fold: int, model: Model) -> np.ndarray:
    """Mean log probability of each text's characters, nan for none."""
    _, h, sizes = _grams(texts)
    pieces = -(-sizes // PIECE)
    if not pieces.sum():
        return np.full(len(texts), np.nan)
    own, all_ = model.look(lang, fold, h)
    first = np.cumsum(sizes) - sizes
    start = np.repeat(first, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    total, other, length = np.add.reduceat(own, start), np.add.reduceat(all_, start), np.diff(np.append(start, len(own)))
    text = np.repeat(np.arange(len(texts)), pieces)
    weak = total < (model.means[lang] - FOREIGN) * length
    share = np.bincount(text, weights=weak * length, minlength=len(texts)) / np.maximum(sizes, 1)
    total = np.where(weak & (share <= MOST_FOREIGN)[text], np.maximum(total, other), total)
    return np.bincount(text, weights=total, minlength=len(texts)) / np.where(sizes > 0, sizes, np.nan)


def measure(docs: DataFrame, at: str, id_col: str = "doc_id") -> DataFrame:
    """(id, lang, base counts, score): score is the mean log probability of the text's characters, null for none."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(at, TaskContext.get().partitionId())
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts = np.concatenate([base_counts(texts[part]) for part in _slices(texts)])
            score, groups = np.full(len(texts), np.nan), {}
            for k, (lang, text) in enumerate(zip(langs, texts)):
                groups.setdefault((lang, fold_of(text)), []).append(k)
            for (lang, fold), rows in groups.items():
                own = [texts[k] for k in rows]
                for part in _slices(own):
                    score[rows[part]] = text_scores(own[part], lang, fold, model)
            columns = [pa.array(c) for c in counts.T.copy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(score, from_pandas=True)], names=["id", "lang", *names, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), "lang", "text")
    return rows.mapInArrow(run, f"id {kind}, lang string, {', '.join(f'{n} long' for n in names)}, score double")


def bands(measured: DataFrame) -> DataFrame:
    """(lang, low, high): quartiles of scores of documents that pass the base rules, to ``STEP``; the same on each run."""
    bins = measured.where(~F.col("base_failed") & F.col("score").isNotNull()).groupBy("lang", F.floor(F.col("score") / STEP).alias("bin")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("lang")  # a language's bins, not its documents
    bins = bins.withColumns({"upto": F.sum("n").over(whole.orderBy("bin")), "all": F.sum("n").over(whole)})
    quarter = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin"))) * STEP)
    return bins.groupBy("lang").agg(quarter(0.25).alias("low"), quarter(0.75).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = UNLIKELY, above: float = PREDICTABLE) -> DataFrame:
    """(id, base counts, base_failed, log_probability, kept) of every row."""
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # one projection for both passes, so that both have the same partitions
    measured = measure(rows, model_files(rows), id_col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    measured = materialise(measured.withColumn("base_failed", failed))
    room = (F.col("high") - F.col("low")) * F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))
    inside = F.coalesce(F.col("score").between(F.col("low") - below * room, F.col("high") + above * room), F.lit(False))
    return join_small(measured, materialise(bands(measured)), "lang", "id").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("score").alias("log_probability"), (~F.col("base_failed") & inside).alias("kept"),
    )
