"""Pack documents into token windows by Karmarkar-Karp multiway differencing.

A document's token ids (with an end id) are cut into full windows and a rest, and
the rest into pieces of at most ``PIECE`` ids, which leave differencing room to
even windows out. Full windows stand alone. Pieces are dealt at random into
groups of about ``GROUP``; within a group differencing starts from one partial partition per
piece and keeps merging the two with the largest imbalance, heaviest window
against lightest, which ends in near-equal windows. The window count begins at
the least that could hold the tokens and rises while any window is above the
capacity.

Null texts are empty documents and hold the end id alone. Repeated rows and rows
without an id are packed like all others. Other columns are not read. A
worker's cache of word ids is emptied at ``CACHE`` words.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

WINDOW = 2048
PIECE = 512
GROUP = 2048
END_ID = 1
CACHE = 690_000  # as many as fit before the table of a dict doubles to 42 MB
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How the tokenizer splits lower-cased text into pieces, and its letters for bytes:
#: printable ones stand for themselves, the others follow from 256. Fixed values.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: White space to Python alone.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class WordIds(dict):
    """Token ids of a white-space separated word, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins pieces across it, so a text's
    ids are those of its words one after another.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if (word.isascii() or max(word) < "\u0250") and "<|" not in word:  # Latin: composed as it is
            low = word.lower()
            core = low.rstrip(punctuation)
            if core.isalpha():  # most words: letters, then perhaps marks
                parts = [core, low[len(core) :]] if len(core) < len(low) else [low]
            else:
                parts = _PIECES(low)
            if parts == [word]:
                letters = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
                ids = array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
            else:  # its pieces are words themselves
                ids = b"".join(map(self.__getitem__, parts))
        else:
            ids = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        text = text or ""
        if any(map(text.__contains__, _SEPARATORS)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))

    def count(self, text: str | None) -> int:
        """How many ids a text has."""
        text = text or ""
        if any(map(text.__contains__, _SEPARATORS)):
            return len(self.text(text)) // 4
        return sum(map(len, map(self.__getitem__, text.split()))) // 4


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own cache; Spark reuses Python workers between tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, piece: int = PIECE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): documents cut at multiples of ``window``, the rest at multiples of ``piece``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.text(text) + end
                full = len(ids) // (4 * window) * 4 * window
                for at in [*range(0, full, 4 * window), *range(full, len(ids), 4 * piece)]:
                    part = ids[at : at + 4 * (window if at < full else piece)]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of ``sizes`` in ``k`` near-equal bins by multiway differencing.

    A partial partition is kept as its non-empty bins, heaviest first; the other
    bins of the ``k`` are empty.
    """
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    spread = lambda bins: bins[0][0] - (bins[-1][0] if len(bins) == k else 0)
    while len(heap) > 1:
        _, tie, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        # b's heaviest bins fall to a's empty ones, the others to a's lightest, heavier to lighter
        merged = b[:free]
        over = b[free:]
        keep = len(a) - len(over)
        merged += a[:keep]
        merged += [(x + y, p + q) for (x, p), (y, q) in zip(reversed(a[keep:]), over)]
        merged.sort(key=lambda bin_: -bin_[0])
        heapq.heappush(heap, (-spread(merged), tie, merged))
    return [bin_ for _, bin_ in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """The least number of differenced bins, from the total upwards, that all fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        bins = difference(sizes, k)
        if all(sum(sizes[i] for i in b) <= capacity for b in bins):
            return bins
        k += 1


def pack(cut: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of at most ``window``."""
    rows = materialise(cut).withColumn("__row", F.monotonically_increasing_id())
    spark = cut.sparkSession
    rests = rows.where(F.col("length") < window)
    groups = max(1, rests.count() // group)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__row")
        sizes = table.column("length").to_pylist()
        first = table.column("__group")[0].as_py() << 24
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for n, bin_ in enumerate(windows(sizes, window)):
            at = 0
            for i in sorted(bin_):
                sequence[i], offset[i] = 2 * (first + n), at  # even; full windows get odd ids
                at += sizes[i]
        return table.drop_columns(["__row", "__group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    out = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    dealt = rests.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    packed = dealt.groupBy("__group").applyInArrow(run, out)
    full = rows.where(F.col("length") == window).withColumns({"sequence_id": 2 * F.col("__row") + 1, "offset": F.lit(0).cast("long")})
    return packed.unionByName(full.select(*cut.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document, with its sequence and its place there."""
    packed = pack(pieces(docs, path or tokenizer_path(), id_col, text_col, window), window)
    return packed.withColumnRenamed("id", id_col)
