"""SentencePiece encoding and decoding by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across; what lies
between two cuts is a word, and words that a worker has not met are encoded many
at a time. Their symbols lie in one flat array. In each round every word finds
the least rank among its adjacent pairs, all pairs of that rank are merged at
once, the leftmost first where they overlap, and the array is compacted, until no
word has a pair left. That is the order in which the sentencepiece library merges,
but for two cases, both kept apart when a model is read:

- a piece that a better one begins or ends with: merging it may make a better
  pair, so a round ends in each word with the first that does;
- pieces of one repeated character that tie on the worst score, as the runs of
  spaces do: what the rounds leave of a run is merged from the left.

A space becomes the piece mark, one more stands before a text that is not empty,
and a character outside the vocabulary becomes its UTF-8 bytes. Models that
normalise otherwise, or lack pieces for bytes, are refused. A null text is an
empty one and holds the end id alone. Repeated rows and rows without an id are
encoded like all others; other columns are not read. A worker remembers at most
``CACHE`` words of up to ``LONGEST`` characters and works on ``FLAT`` characters
at a time, unless a single word has more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CACHE = 300_000
LONGEST = 48
FLAT = 400_000
#: Texts held as Python objects at a time.
ROWS = 250

_NONE = np.iinfo(np.int32).max
_DEAD = -2


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """A model's vocabulary as arrays, and the words encoded so far."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        probe = "  a \n \t b　ﬁ "
        if sp.normalize(probe) != (MARK + probe).replace(" ", MARK):
            raise ValueError("a model that normalises its text is not supported")
        n = sp.get_piece_size()
        texts = [sp.id_to_piece(i) for i in range(n)]
        byte = {int(texts[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if len(byte) < 256:
            raise ValueError("a model without pieces for bytes is not supported")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        score = {texts[i]: sp.get_score(i) for i in plain}
        ids = {texts[i]: i for i in plain}
        self.size, self.end, self.kind = n, sp.eos_id(), np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.bytes = np.array([byte[b] for b in range(256)], np.int32)
        # runs of one character that tie on the worst score
        joined = [t for t in score if len(t) > 1]
        worst = min((score[t] for t in joined), default=0.0)
        tied = {t for t in joined if score[t] == worst}
        tied = tied if len(tied) > 1 else set()
        run = {t[0] for t in tied}
        if len(run) > 1 or any(len(set(t)) > 1 for t in tied):
            raise ValueError("a model whose pieces tie otherwise than as runs of one character is not supported")
        self.run = ids[run.pop()] if run else -1
        self.runs = {1: self.run} | {len(t): ids[t] for t in tied}
        joined = sorted((t for t in joined if t not in tied), key=lambda t: -score[t])
        if len({score[t] for t in joined}) < len(joined):
            raise ValueError("a model with pieces of one score is not supported")
        rank = {t: k for k, t in enumerate(joined)}
        self.piece = np.array([ids[t] for t in joined], np.int32)
        pairs = [(ids[t[:k]], ids[t[k:]], r) for t, r in rank.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
        key = np.array([a * n + b for a, b, _ in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = np.append(key[order], 1 << 62), np.append(np.array([r for *_, r in pairs], np.int32)[order], _NONE)
        # a piece with which a better one begins or ends
        self.alone = np.zeros(len(joined) + 1, bool)
        for a, b, r in pairs:
            for part in (texts[a], texts[b]):
                if rank.get(part, -1) > r:
                    self.alone[rank[part]] = True
        self.char = np.full(0x110000, -1, np.int32)
        for t, i in ids.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        self.inside = np.array(sorted({ord(a) << 21 | ord(b) for t in (*joined, *tied) for a, b in zip(t, t[1:])} | {1 << 62}), np.int64)
        # how texts are cut: at characters that join nothing, and between letters and marks that join no letter, unless a
        # character that joins both is next to them; spaces go with what follows them
        touch = [(chr(k >> 21), chr(k & 0x1FFFFF)) for k in self.inside[:-1].tolist()]
        met = {c for t in (*joined, *tied) for c in t}
        marks = {c for c in met if not c.isalpha() and c != MARK}
        both = {c for pair in touch if MARK not in pair and (pair[0] in marks) != (pair[1] in marks) for c in pair} & marks
        apart, marks, both = (re.escape("".join(sorted(x))) for x in ({*map(chr, range(128))} - met - {" "}, marks - both, both))
        unless = f"(?![{both}])" if both else ""
        kinds = [f"[{apart}]+"] * bool(apart) + [f" *[{marks}]++{unless}"] * bool(marks) + [f" *[^ {apart}{marks}{both}]++{unless}", f" *[^ {apart}]+", " +"]
        self.words = re.compile("|".join(kinds)).findall
        self.text = [b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else bytes([int(t[1:-1], 16)]) if sp.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(texts)]
        self.known: dict[str, bytes] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word; spaces stand for the mark."""
        code = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        n = len(code)
        cut = np.ones(n + 1, bool)  # cut[i]: nothing reaches from i - 1 to i
        pair = code[:-1] << 21 | code[1:]
        cut[1:n] = (word[1:] != word[:-1]) | (self.inside[np.searchsorted(self.inside, pair)] != pair)
        final = np.full(n, _DEAD, np.int32)
        sym, pos, seg = self.char[code], np.arange(n), np.cumsum(cut[:n])
        rank = np.full(n, _NONE, np.int32)
        inner = np.flatnonzero(~cut[1:n])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            live = np.repeat(least < _NONE, size)
            final[pos[~live]] = sym[~live]
            if not live.any():
                break
            best = np.repeat(least, size)[live]
            sym, pos, seg, rank = sym[live], pos[live], seg[live], rank[live]
            hit = np.flatnonzero(rank == best)
            # of pairs that overlap each second
            fresh = np.append(True, np.diff(hit) > 1)
            start = np.flatnonzero(fresh)
            hit = hit[(hit - np.repeat(hit[start], np.diff(np.append(start, len(hit))))) % 2 == 0]
            if self.alone[rank[hit]].any():
                hit = self._until_better(sym, seg, rank, hit)
            sym[hit] = self.piece[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            hit = hit - np.searchsorted(hit, hit)  # places after compaction
            sym, pos, seg, rank = sym[keep], pos[keep], seg[keep], rank[keep]
            stale = np.zeros(len(sym) + 1, bool)  # pairs of which a symbol is new; that before the first wraps to the end
            stale[hit], stale[hit - 1] = True, True
            stale = np.flatnonzero(stale[:-1])
            rank[stale] = _NONE
            stale = stale[stale + 1 < len(sym)]
            stale = stale[seg[stale] == seg[stale + 1]]
            rank[stale] = self._ranks(sym[stale], sym[stale + 1])
        at = np.flatnonzero(final != _DEAD)
        ids, at = self._tile(final[at], at, word)
        return self._slice(ids, code[at], word[at], len(words))

    def _until_better(self, sym: np.ndarray, seg: np.ndarray, rank: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """The pairs to merge, in each word up to the first whose merging makes a better pair with a neighbour."""
        new, some = self.piece[rank[hit]], self.alone[rank[hit]]
        left = np.where(hit > 0, sym[hit - 1], -1)
        left[1:] = np.where(hit[1:] - hit[:-1] == 2, new[:-1], left[1:])
        right = sym[np.minimum(hit + 2, len(sym) - 1)]
        left[(hit == 0) | (seg[hit - 1] != seg[hit])] = -1
        right[(hit + 2 >= len(sym)) | (seg[np.minimum(hit + 2, len(sym) - 1)] != seg[hit])] = -1
        better = np.zeros(len(hit), bool)
        better[some] = np.minimum(self._ranks(left[some], new[some]), self._ranks(new[some], right[some])) < rank[hit[some]]
        before = np.cumsum(better) - better
        first = np.flatnonzero(np.append(True, seg[hit][1:] != seg[hit][:-1]))
        return hit[before == np.repeat(before[first], np.diff(np.append(first, len(hit))))]

    def _tile(self, ids: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the repeated piece, merged from the left."""
        same = ids == self.run
        joined = same[1:] & same[:-1] & (word[at[1:]] == word[at[:-1]])
        if self.run < 0 or not joined.any():
            return ids, at
        keep, start = np.ones(len(ids), bool), np.flatnonzero(np.append(True, ~joined))
        size = np.diff(np.append(start, len(ids)))
        for s, n in zip(start[size > 1].tolist(), size[size > 1].tolist()):
            tiles: list[int] = []
            for _ in range(n):
                tiles.append(1)
                while len(tiles) > 1 and tiles[-2] + tiles[-1] in self.runs:
                    tiles[-2:] = [tiles[-2] + tiles[-1]]
            keep[s : s + n] = False
            places = s + np.cumsum([0, *tiles[:-1]])
            keep[places], ids[places] = True, [self.runs[t] for t in tiles]
        return ids[keep], at[keep]

    def _slice(self, ids: np.ndarray, code: np.ndarray, word: np.ndarray, n: int) -> list[bytes]:
        """The ids of each word, with bytes in place of characters that the vocabulary lacks."""
        lost = np.flatnonzero(ids < 0)
        if len(lost):
            wide = np.ones(len(ids), np.int64)
            wide[lost] += (code[lost] >= 0x80).astype(np.int64) + (code[lost] >= 0x800) + (code[lost] >= 0x10000)
            start = np.cumsum(wide) - wide
            raw = np.frombuffer(code[lost].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            place = np.repeat(start[lost], wide[lost]) + np.arange(len(raw)) - np.repeat(np.cumsum(wide[lost]) - wide[lost], wide[lost])
            ids, word = np.repeat(ids, wide), np.repeat(word, wide)
            ids[place] = self.bytes[raw]
        buffer, end = ids.astype(self.kind).tobytes(), np.cumsum(np.bincount(word, minlength=n)) * self.kind.itemsize
        ends = end.tolist()
        return [buffer[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, the end id last."""
        parts = [self.words(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        new = list(set().union(*parts).difference(self.known))
        a = 0
        while a < len(new):
            b, chars = a, 0
            while b < len(new) and (b == a or chars + len(new[b]) <= FLAT):
                chars += len(new[b])
                b += 1
            self.known.update(zip(new[a:b], self.merge(new[a:b])))
            a = b
        end, ids = np.array([self.end], self.kind).tobytes(), self.known.__getitem__
        out = [np.frombuffer(b"".join(map(ids, p)) + end, self.kind) for p in parts]
        if len(self.known) > CACHE:
            self.known.clear()
        for w in new:
            if len(w) > LONGEST:
                self.known.pop(w, None)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, without the space that encoding put before it."""
        out = b"".join(map(self.text.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """The worker's own; Spark reuses Python workers between tasks."""
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids): token ids of every text with an end id; with ``decoded`` also the text that they decode to."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in slices(batches, ROWS):
            rows = model.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.concatenate(rows).astype(np.int32) if rows else np.zeros(0, np.int32)
            columns = {"id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}
            if decoded:
                columns["decoded"] = pa.array([model.decode(x).decode("utf-8", "replace") for x in rows], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the text of each array of ids that ``encode`` made; a null array or id is left out of it.

    Ids must lie in the vocabulary. Bytes that are no UTF-8 become U+FFFD.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in slices(batches, ROWS):
            texts = [model.decode(np.array([i for i in x or [] if i is not None], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, decoded string")
