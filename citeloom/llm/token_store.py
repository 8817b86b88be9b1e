"""Materialise token sequences in training order, as fixed-stride binary shards.

Each input partition is one stream of token ids, documents ended by an end id,
cut into sequences of ``LENGTH`` ids; the stream's last sequence is padded. The
texts are tokenized once: the streams are written, compressed, to the shared
folder, and their sizes number all sequences 0..N-1. A keyed Feistel permutation
over the next power of four, walked along its cycle until it falls below N, gives
every number a slot of its own, so the training order is a random permutation
that needs no shuffle list and can be inverted. Sequences are then partitioned
by ranges of slots, of about ``RANGE`` bytes and whole shards; between tasks
those of one range travel together, compressed. A task puts its range in order
and writes shards of ``SHARD`` slots. In a shard every sequence has the same
stride, so a reader resumes at any slot by seeking.

Ids take two bytes; a tokenizer with more than 65,536 ids is refused. Null texts
hold the end id alone. Repeated rows and rows without an id are written like all
others. An empty table gives no shard. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices
from .packing import END_ID, tokenizer_path, word_ids

LENGTH = 512
SHARD = 4096
KEY = 0x5EED
#: Bytes of sequences that a writing task holds, and sequences that a task holds before it passes them on.
RANGE = 64 << 20
HELD = 16_384
BLOCK = 64
ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mix of half-blocks and a round key."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _half(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(index: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Slots of numbers below ``n`` (or with ``inverse`` numbers of slots), by cycle-walking."""
    half = np.uint64(_half(n))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [(key * 0x2545F4914F6CDD1D + r * 0xB5297A4D3F84D5B5) & (2**64 - 1) for r in range(ROUNDS)]

    def once(x):
        left, right = x >> half, x & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (_mix(left, k) & mask), left
            else:
                left, right = right, left ^ (_mix(right, k) & mask)
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(n)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _streams(batches: Iterator[pa.RecordBatch], words, width: int) -> Iterator[bytes]:
    """The ids of a partition's texts in pieces of ``width`` bytes; the last one may be shorter."""
    end, held = np.array([END_ID], "<u2").tobytes(), bytearray()
    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            held += np.frombuffer(words.text(text), "<u4").astype("<u2").tobytes() + end
            if len(held) >= 2 * width:
                whole = len(held) // width * width
                yield from (bytes(held[i : i + width]) for i in range(0, whole, width))
                del held[:whole]
    yield from (bytes(held[i : i + width]) for i in range(0, len(held), width))


def tokenized(docs: DataFrame, path: str, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(p, first, n, ids): the stream of each input partition ``p`` in blocks of ``n`` bytes from byte ``first`` on, compressed; written to the shared folder."""
    if word_ids(path).tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids of more than 16 bits don't fit the shards")
    width = 2 * length * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, first, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3).compress
        for own in _streams(batches, word_ids(path), width):
            yield pa.RecordBatch.from_pydict({"p": [p], "first": [first], "n": [len(own)], "ids": pa.array([pack(own)], pa.binary())})
            first += len(own)

    return materialise(docs.select(text_col).mapInArrow(run, "p long, first long, n long, ids binary"), compression="uncompressed")


def sequences(streams: DataFrame, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> tuple[DataFrame, int, int]:
    """((range, n, slots, sizes, ids), total, slots in a range): sequences with their slots in the training order, those of one range together."""
    stride = 2 * length
    sizes = streams.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()  # a number for each input partition
    first, total = {}, 0
    for r in sizes:
        first[r["p"]], total = total, total - (-r["n"] // stride)
    wide = shard * max(1, RANGE // (shard * stride))
    end = np.array([END_ID], "<u2").tobytes()
    shared = streams.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        number, size, held = [], [], []

        def give() -> pa.RecordBatch:
            slot = permute(np.concatenate(number), total, key)
            order = np.argsort(slot)
            slot, tokens = slot[order], np.concatenate(size)[order]
            rows = np.frombuffer(b"".join(held), "<u2").reshape(-1, length)[order]
            cut = np.append(np.flatnonzero(np.diff(slot // wide, prepend=-1)), len(slot))
            parts = list(zip(cut, cut[1:]))
            return pa.RecordBatch.from_arrays([
                pa.array([slot[i] // wide for i, _ in parts], pa.int64()), pa.array([j - i for i, j in parts], pa.int64()),
                pa.array([pack((slot[i:j] % wide).astype("<u4").tobytes()) for i, j in parts], pa.binary()),
                pa.array([pack(tokens[i:j].astype("<u4").tobytes()) for i, j in parts], pa.binary()),
                pa.array([pack(rows[i:j].tobytes()) for i, j in parts], pa.binary()),
            ], names=["range", "n", "slots", "sizes", "ids"])

        for batch in batches:
            for p, at, n, ids in zip(*[batch.column(k).to_pylist() for k in ("p", "first", "n", "ids")]):
                own = -(-n // stride)
                number.append(shared.value[p] + at // stride + np.arange(own))
                size.append(np.minimum(n - stride * np.arange(own), stride) // 2)
                held.append(unpack(ids) + end * ((own * stride - n) // 2))
                if sum(map(len, size)) >= HELD:
                    yield give()
                    number, size, held = [], [], []
        if held:
            yield give()

    return streams.mapInArrow(run, "range long, n long, slots binary, sizes binary, ids binary"), total, wide


def write_shards(slotted: DataFrame, total: int, wide: int, path: str, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Write ``path/shard-NNNNNN.bin`` and return the manifest (shard, first_slot, n_sequences, n_tokens, n_bytes, crc32).

    A file is written under a task's own name and then moved, so a repeated or
    speculative task leaves the same whole file. ``path`` is any URI that
    ``pyarrow.fs`` opens and that all executors share.
    """
    stride = 2 * length
    keys = ("shard", "first_slot", "n_sequences", "n_tokens", "n_bytes", "crc32")

    def put(store, base: str, no: int, first: int, rows: np.ndarray, sizes: np.ndarray) -> dict:
        import uuid

        temp, data = f"{base}/.{no:06d}-{uuid.uuid4().hex}", rows.tobytes()
        with store.open_output_stream(temp) as out:
            out.write(data)
        store.move(temp, f"{base}/shard-{no:06d}.bin")
        return dict(zip(keys, (no, first, len(rows), int(sizes.sum()), len(rows) * stride, zlib.crc32(data))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        unpack, ranges = zstandard.ZstdDecompressor().decompress, {}
        for batch in batches:
            for r, *own in zip(*[batch.column(k).to_pylist() for k in ("range", "slots", "sizes", "ids")]):
                if r not in ranges:
                    n = min(wide, total - r * wide)
                    ranges[r] = np.empty((n, length), "<u2"), np.zeros(n, np.int64)
                at, sizes, ids = map(unpack, own)
                at = np.frombuffer(at, "<u4")
                ranges[r][0][at] = np.frombuffer(ids, "<u2").reshape(-1, length)
                ranges[r][1][at] = np.frombuffer(sizes, "<u4")
        if ranges:
            store, base = fs.FileSystem.from_uri(path)
            store.create_dir(base, recursive=True)
        for r, (rows, sizes) in ranges.items():
            if not sizes.all():  # a sequence holds a token at least
                raise ValueError("a range lacks some of its slots")
            for i in range(0, len(rows), shard):
                first = r * wide + i
                yield pa.RecordBatch.from_pylist([put(store, base, first // shard, first, rows[i : i + shard], sizes[i : i + shard])], pa.schema([(k, pa.int64()) for k in keys]))

    dealt = slotted.repartitionById(max(1, -(-total // wide)), F.col("range").cast("int"))
    return dealt.mapInArrow(run, ", ".join(f"{k} long" for k in keys))


def read_sequences(spark: SparkSession, path: str, manifest: DataFrame, start: int = 0, length: int = LENGTH) -> DataFrame:
    """(slot, ids) from slot ``start`` on, by seeking into the shards."""
    stride = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for no, first, n in zip(*[batch.column(k).to_pylist() for k in ("shard", "first_slot", "n_sequences")]):
                with store.open_input_file(f"{base}/shard-{no:06d}.bin") as f:
                    skip = max(0, start - first)
                    f.seek(skip * stride)
                    for at in range(skip, n, 1024):
                        data = f.read(stride * min(1024, n - at))
                        ids = [data[i : i + stride] for i in range(0, len(data), stride)]
                        yield pa.RecordBatch.from_pydict({"slot": pa.array(range(first + at, first + at + len(ids)), pa.int64()), "ids": pa.array(ids, pa.binary())})

    todo = manifest.where(F.col("first_slot") + F.col("n_sequences") > start)
    return todo.mapInArrow(run, "slot long, ids binary")


def build(docs: DataFrame, out: str, path: str | None = None, text_col: str = "text", length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Write the shards to ``out`` and return their manifest."""
    streams = tokenized(docs, path or tokenizer_path(), text_col, length)
    slotted, total, wide = sequences(streams, length, shard, key)
    return write_shards(slotted, total, wide, out, length, shard)
