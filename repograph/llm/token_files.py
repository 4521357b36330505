"""Token-id files: fixed-width bit packing with block offsets.

A shard file holds the ids of consecutive documents. Each id takes the fewest bits that hold
the vocabulary (16 for 50,257 ids); 64 ids fill as many 64-bit words as an id has bits, so a
column of 64 is packed or unpacked by a few numpy shifts. Layout::

    magic | blocks of BLOCK ids | block offsets | doc ids | doc starts | doc id is null | footer

The footer (bits, ids to a block, number of blocks, documents and ids) stands at the end, so
shards are written as a stream; readers seek to it, and reach any id by its block's offset.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repograph.llm.common import arrow_batches, open_fs, shared_path, stored
from repograph.llm.tokens import chunk_encoder

MAGIC = b"IDSHARD1"
BLOCK = 4096
READ_IDS = 1 << 20            # ids unpacked at once by a sequential read
_FOOTER = np.dtype([("bits", "<u4"), ("block", "<u4"), ("blocks", "<u8"), ("docs", "<u8"),
                    ("ids", "<u8"), ("magic", "S8")])


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, little-endian; the last group of 64 is filled with zeros."""
    rows = -(-len(ids) // 64)
    full = np.zeros((rows, 64), np.uint64)
    full.ravel()[:len(ids)] = ids
    words = np.zeros((rows, bits), "<u8")
    for k in range(64):
        w, s = divmod(k * bits, 64)
        words[:, w] |= full[:, k] << np.uint64(s)
        if s + bits > 64:
            words[:, w + 1] |= full[:, k] >> np.uint64(64 - s)
    return words.tobytes()


def unpack_ids(data: bytes, bits: int) -> np.ndarray:
    """All ids of packed groups (with the filling zeros), as uint32."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        w, s = divmod(k * bits, 64)
        v = words[:, w] >> np.uint64(s)
        if s + bits > 64:
            v = v | (words[:, w + 1] << np.uint64(64 - s))
        out[:, k] = v & mask
    return out.ravel()


class ShardWriter:
    """Streams documents' ids into one shard; memory holds a run of blocks and the doc table."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.at = out, bits, len(MAGIC)
        self.held, self.n_held, self.n_ids = [], 0, 0
        self.offsets, self.doc_ids, self.starts, self.nulls = [], [], [], []
        out.write(MAGIC)

    def add(self, ids: np.ndarray, doc_ids: list, counts: np.ndarray) -> None:
        self.doc_ids += [d or 0 for d in doc_ids]
        self.nulls += [d is None for d in doc_ids]
        self.starts += (self.n_ids + np.cumsum(counts) - counts).tolist()
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= READ_IDS:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        done, rest = ids[:n], ids[n:]
        size = BLOCK * self.bits // 8
        self.offsets += [self.at + i * size for i in range(-(-len(done) // BLOCK))]
        data = pack_ids(done, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.held, self.n_held = [rest], len(rest)

    def close(self) -> None:
        self._flush(self.n_held)
        foot = np.array([(self.bits, BLOCK, len(self.offsets), len(self.doc_ids), self.n_ids, MAGIC)],
                        _FOOTER)
        for x, kind in ((self.offsets, "<u8"), (self.doc_ids, "<i8"), (self.starts, "<u8"),
                        (self.nulls, "u1")):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(foot.tobytes())
        self.out.close()


class ShardReader:
    """Random access to a shard: ``ids(start, n)`` reads only the blocks that hold them."""

    def __init__(self, path: str):
        fs, p = open_fs(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        foot = np.frombuffer(self._at(size - _FOOTER.itemsize, _FOOTER.itemsize), _FOOTER)[0]
        if foot["magic"] != MAGIC:
            raise ValueError(f"{path} is not a token-id shard")
        self.bits, self.block, self.n_ids = int(foot["bits"]), int(foot["block"]), int(foot["ids"])
        docs, blocks = int(foot["docs"]), int(foot["blocks"])
        at = size - _FOOTER.itemsize - docs * 17 - blocks * 8
        table = self._at(at, blocks * 8 + docs * 17)
        self.offsets = np.frombuffer(table, "<u8", blocks)
        self.doc_ids = np.frombuffer(table, "<i8", docs, blocks * 8)
        self.starts = np.frombuffer(table, "<u8", docs, blocks * 8 + docs * 8).astype(np.int64)
        self.nulls = np.frombuffer(table, "u1", docs, blocks * 8 + docs * 16).astype(bool)
        self.end = at

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def ids(self, start: int, n: int) -> np.ndarray:
        if n == 0:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        lo = int(self.offsets[first])
        hi = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.end
        skip = start - first * self.block
        return unpack_ids(self._at(lo, hi - lo), self.bits)[skip:skip + n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc id, start in the shard, ids) in file order; reads about READ_IDS at a time."""
        ends = np.r_[self.starts[1:], self.n_ids]
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(ends, self.starts[i] + READ_IDS, "right")))
            base = int(self.starts[i])
            ids = self.ids(base, int(ends[j - 1]) - base)
            for k in range(i, j):
                yield (None if self.nulls[k] else int(self.doc_ids[k]), int(self.starts[k]),
                       ids[int(self.starts[k]) - base:int(ends[k]) - base])
            i = j

    def close(self) -> None:
        self.file.close()


def with_end_ids(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each document's ids."""
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32, copy=False), counts + 1


def write_token_shards(docs: DataFrame, vocab_path: str, id_col: str = "doc_id",
                       text_col: str = "text", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write shards in ascending id order under ``path`` (default: a new shared folder).

    Returns the manifest: (part, file, n_docs, n_ids, base) where ``base`` is the number of
    ids in all shards before. Documents are range-partitioned by id, so a shard is a
    contiguous range and one task's work; a file's name is unique to the attempt that wrote
    it and only the manifest names it, so a lost or repeated task leaves no wrong data.

    Defined results: null text is empty (only the end id); rows without id come first; rows
    that share an id stand next to each other, ordered by text.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "token-shards")

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        part, writer, encoder, file = TaskContext.get().partitionId(), None, None, None
        for b in arrow_batches(batches, 4 << 20):
            if writer is None:
                encoder = chunk_encoder(vocab_path)
                fs, folder = open_fs(path)
                fs.create_dir(folder, recursive=True)
                file = f"part-{part:06d}-{uuid.uuid4().hex}.ids"
                writer = ShardWriter(fs.open_output_stream(f"{folder}/{file}"),
                                     max(encoder.bits, end_id.bit_length()))
            ids, counts = with_end_ids(*encoder.encode(b.column(1)), end_id)
            writer.add(ids, b.column(0).to_pylist(), counts)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{path}/{file}"],
                                              "n_docs": [len(writer.starts)], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shards = stored(rows.repartitionByRange("id").sortWithinPartitions("id", "text")
                    .mapInArrow(write, "part long, file string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shard files.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers. One task per shard, streaming its blocks.
    """
    def read(batches: Iterator) -> Iterator:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard, rows = ShardReader(file), []
                for doc, start, ids in shard.documents():
                    rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)
                shard.close()

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                          names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # as many tasks as shards; a fixed number is not merged again however small the manifest is
    files = manifest.select("file", F.col("base").cast("long"))
    files = files.repartitionByRange(max(1, files.count()), "base", "file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
