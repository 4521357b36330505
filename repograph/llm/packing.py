"""Lexical retrieval packing: windows filled with a seed document's BM25 neighbours.

Documents are tokenized once (a stored table of ids); the tasks that do it count document
frequencies too, and their sums over all documents are bounded by the vocabulary. Lexically near
documents are then routed to one bucket of about ``shard_tokens`` ids by a tree of two-means
cuts over sketches of their BM25 weights, wherever they are stored. Each bucket is a shard with
an inverted index (postings with BM25 impacts under the global frequencies), and windows are
packed greedily: the seed goes in first, then its best unused neighbours until the window is full. A
document that does not fit is cut there, and its rest is the next window's seed, so windows
have no padding; what is left at a task's end is cut into powers of two, which need none.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import arrow_batches, stored
from repograph.llm.token_files import with_end_ids
from repograph.llm.tokens import chunk_encoder

K1, B = 1.2, 0.75
SKETCH = 128                  # numbers in the sketch that routes a document to its shard
ROUTE_SAMPLE = 1 << 17        # sketches, at most, that the routes are learned from
DENSE_CELLS = 1 << 20         # cells of a shard's dense matrix


def tokenized(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 1) -> DataFrame:
    """Stored (id, width, ids, counts): each document's ids as little-endian unsigned 16- or
    32-bit integers (16 where the vocabulary allows; ``width`` says how many bytes), with
    ``end_id`` at the end. A last row of each task has ``counts`` in place of a document: its
    document frequencies, read by ``term_statistics``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        encoder, counted, like = None, TermCounts(), None
        for b in arrow_batches(batches, 4 << 20):
            encoder = encoder or chunk_encoder(vocab_path)
            width = 2 if encoder.bits <= 16 else 4
            ids, counts = with_end_ids(*encoder.encode(b.column(1)), end_id)
            ends = np.r_[0, np.cumsum(counts) * width]
            ids, like = ids.astype(f"<u{width}"), b.column(0).type
            counted.add(ids, ends // width)
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(counts), width, np.int32)), data.cast(pa.binary()),
                 pa.nulls(len(counts), pa.binary())], names=["id", "width", "ids", "counts"])
        if like is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, like), pa.array([0], pa.int32()), pa.array([b""]), pa.array([counted.packed()])],
                names=["id", "width", "ids", "counts"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, f"id {kind}, width int, ids binary, counts binary"), "token-ids")


def _arrays(batch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), f"<u{w}") for w, x in
            zip(batch.column(1).to_pylist(), batch.column(2))]


class TermCounts:
    """Document frequency by id, number of documents and their ids in all (end ids not counted)."""

    def __init__(self):
        self.df, self.held, self.docs, self.length = np.zeros(0, np.int64), np.zeros(0, bool), 0, 0

    def add(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents ``ids[ends[i]:ends[i + 1]]``, each with its end id, which is no term."""
        top = int(ids.max(initial=0)) + 1
        if top > len(self.df):
            self.df = np.r_[self.df, np.zeros(top - len(self.df), np.int64)]
            self.held = np.zeros(top, bool)
        for i, j in zip(ends[:-1].tolist(), (ends[1:] - 1).tolist()):
            self.held[ids[i:j]] = True
            terms = np.flatnonzero(self.held)
            self.df[terms] += 1
            self.held[terms] = False
        self.docs += len(ends) - 1
        self.length += int(ends[-1] - ends[0]) - (len(ends) - 1)

    def packed(self) -> bytes:
        """(term, n) pairs as 64-bit integers; terms -1 and -2 are the documents and their ids."""
        terms = np.flatnonzero(self.df)
        pairs = np.stack([np.r_[terms, -1, -2], np.r_[self.df[terms], self.docs, self.length]], axis=1)
        return pairs.astype("<i8").tobytes()


def term_statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency by id, number of documents and their mean length, over all rows: the
    sum of what the tokenizing tasks counted, at most the vocabulary and two numbers."""
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for row in b.column(0):
                pairs = np.frombuffer(row.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["term", "n"])

    found = tokens.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "term long, n long")
    rows = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs, length = rows.pop(-1, 0), rows.pop(-2, 0)
    df = np.zeros(max(rows, default=0) + 1, np.int64)
    df[list(rows)] = list(rows.values())
    return df, docs, length / max(1, docs)


def impacts(docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
    """(term, document, BM25 impact) of each distinct id of each document, by term, then document."""
    n, lengths = len(docs), np.array([len(d) for d in docs], np.int64)
    kind = np.uint32 if len(idf) * n < 1 << 32 else np.int64          # half the bytes to sort
    pair = np.concatenate(docs).astype(kind) * kind(n) + np.repeat(np.arange(n, dtype=kind), lengths)
    pair, tf = np.unique(pair, return_counts=True)
    term, doc = (x.astype(np.int64) for x in np.divmod(pair, kind(n)))
    norm = K1 * (1 - B + B * lengths / max(mean_length, 1.0))
    return term, doc, (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)


def sketches(docs: list[np.ndarray], idf: np.ndarray, mean_length: float) -> np.ndarray:
    """Unit vectors of ``SKETCH`` numbers: the documents' impacts, added up with random signs."""
    r = np.random.RandomState(7)
    slot, sign = r.randint(SKETCH, size=len(idf)), r.choice(np.array([-1, 1], np.float32), len(idf))
    term, doc, impact = impacts(docs, idf, mean_length)
    x = np.bincount(doc * SKETCH + slot[term], impact * sign[term], len(docs) * SKETCH)
    x = x.reshape(-1, SKETCH).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _halves(x: np.ndarray):
    """(direction, cut, which rows lie above it) of two means of ``x``; None for equal rows."""
    mean = x.mean(axis=0)
    v = x[np.argmin(x @ mean)] - mean
    for _ in range(6):                                   # towards the principal direction
        v = (x - mean).T @ ((x - mean) @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    direction, cut = v, float(mean @ v)
    for _ in range(6):
        above = x @ direction > cut
        if above.all() or not above.any():
            return None
        low, high = x[~above].mean(axis=0), x[above].mean(axis=0)
        direction, cut = high - low, float((high @ high - low @ low) / 2)
    above = x @ direction > cut
    return None if above.all() or not above.any() else (direction, cut, above)


class Routes:
    """Tree of two-means cuts over sampled sketches. Its leaves, from left to right, are dealt
    to buckets of about ``shard_tokens`` ids; a leaf above that is dealt to several."""

    def __init__(self, x: np.ndarray, length: np.ndarray, shard_tokens: int):
        direction, cut, self.child, load = [], [], [], []
        todo: list[tuple] = [(np.arange(len(x)), None)]
        while todo:
            rows, at = todo.pop()
            big = len(rows) >= 8 and length[rows].sum() > shard_tokens / 8
            halves = _halves(x[rows]) if big else None
            if halves:
                name = len(direction)
                direction.append(halves[0])
                cut.append(halves[1])
                self.child.append([0, 0])
                todo += [(rows[halves[2]], (name, 1)), (rows[~halves[2]], (name, 0))]
            else:
                name = -1 - len(load)
                load.append(length[rows].sum())
            if at:
                self.child[at[0]][at[1]] = name
        self.child = np.array(self.child, np.int64).reshape(-1, 2)
        self.direction, self.cut = np.array(direction, np.float32).reshape(-1, SKETCH), np.array(cut, np.float32)
        self.first, self.parts, bucket, filled = [], [], 0, 0.0
        for n in load:
            if filled and filled + n > shard_tokens:
                bucket, filled = bucket + 1, 0.0
            self.first.append(bucket)
            self.parts.append(max(1, int(np.ceil(n / shard_tokens))))
            bucket, filled = (bucket + self.parts[-1], 0.0) if self.parts[-1] > 1 else (bucket, filled + n)
        self.first, self.parts = np.array(self.first), np.array(self.parts)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), 0 if len(self.child) else -1)
        while (node >= 0).any():
            i = np.flatnonzero(node >= 0)
            at = node[i]
            node[i] = self.child[at, (np.einsum("ij,ij->i", x[i], self.direction[at]) > self.cut[at]).astype(int)]
        return -1 - node


def routed(tokens: DataFrame, idf: np.ndarray, mean_length: float, n_docs: int, shard_tokens: int) -> DataFrame:
    """``tokens`` with lexically near documents in one ``bucket`` and next to each other,
    wherever they are stored; every row goes to exactly one bucket."""
    spark, kind = tokens.sparkSession, tokens.schema["id"].dataType.simpleString()
    tokens_in_all = mean_length * n_docs
    wanted = min(ROUTE_SAMPLE, 128 * (1 + int(tokens_in_all / shard_tokens)) + 4096)
    share = min(1.0, wanted / max(1, n_docs))
    rows = tokens.where(F.col("counts").isNull()).select("id", "width", "ids")

    def sketch(batches: Iterator) -> Iterator:
        for b in arrow_batches(batches, 4 << 20):
            docs = [d[:-1] for d in _arrays(b)]
            x = sketches(docs, idf, mean_length)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(d) for d in docs], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["n", "x"])

    routes = Routes(np.zeros((0, SKETCH), np.float32), np.zeros(0), shard_tokens)
    if tokens_in_all > shard_tokens:
        taken = rows.sample(share, seed=7).mapInArrow(sketch, "n long, x binary").collect()
        if taken:
            x = np.frombuffer(b"".join(r["x"] for r in taken), np.float32).reshape(-1, SKETCH)
            routes = Routes(x, np.array([r["n"] for r in taken]) / share, shard_tokens)
    held = spark.sparkContext.broadcast(routes)

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        row, to = TaskContext.get().partitionId() << 40, held.value
        for b in arrow_batches(batches, 4 << 20):
            rid = row + np.arange(b.num_rows)
            row += b.num_rows
            leaf = np.zeros(b.num_rows, np.int64)
            if len(to.child):
                leaf = to.leaf(sketches([d[:-1] for d in _arrays(b)], idf, mean_length))
            bucket = to.first[leaf] + rid % to.parts[leaf]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(bucket), pa.array(leaf), pa.array(rid)],
                names=["id", "width", "ids", "bucket", "leaf", "rid"])

    out = rows.mapInArrow(run, f"id {kind}, width int, ids binary, bucket long, leaf long, rid long")
    return out.repartition("bucket").sortWithinPartitions("bucket", "leaf", "rid").drop("leaf", "rid")


class Bm25Shard:
    """Inverted index of some documents' token ids with BM25 impacts.

    Terms with the longest postings are rows of a dense matrix, the others are lists."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        n, self.vocab = len(docs), len(idf)
        term, doc, impact = impacts(docs, idf, mean_length)
        order = np.argsort(doc.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")   # 16 bits: radix
        self.terms, self.first = term[order], np.cumsum(np.r_[0, np.bincount(doc, minlength=n)])
        size = np.bincount(term, minlength=self.vocab)
        dense = np.argsort(-size, kind="stable")[:DENSE_CELLS // max(1, n)]
        dense = dense[size[dense] > n // 16]
        self.row = np.full(self.vocab, -1)
        self.row[dense] = np.arange(len(dense))
        self.dense = np.zeros((len(dense), n), np.float32)
        at = self.row[term]
        self.dense[at[at >= 0], doc[at >= 0]] = impact[at >= 0]
        self.live = np.arange(n)             # the documents that are indexed, and their columns
        self._lists(term[at < 0], doc[at < 0], impact[at < 0])

    def _lists(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
        self.term, self.doc, self.impact = term, doc, impact
        self.start = np.cumsum(np.r_[0, np.bincount(term, minlength=self.vocab)])

    def drop_used(self, free: np.ndarray) -> None:
        """Take documents out of the postings that are not ``free`` any more. They can still be
        seeds; what a seed finds among the others stays the same."""
        stay = free[self.live]
        kept, column = stay[self.doc], np.cumsum(stay) - 1
        self.live, self.dense = self.live[stay], np.ascontiguousarray(self.dense[:, stay])
        self._lists(self.term[kept], column[self.doc[kept]], self.impact[kept])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of each document of ``live`` for all distinct terms of the seed's text."""
        terms = self.terms[self.first[seed]:self.first[seed + 1]]
        row = self.row[terms]
        query = np.zeros(len(self.dense), np.float32)
        query[row[row >= 0]] = 1
        terms = terms[row < 0]
        size = self.start[terms + 1] - self.start[terms]
        at = np.repeat(self.start[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return query @ self.dense + np.bincount(self.doc[at], self.impact[at], len(self.live)).astype(np.float32)

    def neighbours(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """Documents of ``free`` that share a term with the seed, best BM25 first (then in order)."""
        score, live = self.scores(seed), self.live
        found = np.flatnonzero((score > 0) & free[live])
        while len(found):                              # the best are sorted first, the rest on demand
            value = score[found]
            top = np.ones(len(found), bool)
            if len(found) > 512:
                top = value >= np.partition(value, len(found) - 256)[len(found) - 256]
            yield from live[found[top][np.argsort(-value[top], kind="stable")]].tolist()
            found = found[~top]


class Packer:
    """Packs documents, shard by shard, into sequences of ``window`` ids."""

    def __init__(self, window: int, idf: np.ndarray, mean_length: float, base: int):
        self.window, self.idf, self.mean = window, idf, mean_length
        self.sequence = base
        self.open: list[tuple] = []          # (id, start, ids, ids of the document) of the open window
        self.filled = 0
        self.out: list[tuple] = []

    def _close(self) -> None:
        offset = 0
        for doc, start, ids, total in self.open:
            self.out.append((doc, start, ids, total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1
        self.open, self.filled = [], 0

    def _place(self, doc, ids: np.ndarray) -> bool:
        """Put a whole document in; True if its rest is in the window that is open now."""
        start, carried = 0, False
        while start < len(ids):
            part = ids[start:start + self.window - self.filled]
            self.open.append((doc, start, part, len(ids)))
            self.filled += len(part)
            start += len(part)
            carried = self.filled < self.window
            if not carried:
                self._close()
        return carried

    def shard(self, names: list, docs: list[np.ndarray]) -> None:
        index = Bm25Shard([d[:-1] for d in docs], self.idf, self.mean)
        free, unused = np.ones(len(docs), bool), len(docs)
        nxt, seed, cached = 0, None, None
        while True:
            pick = None
            if self.filled and seed is not None:              # a neighbour of the window's seed
                if cached is None or cached[0] != seed:
                    if unused < 0.8 * len(index.live):
                        index.drop_used(free)
                    cached = seed, index.neighbours(seed, free.copy())
                pick = next((d for d in cached[1] if free[d]), None)
            if pick is None:                                   # nothing shares a term: next in order
                while nxt < len(docs) and not free[nxt]:
                    nxt += 1
                if nxt == len(docs):
                    return
                pick = nxt
            free[pick] = False
            unused -= 1
            opened = self.sequence
            self._place(names[pick], docs[pick])
            if self.sequence != opened or seed is None:
                seed = pick if self.filled else None           # a new window: its first document leads

    def finish(self) -> None:
        """Cut the open window at powers of two, largest first."""
        rest, self.open, left = self.open, [], self.filled
        self.filled = 0
        for k in range(left.bit_length() - 1, -1, -1):
            need = left & (1 << k)
            while need:
                doc, start, ids, total = rest.pop(0)
                self.open.append((doc, start, ids[:need], total))
                if len(ids) > need:
                    rest.insert(0, (doc, start + need, ids[need:], total))
                need -= min(need, len(ids))
                if not need:
                    self._close()


def pack_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                   window: int = 2048, end_id: int = 1,
                   shard_tokens: int = 1 << 21) -> DataFrame:
    """One row per piece: its document's id, ``start``, ``length``, ``ids`` (little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``.

    The pieces of a document partition its ids (with the end id); the pieces of a sequence are
    gapless from 0; sequences have ``window`` ids, or a power of two at the end of a task's
    documents. Neighbours come from the same shard, ranked by BM25 over all of the seed's terms;
    shards are buckets of lexically near documents (``routed``), wherever these are stored. A
    task holds one shard, and a document of any length is a shard by itself.

    Defined results: null or empty text is the end id alone; repeated rows and rows without id
    are packed like any other; an empty table gives an empty table; other columns are ignored.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    tokens = tokenized(docs, vocab_path, id_col, text_col, end_id)
    df, n_docs, mean = term_statistics(tokens)
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))

    def pieces(rows, names):
        doc, start, ids, total, sequence, offset = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, names), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
             pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()),
             pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext
        packer = Packer(window, idf, mean, TaskContext.get().partitionId() << 40)
        names, held, n, kind_of, last = [], [], 0, pa.int64(), None
        for b in arrow_batches(batches, 4 << 20):
            kind_of = b.schema.field(0).type
            for name, ids, bucket in zip(b.column(0).to_pylist(), _arrays(b), b.column(3).to_pylist()):
                if held and (n + len(ids) > 2 * shard_tokens or bucket != last):
                    packer.shard(names, held)
                    names, held, n = [], [], 0
                last = bucket
                names.append(name)
                held.append(ids)
                n += len(ids)
                while len(packer.out) >= 1000:
                    yield pieces(packer.out[:1000], kind_of)
                    del packer.out[:1000]
        if held:
            packer.shard(names, held)
        packer.finish()
        for i in range(0, len(packer.out), 1000):
            yield pieces(packer.out[i:i + 1000], kind_of)

    out = routed(tokens, idf, mean, n_docs, shard_tokens).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, "
        "doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)
