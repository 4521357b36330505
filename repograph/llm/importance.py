"""Target-distribution importance resampling with exact ranks by regular sampling.

A document's weight is the sum, over its word runs, of the log ratio of the target's and the
corpus's frequency of the run's hash bucket; the ratios are one array of ``buckets`` numbers,
gathered by bucket. Adding Gumbel noise that depends on the id alone turns the largest scores
into a draw without replacement, so the draw is a distributed sort:

* scored rows are sorted inside each task and stored: locally sorted runs, each row with its
  run and position;
* regular samples of the runs (every step-th position) give the splitters;
* a count of rows for each segment between splitters gives, by prefix sums, the rank at which
  each segment begins, and so the last segment that holds a drawn row;
* only the segments up to that one are exchanged; a task merges the pieces of its segment and
  numbers the rows from the segment's first rank.

A key ends with the row's own number, so no two keys are equal: any number of rows with one
score, one id or one text is divided like all others.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import arrow_batches, stored

BUCKETS = 10_000
MAX_RUNS = 4096               # sorted runs; a run is one task's rows
MAX_SEGMENTS = 4096
SEGMENT_ROWS = 1024           # rows of a segment, as long as MAX_SEGMENTS allows
RUN_SAMPLES = 64              # regular samples a segment
SHORT_WORD = 64               # bytes up to which words are hashed side by side
KEYS = ["neg", "no_id", "id", "hash", "rid"]


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def extend_crc(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 registers (before the final inversion) after the bytes of each span."""
    out = state.copy()
    short = np.flatnonzero(lengths <= SHORT_WORD)
    order = short[np.argsort(-lengths[short].astype(np.int16), kind="stable")]
    size = lengths[order]
    at, reg = starts[order], out[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))              # spans longer than k
        reg[:n] = CRC[(reg[:n] ^ data[at[:n] + k]) & 255] ^ (reg[:n] >> np.uint32(8))
    out[order] = reg
    for i in np.flatnonzero(lengths > SHORT_WORD).tolist():
        span = data[starts[i]:starts[i] + lengths[i]].tobytes()
        out[i] = zlib.crc32(span, int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


def word_features(texts: pa.Array, max_words: int, buckets: int = BUCKETS):
    """(document, bucket) of every run of 1 to ``max_words`` words, and words of each document.

    Words are runs of ASCII digits and letters (A-Z lower-cased) and of all other code points
    beyond ASCII; a run's words are joined by one space.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, raw = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + np.uint8(32), data)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    before = np.r_[False, inside[:-1]]
    before[offsets] = False                                      # a word ends with its document
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(np.r_[False, inside[:-1]] & (~inside | (inside & ~before)))
    lengths, doc = stops - starts, np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    reg = extend_crc(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, lengths)
    docs, found = [doc], [(reg ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)]
    for k in range(1, max_words):
        goes_on = np.flatnonzero(doc[:len(doc) - k] == doc[k:])  # runs of k + 1 words
        reg = CRC[(reg[goes_on] ^ np.uint32(32)) & 255] ^ (reg[goes_on] >> np.uint32(8))
        reg_all = np.zeros(len(doc), np.uint32)
        reg_all[goes_on] = extend_crc(reg, data, starts[goes_on + k], lengths[goes_on + k])
        reg = reg_all
        docs.append(doc[goes_on])
        found.append((reg[goes_on] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
    return np.concatenate(docs), np.concatenate(found), words


def bucket_counts(texts: DataFrame, text_col: str = "text", max_words: int = 1,
                  buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket over all rows."""
    def run(batches: Iterator) -> Iterator:
        total = np.zeros(buckets, np.int64)
        for b in arrow_batches(batches):
            total += np.bincount(word_features(b.column(0), max_words, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])],
                                         names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():   # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    n = len(source)
    s_all, t_all = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all)))
                     for s, t in zip(map(float, source), map(float, target))], np.int64)


def gumbel(doc_id: int | None, seed: str) -> int:
    """1000 times standard Gumbel noise, rounded down, from the id alone."""
    name = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_documents(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
                     max_words: int = 1, seed: str = "2024") -> DataFrame:
    """Stored (id, hash, n_words, n_features, weight, score, rid) of every document."""
    def run(batches: Iterator) -> Iterator:
        for b in arrow_batches(batches):
            n = b.num_rows
            doc, bucket, words = word_features(b.column(2), max_words, len(gains))
            weight = np.zeros(n, np.int64)
            np.add.at(weight, doc, gains[bucket])
            noise = np.array([gumbel(i, seed) for i in b.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(words), pa.array(np.bincount(doc, minlength=n)),
                 pa.array(weight), pa.array(weight + noise)],
                names=["id", "hash", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"),
                       F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "id long, hash long, n_words long, n_features long, weight long, score long")
    return stored(scored.withColumn("rid", F.monotonically_increasing_id()), "scored")


def _numbered(batches: Iterator) -> Iterator:
    """Run and position of every row of a sorted partition."""
    from pyspark import TaskContext
    run, at = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(n, run, np.int32)), pa.array(np.arange(at, at + n))],
            names=[*b.schema.names, "run", "pos"])
        at += n


def _segments(splitters: np.ndarray):
    """mapInArrow: the segment of each row, the number of splitters not above its key."""
    def run(batches: Iterator) -> Iterator:
        for b in batches:
            keys = np.array([b.column(b.schema.get_field_index(k)).to_numpy() for k in KEYS]).T
            both = np.concatenate([splitters, keys])
            order = np.lexsort(both.T[::-1])                     # stable: a splitter before its own row
            before = np.cumsum(order < len(splitters))
            segment = np.empty(len(both), np.int64)
            segment[order] = before
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segment[len(splitters):], pa.int32())],
                                             names=[*b.schema.names, "segment"])
    return run


def _ranks(first: np.ndarray, last_rank: int):
    """mapInArrow over whole segments in order: rank, null beyond the last drawn one."""
    def run(batches: Iterator) -> Iterator:
        segment, at = -1, 0
        for b in batches:
            seg = b.column(b.schema.get_field_index("segment")).to_numpy()
            starts = np.r_[0, np.flatnonzero(seg[1:] != seg[:-1]) + 1, len(seg)]
            local = np.empty(len(seg), np.int64)
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if seg[i] != segment:
                    segment, at = int(seg[i]), 0
                local[i:j] = np.arange(at, at + j - i)
                at += j - i
            rank = first[seg] + local + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rank, mask=rank > last_rank)],
                                             names=[*b.schema.names, "rank"])
    return run


def ranked_draw(scored: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... of the floor(percent * N / 100) highest scores among
    the N rows of at least ``min_words`` words; null for all others."""
    keyed = scored.withColumns({"neg": -F.col("score"), "no_id": F.col("id").isNull().cast("long"),
                                "doc": F.col("id"), "id": F.coalesce("id", F.lit(0))})
    columns = [F.col("doc").alias("id"), "n_words", "n_features", "weight", "score"]
    schema = keyed.schema
    local = keyed.where(F.col("n_words") >= min_words).coalesce(MAX_RUNS).sortWithinPartitions(*KEYS)
    runs = stored(local.mapInArrow(_numbered, schema.simpleString()[7:-1] + ",run:int,pos:bigint"), "runs")
    sizes = [r["n"] for r in runs.groupBy("run").agg(F.count("*").alias("n")).collect()]  # a row a run
    n = sum(sizes)
    last_rank = percent * n // 100
    no_rank = F.lit(None).cast("long").alias("rank")
    others = keyed.where(F.coalesce(F.col("n_words") < min_words, F.lit(True))).select(*columns, no_rank)
    if last_rank == 0:
        return runs.select(*columns, no_rank).union(others)

    segments = max(1, min(MAX_SEGMENTS, -(-n // SEGMENT_ROWS)))
    step = max(1, n // (segments * min(len(sizes), RUN_SAMPLES)))
    sample = runs.where(F.col("pos") % step == 0).select(*KEYS).collect()    # bounded by the constants
    keys = np.array(sorted(tuple(r) for r in sample), np.int64)
    splitters = keys[(np.arange(1, segments) * len(keys)) // segments]
    dealt = runs.mapInArrow(_segments(splitters), runs.schema.simpleString()[7:-1] + ",segment:int")
    size = np.zeros(segments, np.int64)
    for r in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect():
        size[r["segment"]] = r["n"]
    first = np.cumsum(size) - size
    last = int(np.searchsorted(np.cumsum(size), last_rank, "left"))          # segment of the last drawn row
    merged = dealt.where(F.col("segment") <= last).repartitionById(last + 1, F.col("segment")) \
        .sortWithinPartitions("segment", *KEYS)
    drawn = merged.mapInArrow(_ranks(first, last_rank), dealt.schema.simpleString()[7:-1] + ",rank:bigint")
    return drawn.select(*columns, "rank").union(
        dealt.where(F.col("segment") > last).select(*columns, no_rank)).union(others)


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        target_text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS,
                        percent: int = 10, min_words: int = 20, seed: str = "2024") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document: a draw of ``percent`` of
    those with ``min_words`` words, in proportion to how much more likely the target makes them.

    Defined results: null and empty texts have no features and weight zero; a null id has the
    noise of an empty name and stands after all others on ties; rows with one score and id are
    ordered by their text's hash, repeated rows each have a rank; an empty target gives every
    bucket the smoothed ratio of no counts; an empty table gives no rows.
    """
    source = bucket_counts(docs, text_col, max_words, buckets)
    gains = bucket_gains(source, bucket_counts(target, target_text_col, max_words, buckets))
    scored = scored_documents(docs, gains, id_col, text_col, max_words, seed)
    return ranked_draw(scored, percent, min_words).withColumnRenamed("id", id_col)
