"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints (64 bits) are computed per row in Arrow batches. Equal fingerprints collapse in
a partial aggregate, so a group of copies is one row from then on. Two fingerprints that
differ in at most k bits agree on one of k+1 bit blocks: each distinct fingerprint is routed
to k+1 buckets (block mask, masked bits), and a bucket is sorted by Gray rank and indexed:
consecutive fingerprints form a node that keeps the bits they share, nodes form upper nodes,
and a child keeps only the shared bits that its parent does not have. A search goes down from
the bucket's root, adds up the differing bits node by node, and drops a whole group as soon
as the sum exceeds k. Buckets above ``bucket_rows`` are split into k+1 narrower ones by
further blocks of their free bits (the same pigeonhole argument), so no bucket is unbounded
and no link is lost. A bucket emits a spanning forest of its links, never all pairs.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import arrow_batches, connected_components, stored

SEED = 42
BITS = 64
FAN = 8                       # children of an index node
SEARCH_ROWS = 1 << 21         # (query, node) pairs held at once in a search
SLICE = 1 << 20               # bytes of a text that are split into words at once
_SPACE = re.compile(rb"[\x09-\x0D\x20]")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """Words between ASCII white space, from a slice of the text at a time."""
    at = 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + SLICE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


def fingerprint(text: str | None, ngram: int = 3) -> int:
    """SimHash of a text: A-Z lower-cased words between ASCII white space, ``ngram``-word
    shingles with repeats, XXH64; a bit is set if more than half of the hashes have it.
    Fewer words than ``ngram``: one shingle, the whole sequence; none (or null): zero."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    digest, votes, n, words = xxhash.xxh64_intdigest, np.zeros((8, 256), np.int64), 0, []

    def vote(hashes: list[int]) -> None:
        byte = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        votes[:] += np.bincount((byte + np.arange(0, 2048, 256)).ravel(), minlength=2048).reshape(8, 256)

    for part in _words(raw):
        words += part                                  # with the last words of the slice before
        k = len(words) - ngram + 1
        if k > 0:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            first = np.concatenate(([0], ends[:-1] + 1))[:k].tolist()
            vote([digest(joined[i:j], SEED) for i, j in zip(first, ends[ngram - 1:].tolist())])
            n, words = n + k, words[k:]
    if not n:
        if not words:
            return 0
        vote([digest(b" ".join(words), SEED)])
        n = 1
    bits = (votes @ _BYTE_BITS.astype(np.int64)) * 2 > n
    return int.from_bytes(np.packbits(bits.ravel(), bitorder="little").tobytes(), "little")


def _fingerprint_batches(ngram: int):
    def run(batches: Iterator) -> Iterator:
        for b in arrow_batches(batches):
            fps = np.array([fingerprint(t.as_py(), ngram) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]],
                                             names=["id", "fp", *b.schema.names[2:]])
    return run


def gray_rank(code: Column) -> Column:
    """Position of a 64-bit code in the Gray sequence (as a long, order kept)."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def split_mask(fixed: int, parts: int) -> list[int]:
    """``fixed`` extended by each of ``parts`` blocks of its free bits (unsigned masks)."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [fixed | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:])]


class GrayIndex:
    """Hierarchical index over runs (buckets) of codes, each run sorted by Gray rank."""

    def __init__(self, codes: np.ndarray, run: np.ndarray):
        self.codes, n = codes, len(codes)
        self.levels = []                # leaves first: (children start, end, last leaf, and, or)
        low = high = codes
        start, end, last = np.arange(n), np.arange(1, n + 1), np.arange(n)
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        self.runs = len(first)
        while True:
            self.levels.append((start, end, last, low, high))
            if len(low) == self.runs:
                break
            heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            size = np.diff(np.r_[heads, len(run)])
            pos = np.arange(len(run)) - np.repeat(heads, size)
            cut = np.flatnonzero(pos % FAN == 0)
            start, end = cut, np.r_[cut[1:], len(run)]
            last, run = last[end - 1], run[cut]
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)

    def links(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i < j) of leaves of one run that differ in at most ``max_bits`` bits."""
        start, end, last, *_ = self.levels[-1]
        sizes = np.diff(np.r_[-1, last])
        node_of = np.repeat(np.arange(self.runs), sizes)
        load = np.cumsum(np.repeat(sizes, sizes))
        query = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        while len(query):
            cut = max(1, int(np.searchsorted(load[query], load[query[0]] + SEARCH_ROWS)))
            yield self._search(query[:cut], node_of[query[:cut]], max_bits)
            query = query[cut:]

    def _search(self, q, node, max_bits):
        diff = np.zeros(len(q), np.uint8)
        for depth in range(len(self.levels) - 1, 0, -1):
            start, end, _, low, high = self.levels[depth]
            _, _, last, c_low, c_high = self.levels[depth - 1]
            fan = end[node] - start[node]
            child = np.repeat(start[node] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
            q, diff = np.repeat(q, fan), np.repeat(diff, fan)
            varies = np.repeat(low[node] ^ high[node], fan)        # bits the parent leaves open
            own = varies & ~(c_low[child] ^ c_high[child])          # and the child settles
            diff = diff + np.bitwise_count((self.codes[q] ^ c_low[child]) & own)
            keep = (diff <= max_bits) & (last[child] > q)
            q, node, diff = q[keep], child[keep], diff[keep]
        return q, node


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the ends of links in place; a label is the smallest position of its group."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _bucket_links(max_bits: int, rows: int = 1 << 18):
    """mapInArrow over (fixed, key, code) sorted by bucket: spanning links of each bucket."""
    def solve(fixed, key, code):
        new = np.r_[True, (fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])]
        index = GrayIndex(code.view(np.uint64), np.cumsum(new))
        label = np.arange(len(code))
        for a, b in index.links(max_bits):
            merge_labels(label, a, b)
        member = np.flatnonzero(label != np.arange(len(code)))
        return pa.RecordBatch.from_arrays(
            [pa.array(code[member]), pa.array(code[label[member]])], names=["a", "b"])

    def run(batches: Iterator) -> Iterator:
        held, n = [], 0
        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            n += b.num_rows
            if n >= rows:
                fixed, key, code = (np.concatenate(x) for x in zip(*held))
                ends = np.flatnonzero((fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])) + 1
                if len(ends):
                    e = ends[-1]
                    yield solve(fixed[:e], key[:e], code[:e])
                    fixed, key, code = fixed[e:], key[e:], code[e:]
                held, n = [(fixed, key, code)], len(code)
        if n:
            yield solve(*(np.concatenate(x) for x in zip(*held)))
    return run


def _routed(codes: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """``codes`` (fixed, code) to a row for each narrower mask: (fixed, key, code)."""
    cases = None
    for mask, finer in masks.items():
        to = F.array(*[F.lit(_signed(m)) for m in finer])
        cond = F.col("fixed") == F.lit(_signed(mask))
        cases = F.when(cond, to) if cases is None else cases.when(cond, to)
    out = codes.select("code", F.explode(cases).alias("fixed"))
    return out.select("fixed", F.col("code").bitwiseAND(F.col("fixed")).alias("key"), "code")


def fingerprint_links(codes: DataFrame, max_bits: int = 3, bucket_rows: int = 100_000) -> DataFrame:
    """``codes`` (distinct longs ``code``) to links (a, b) that span every group of codes
    connected by pairs at ``max_bits`` or fewer differing bits."""
    masks = {0: split_mask(0, max_bits + 1)}
    work = _routed(codes.select("code", F.lit(0).cast("long").alias("fixed")), masks)
    done = None
    while True:
        hot = work.groupBy("fixed", "key").count().where(F.col("count") > bucket_rows)
        if hot.isEmpty():
            done = work if done is None else done.unionByName(work)
            break
        hot = stored(hot.select("fixed", "key"), "hot-buckets")
        cold = work.join(hot, ["fixed", "key"], "left_anti").select("fixed", "key", "code")
        done = cold if done is None else done.unionByName(cold)
        masks = {m: split_mask(m, max_bits + 1) for f in masks.values() for m in f}
        work = stored(_routed(work.join(hot, ["fixed", "key"], "left_semi"), masks), "bucket-rows")
    done = done.repartition("fixed", "key").sortWithinPartitions(
        "fixed", "key", gray_rank(F.col("code"))).select("fixed", "key", "code")
    return done.mapInArrow(_bucket_links(max_bits), "a long, b long")


def _row_groups(docs: DataFrame, id_col: str, text_col: str, ngram: int, max_bits: int,
                bucket_rows: int, keys: dict[str, Column]) -> DataFrame:
    """One row per row of ``docs``: (id, fp, ``keys``, component_id, root); ``root`` is a code
    that names the group also where it has no id. ``keys`` are columns of longs."""
    kind = docs.schema[id_col].dataType.simpleString()
    fps = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"),
                             *[c.alias(k) for k, c in keys.items()])
                 .mapInArrow(_fingerprint_batches(ngram),
                             f"id {kind}, fp long" + "".join(f", {k} long" for k in keys)), "fingerprints")
    codes = stored(fps.groupBy(F.col("fp").alias("code")).agg(F.min("id").alias("first")), "codes")
    roots = connected_components(fingerprint_links(codes.select("code"), max_bits, bucket_rows))
    linked = codes.join(roots, codes["code"] == roots["node"])
    named = linked.groupBy("root").agg(F.min("first").alias("name"))
    named = linked.join(named, "root").select("code", "name", "root")
    groups = codes.join(named, "code", "left").select(
        "code", F.coalesce("name", "first").alias("component_id"), F.coalesce("root", "code").alias("root"))
    groups = stored(groups, "groups")        # so that AQE can split the join at a hot fingerprint
    return fps.join(groups, fps["fp"] == groups["code"]).drop("code")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   ngram: int = 3, max_bits: int = 3, bucket_rows: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` (the fingerprint as a signed long) and
    ``component_id``, the smallest id that links of at most ``max_bits`` bits reach.

    Defined results: a null or empty text has fingerprint zero and links like any other;
    rows without id have a group but never name it (a group of such rows only has a null
    ``component_id``); repeated rows keep their own rows; an empty table gives an empty
    table; other columns are ignored. A text of any length is read whole, hash by hash.
    """
    return _row_groups(docs, id_col, text_col, ngram, max_bits, bucket_rows, {}).select(
        F.col("id").alias(id_col), "fp", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """Pipeline stage: ``docs`` with one document of each near-duplicate group, the one with
    the smallest id; of different texts under that id the one with the smallest hash; rows
    without id stay only if no row of their group has one (then as one row). Rows are told
    apart by id and text, so rows that share an id but not a group do not touch each other."""
    keys = {"tk": F.xxhash64("text"), "tn": F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")}
    rows = _row_groups(docs, "doc_id", "text", 3, 3, 100_000, keys)
    best = rows.groupBy("root", "id", *keys).agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", *keys, "n")).alias("best"))
    keep = stored(best.select(F.col("best.id").alias("keep_id"), F.col("best.tk").alias("keep_tk"),
                              F.col("best.tn").alias("keep_tn"), F.col("best.n").alias("keep_n")), "members")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    for k, c in keys.items():
        same = same & (c == F.col(f"keep_{k}"))
    once = docs.join(keep, same, "left_semi")
    if keep.where("keep_n > 1").isEmpty():
        return once
    named = {f"__{k}": c for k, c in keys.items()}
    return once.withColumns(named).dropDuplicates(["doc_id", *named]).drop(*named)
