"""Embedding near-dedup by collision counting over one-dimensional projections.

Unit vectors are projected onto fixed Gaussian directions. Two vectors collide in a projection
if their values differ by at most ``window``; the number of collisions of a pair grows as the
vectors get closer, so pairs that collide often enough are verified by their exact cosine. The
least count is calibrated: a pair at exactly the threshold reaches it with the asked recall.

Equal vectors of a label collapse first (their links follow from their number). Vectors of a
label are cut at zero of its first k projections, k so that a cell holds about ``cell_rows``; a
vector queries its own cell and those across every cut that its query-centred window reaches.
Cells larger than that (a large group of near copies) are dealt into chunks, and each pair of
a home chunk and a query chunk is a task of bounded size. A task sorts the home values of each
projection, finds each query's window by binary search, counts, verifies, and returns the
number of links of each home vector and a spanning forest of them, never the pairs.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.llm.common import connected_components, stored
from repograph.llm.simhash import merge_labels

SEED = 20260
PROJECTIONS = 24
WINDOW_SIGMAS = 2.0           # collision window, in deviations of a pair at the threshold
REACH_SIGMAS = 3.5            # a query's window at the cuts between cells
VERIFY_ROWS = 1 << 17         # candidate pairs verified at once


def calibrated_count(m: int, sigmas: float, recall: float) -> int:
    """Largest collision count that a pair at the threshold reaches with probability ``recall``."""
    p = math.erf(sigmas / math.sqrt(2))
    tail = 0.0
    for count in range(m, -1, -1):
        tail += math.comb(m, count) * p ** count * (1 - p) ** (m - count)
        if tail >= recall:
            return count
    return 0


def directions(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.RandomState(SEED + dim).standard_normal((dim, m))


def _matrix(column) -> np.ndarray:
    """List column of equally long float lists as a matrix in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)             # against overflow of large values
    x = x / top
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _route(reach: float, with_vectors: bool):
    """mapInArrow over (rid, label, n, cuts, vector), rows of one dimension side by side:
    a row for each cell that a vector queries."""
    def run(batches):
        for b in batches:
            size = np.asarray(b.column(4).value_lengths())
            for dim in np.unique(size).tolist():
                part = b.take(pa.array(np.flatnonzero(size == dim)))
                p = _unit(_matrix(part.column(4))) @ directions(dim)
                cuts = part.column(3).to_numpy()
                home = ((p > 0) * (1 << np.arange(p.shape[1]))[None, :] *
                        (np.arange(p.shape[1])[None, :] < cuts[:, None])).sum(axis=1)
                row, cell = np.arange(len(p)), home
                for r in range(int(cuts.max(initial=0))):
                    near = (r < cuts[row]) & (np.abs(p[row, r]) <= reach)
                    row, cell = np.r_[row, row[near]], np.r_[cell, cell[near] ^ (1 << r)]
                for i in range(0, len(row), 20_000):
                    at = row[i:i + 20_000]
                    out = [part.column(1).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)),
                           pa.array(cell[i:i + 20_000]), pa.array(cell[i:i + 20_000] == home[at])]
                    names = ["label", "dim", "cell", "home"]
                    if with_vectors:
                        out += [part.column(c).take(pa.array(at)) for c in (0, 2, 3, 4)]
                        names += ["rid", "n", "cuts", "vector"]
                    yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def _solve(threshold: float, window: float, reach: float, least: int):
    """applyInArrow over one task's rows: (rid, n, to), either a home vector's number of links
    (``to`` null) or a link of the spanning forest (n zero)."""
    def run(group: pa.Table) -> pa.Table:
        rid, n = group.column("rid").to_numpy(), group.column("n").to_numpy()
        is_home, is_query = (group.column(c).to_numpy() for c in ("as_home", "as_query"))
        raw = _matrix(group.column("vector"))
        unit = _unit(raw)
        p, cuts = unit @ directions(raw.shape[1]), int(group.column("cuts")[0].as_py())
        h, q = np.flatnonzero(is_home), np.flatnonzero(is_query)
        links, label = np.zeros(len(rid), np.int64), np.arange(len(rid))
        for at in range(0, len(q), 1024):
            part = q[at:at + 1024]
            count = np.zeros((len(part), len(h)), np.int8)
            for r in range(p.shape[1]):
                order = np.argsort(p[h, r], kind="stable")
                rank = np.empty(len(h), np.int32)
                rank[order] = np.arange(len(h), dtype=np.int32)
                value = p[h, r][order]
                lo = np.searchsorted(value, p[part, r] - window, "left").astype(np.int32)
                hi = np.searchsorted(value, p[part, r] + window, "right").astype(np.int32)
                count += (rank[None, :] >= lo[:, None]) & (rank[None, :] < hi[:, None])
            x, y = np.nonzero(count >= least)
            x, y = part[x], h[y]
            keep = rid[x] != rid[y]
            x, y = x[keep], y[keep]
            for i in range(0, len(x), VERIFY_ROWS):
                a, b = x[i:i + VERIFY_ROWS], y[i:i + VERIFY_ROWS]
                same = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                same &= (np.abs(p[a, :cuts] - p[b, :cuts]) <= reach).all(axis=1)
                np.add.at(links, b[same], n[a[same]])
                merge_labels(label, a[same], b[same])
        root = np.flatnonzero(label != np.arange(len(rid)))
        counted = h[links[h] > 0]
        return pa.table({
            "rid": np.r_[rid[counted], rid[root]],
            "n": np.r_[links[counted], np.zeros(len(root), np.int64)],
            "to": pa.array(np.r_[np.zeros(len(counted), np.int64), rid[label[root]]],
                           mask=np.r_[np.ones(len(counted), bool), np.zeros(len(root), bool)])})
    return run


def _usable(vector: Column, label: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & finite
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                     label_col: str = "label", threshold: float = 0.98, recall: float = 0.9999,
                     cell_rows: int = 1024) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links`` (other rows with the same label and a
    cosine of at least ``threshold``) and ``component_id`` (smallest id that links reach).

    Every link found has at least that cosine; a pair at the threshold is found with about
    probability ``recall`` (closer pairs more surely), minus 0.05 % for each cut of its label.

    Defined results: null, zero, non-finite or partly null vectors and vectors without label
    link with nothing; vectors of different length do not link; each of several rows with equal
    vectors is a vector of its own and links with the others; a row without id has links but
    never names a group; an empty table gives an empty table; other columns are ignored.
    """
    sigma = math.sqrt(2 - 2 * threshold)
    window, reach = WINDOW_SIGMAS * sigma, REACH_SIGMAS * sigma
    least = calibrated_count(PROJECTIONS, WINDOW_SIGMAS, recall)
    kind = vectors.schema[label_col].dataType.simpleString()

    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("vector"))
    good = rows.where(_usable(F.col("vector"), F.col("label")))
    reps = good.groupBy("label", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    reps = stored(reps.withColumn("rid", F.monotonically_increasing_id())
                  .withColumn("dim", F.size("vector")), "vectors")
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("all"))
    cuts = F.least(F.lit(PROJECTIONS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("all") / cell_rows))))
    sized = reps.join(sizes, ["label", "dim"]).select("rid", "label", "n", cuts.cast("int").alias("cuts"),
                                                      "vector")
    vector_kind = vectors.schema[vector_col].dataType.simpleString()
    keys = f"label {kind}, dim int, cell long, home boolean"
    cells = sized.mapInArrow(_route(reach, False), keys).groupBy("label", "dim", "cell").agg(
        F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("queries"))
    parts = [F.ceil(F.col(c) / cell_rows).cast("int") for c in ("homes", "queries")]
    large = stored(cells.where((F.col("queries") > cell_rows) & (F.col("homes") > 0)).select(
        "label", "dim", "cell", parts[0].alias("hs"), parts[1].alias("qs")), "large-cells")

    routed = sized.mapInArrow(_route(reach, True), f"{keys}, rid long, n long, cuts int, vector {vector_kind}")
    routed = routed.join(large, ["label", "dim", "cell"], "left").withColumns({
        "hs": F.coalesce("hs", F.lit(1)), "qs": F.coalesce("qs", F.lit(1))}).withColumns({
            "h0": F.pmod(F.xxhash64("rid"), "hs").cast("int"),
            "q0": F.pmod(F.xxhash64("rid", F.lit(1)), "qs").cast("int")})
    none = F.array().cast("array<struct<hc:int,qc:int,as_home:boolean,as_query:boolean>>")
    at_home = F.when(F.col("home"), F.transform(
        F.sequence(F.lit(0), F.col("qs") - 1),
        lambda c: F.struct(F.col("h0").alias("hc"), c.alias("qc"), F.lit(True).alias("as_home"),
                           (c == F.col("q0")).alias("as_query")))).otherwise(none)
    as_query = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("hs") - 1), lambda c: ~F.col("home") | (c != F.col("h0"))),
        lambda c: F.struct(c.alias("hc"), F.col("q0").alias("qc"), F.lit(False).alias("as_home"),
                           F.lit(True).alias("as_query")))
    dealt = routed.select("label", "dim", "cell", "rid", "n", "cuts", "vector",
                          F.explode(F.concat(at_home, as_query)).alias("to")).select(
        "label", "dim", "cell", "rid", "n", "cuts", "vector", "to.*")
    found = stored(dealt.groupBy("label", "dim", "cell", "hc", "qc").applyInArrow(
        _solve(threshold, window, reach, least), "rid long, n long, to long"), "links")

    counts = found.where(F.col("to").isNull()).groupBy("rid").agg(F.sum("n").alias("near"))
    roots = connected_components(found.where(F.col("to").isNotNull()), "rid", "to")
    linked = reps.join(roots, reps["rid"] == roots["node"]).select("rid", "root", "first")
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("name")), "root")
    groups = reps.join(counts, "rid", "left").join(named.select("rid", "name"), "rid", "left").select(
        "label", "vector", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("name", "first").alias("component_id"))
    usable = _usable(F.col("vector"), F.col("label"))
    keyed = rows.withColumn("label", F.when(usable, F.col("label"))).withColumn(
        "vector", F.when(usable, F.col("vector")))
    return keyed.join(groups, ["label", "vector"], "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
