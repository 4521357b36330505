"""Vector code compression: product codes learned with per-dimension value dictionaries.

Each component x becomes the integer floor(256 * x). A vector is cut into equal parts; every
part position has a codebook of integer entries, and a vector's code names the nearest entry of
each part. Distances are never computed from the components: each dimension of a batch has a
dictionary of its distinct integers, the squared differences of every dictionary value to all
entries are tabulated once, and a part's distances are gathers from these tables by dictionary
code and adds. Dictionaries and tables live as long as their batch, whatever the value range.

Training passes read a stored table of integer vectors. A task returns one sum and one count
for each entry and dimension, whatever its number of rows; these are added up by Spark, and the
driver holds only the codebooks (``entries`` x dimensions). All arithmetic is on integers, so
the result does not depend on the order of rows or on the number of tasks.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repograph.llm.common import arrow_batches, stored

SCALE = 256
#: Largest absolute integer of a component: sums of squared differences stay within 64 bits.
LIMIT = 1 << 26
CHUNK = 2048                  # rows whose distances are held at once


def _kept(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def dictionary(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct integers, code of each value in them)."""
    low, high = int(values.min()), int(values.max())
    if high - low > 4 * len(values) + 1024:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(high - low + 1, bool)
    seen[values - low] = True
    code = np.cumsum(seen) - 1
    return np.flatnonzero(seen) + low, code[values - low]


def nearest(values: np.ndarray, codebook: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and the squared distance to it, both (rows, parts).

    ``values`` is (rows, dimensions), ``codebook`` (entries, dimensions); ties go to the lower
    entry.
    """
    rows, dim = values.shape
    width = dim // parts
    entry = np.empty((rows, parts), np.int64)
    error = np.empty((rows, parts), np.int64)
    for part in range(parts):
        tables, codes = [], []
        for d in range(part * width, (part + 1) * width):
            distinct, code = dictionary(values[:, d])
            tables.append((distinct[:, None] - codebook[None, :, d]) ** 2)
            codes.append(code)
        if sum(int(t.max()) for t in tables) < 1 << 31:
            tables = [t.astype(np.int32) for t in tables]
        for i in range(0, rows, CHUNK):
            total = tables[0][codes[0][i:i + CHUNK]]
            for table, code in zip(tables[1:], codes[1:]):
                total += table[code[i:i + CHUNK]]
            best = total.argmin(axis=1)
            entry[i:i + CHUNK, part] = best
            error[i:i + CHUNK, part] = total[np.arange(len(best)), best]
    return entry, error


def _partial_sums(codebook: np.ndarray, parts: int):
    """mapInArrow over integer vectors: a row for each dimension and entry used in the task."""
    def run(batches: Iterator) -> Iterator:
        dim, size = codebook.shape[1], len(codebook)
        sums, counts = np.zeros((dim, size), np.int64), np.zeros((dim, size), np.int64)
        for b in arrow_batches(batches):
            values = _matrix(b.column(0)).astype(np.int64)
            entry, _ = nearest(values, codebook, parts)
            for d in range(dim):
                of = entry[:, d // (dim // parts)]
                counts[d] += np.bincount(of, minlength=size)
                # exact in doubles: at most 2^26 a value and far fewer than 2^26 rows in a batch
                sums[d] += np.bincount(of, weights=values[:, d], minlength=size).astype(np.int64)
        d, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(d, pa.int32()), pa.array(e, pa.int32()), pa.array(sums[d, e]), pa.array(counts[d, e])],
            names=["dim", "entry", "total", "n"])
    return run


def train_codebook(values: DataFrame, codebook: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """``rounds`` of assigning every part of ``values`` (one column of integer lists) and
    replacing each used entry by floor(sum / count) of its parts."""
    for _ in range(rounds if len(codebook) else 0):
        found = values.mapInArrow(_partial_sums(codebook, parts), "dim int, entry int, total long, n long")
        found = found.groupBy("dim", "entry").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        codebook = codebook.copy()
        for r in found.collect():               # at most dimensions x entries rows
            codebook[r["entry"], r["dim"]] = r["total"] // r["n"]
    return codebook


def codebook_digest(codebook: np.ndarray, parts: int) -> str:
    """SHA-256 of the decimal components by part, entry and position within the part."""
    if not len(codebook):
        return hashlib.sha256(b"").hexdigest()
    by_part = codebook.reshape(len(codebook), parts, -1).transpose(1, 0, 2)
    return hashlib.sha256(",".join(map(str, by_part.ravel().tolist())).encode()).hexdigest()


def decode(codes: list[str], codebook: np.ndarray, parts: int) -> np.ndarray:
    """The integer vectors that code strings stand for."""
    entry = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), parts)
    width = codebook.shape[1] // parts
    return np.concatenate([codebook[entry[:, p], p * width:(p + 1) * width] for p in range(parts)], axis=1)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", parts: int = 16, entries: int = 64,
                 rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """((id, label, code, error, label_error) of every usable vector, the codebook).

    The codebook starts as the parts of the ``entries`` smallest ids, takes ``rounds`` of
    assignment and means, and every part is assigned again. ``error`` is the sum of a vector's
    squared part distances, ``label_error`` the sum of errors over equal labels.

    Defined results: vectors that are null or hold a null or non-finite component are dropped.
    Null labels are one label; null ids stand after all others in the order of ids, rows that
    share an id in the order of their vectors; repeated rows count as often as they stand there.
    With fewer usable vectors than ``entries`` there are fewer entries. The dimension is that of
    the vector with the smallest id whose length is a positive multiple of ``parts``; vectors of
    another length, or with an integer beyond ``LIMIT``, take no part in training and have null
    code and error. An empty table gives no rows and an empty codebook.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a code has two hexadecimal digits a part")
    vector = F.col(vector_col)
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"),
                          vector.alias("vector")).where(_kept(vector))
    order = [F.col("id").asc_nulls_last(), "vector"]
    first = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0)).orderBy(*order).select(
        F.size("vector").alias("dim")).limit(1).collect()
    dim = first[0]["dim"] if first else parts
    fits = (F.size("vector") == dim) & F.forall("vector", lambda x: F.abs(x) < LIMIT // SCALE)
    seeds = kept.where(fits).orderBy(*order).select("vector").limit(entries).collect()
    codebook = np.array([[int(np.floor(SCALE * float(x))) for x in r["vector"]] for r in seeds],
                        np.int64).reshape(len(seeds), dim)

    whole = stored(kept.where(fits).select("id", "label", F.transform(
        "vector", lambda x: F.floor(x.cast("double") * SCALE).cast("int")).alias("ints")), "int-vectors")
    codebook = train_codebook(whole.select("ints"), codebook, parts, rounds)
    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType),
                           T.StructField("label", kept.schema["label"].dataType),
                           T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def assign(batches: Iterator) -> Iterator:
        for b in arrow_batches(batches):
            entry, error = nearest(_matrix(b.column(2)).astype(np.int64), codebook, parts)
            text = entry.astype(np.uint8).tobytes().hex()
            size = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([text[i:i + size] for i in range(0, len(text), size)]),
                 pa.array(error.sum(axis=1))], names=["id", "label", "code", "error"])

    coded = stored(whole.mapInArrow(assign, schema), "vector-codes")
    total = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    unfit = kept.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"),
                                     F.lit(None).cast("long").alias("error"))
    rows, by_label = coded.union(unfit).alias("r"), total.alias("t")
    return rows.join(by_label, F.col("r.label").eqNullSafe(F.col("t.label")), "left").select(
        F.col("id").alias(id_col), F.col("r.label").alias(label_col), "code", "error", "label_error"), codebook
