import hashlib
import math
import random

import numpy as np
import pytest

from repograph.llm.vector_codes import LIMIT, codebook_digest, decode, dictionary, nearest, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id long, ints string, code string"


def frame(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, 7, "clash", "x") for r in rows], SCHEMA).repartition(partitions)


def brute(rows, parts=16, entries=64, rounds=2):
    """(id, label, code, error) by the plain definition, and the codebook."""
    kept = [(i, lab, [float(np.float32(x)) for x in v]) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    ints = [[math.floor(256 * x) for x in v] for _, _, v in kept]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for p in range(parts)] for v in ints]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(part, p):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(assign(c[p], p)[0], []).append(c[p])
            for e, members in of.items():
                book[p][e] = tuple(sum(x) // len(members) for x in zip(*members))
    out = []
    for (i, lab, _), c in zip(kept, cut):
        found = [assign(c[p], p) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for e, _ in found), sum(d for _, d in found)))
    digest = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return out, digest


def with_label_errors(rows):
    total = {}
    for _, lab, _, e in rows:
        total[lab] = total.get(lab, 0) + e
    return sorted(((*r, total[r[1]]) for r in rows), key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(n, seed, dim=32):
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(dim)], r.choice([0, 1, 1, 1, None])) for i in range(n)]
    rows += [(n, [r.uniform(-500, 500) for _ in range(dim)], 2), (n + 1, [0.0] * dim, 2),
             (n + 2, None, 1), (n + 3, [None] + [0.5] * (dim - 1), 1), (n + 4, [math.nan] + [0.5] * (dim - 1), 1),
             (n + 5, [math.inf] * dim, None), (None, [0.25] * dim, 3), (None, [0.125] * dim, 3),
             (3, [0.1] * dim, 0), *[(n + 6, [0.5] * dim, 5)] * 4]
    return rows


@pytest.mark.parametrize("n", [5, 150])
def test_equal_to_the_plain_definition(spark, n):
    rows = vectors(n, n)
    codes, book = vector_codes(frame(spark, rows))
    expected, digest = brute(rows)
    assert collected(codes) == with_label_errors(expected)
    assert codebook_digest(book, 16) == digest


def test_same_result_on_any_number_of_tasks(spark):
    rows = vectors(90, 1)
    found = [vector_codes(frame(spark, rows, p), parts=8, entries=10, rounds=3) for p in (1, 7)]
    assert collected(found[0][0]) == collected(found[1][0])
    assert np.array_equal(found[0][1], found[1][1])


def test_vectors_that_do_not_fit(spark):
    rows = [(0, [1.0] * 15, 1), (1, [0.5] * 32, 1), (2, [0.25] * 16, 1), (3, [], 2), (4, [LIMIT / 256.0] * 32, 3),
            (5, [-0.5] * 32, 1)]
    codes, book = vector_codes(frame(spark, rows))
    found = {r["vec_id"]: tuple(r)[2:] for r in codes.collect()}
    assert book.shape == (2, 32)
    for i in (0, 2, 3, 4):
        assert found[i][:2] == (None, None)
    assert found[1] == ("00" * 16, 0, 0) and found[5] == ("01" * 16, 0, 0)


def test_empty(spark):
    codes, book = vector_codes(frame(spark, [], 1))
    assert codes.collect() == [] and codebook_digest(book, 16) == hashlib.sha256(b"").hexdigest()
    codes, _ = vector_codes(frame(spark, [(1, None, 1)], 1))
    assert codes.collect() == []


def test_dictionaries_and_decoding():
    r = np.random.RandomState(0)
    for values in (r.randint(-5, 5, 100), r.randint(-LIMIT, LIMIT, 100)):
        distinct, code = dictionary(values)
        assert np.array_equal(distinct, np.unique(values)) and np.array_equal(distinct[code], values)
    values, book = r.randint(-LIMIT, LIMIT, (50, 8)), r.randint(-LIMIT, LIMIT, (9, 8))
    entry, error = nearest(values, book, 4)
    for i in range(50):
        for p in range(4):
            d = [int(((values[i, 2 * p:2 * p + 2] - e[2 * p:2 * p + 2]) ** 2).sum()) for e in book]
            assert (entry[i, p], error[i, p]) == (d.index(min(d)), min(d))
    codes = [bytes(e).hex() for e in entry.astype(np.uint8).tolist()]
    assert (((values - decode(codes, book, 4)) ** 2).sum(axis=1) == error.sum(axis=1)).all()
