import math

import numpy as np

from repograph.llm.embedding_dedup import calibrated_count, embedding_groups
from repograph.llm.queries import QUERIES


def brute(rows, threshold=0.98):
    usable = [i for i, (_, v, l) in enumerate(rows) if l is not None and v is not None and len(v)
              and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(rows))}
    for i in usable:
        for j in usable:
            a, b = rows[i], rows[j]
            if i != j and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    near[i].append(j)
    out = []
    for i, (d, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(near[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "vec_id long, embedding array<float>, label int, rid int, cell string")
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in embedding_groups(df, **k).collect()), key=str)


def clusters(n, size, seed, spread):
    r, out = np.random.RandomState(seed), []
    for c in range(n):
        centre = r.standard_normal(32)
        for _ in range(size):
            v = centre + spread * r.standard_normal(32)
            out.append((len(out), v.astype(np.float32).tolist(), int(c % 2)))
    return out


def test_matches_brute_force(spark):
    rows = clusters(30, 5, 1, 0.08)
    assert run(spark, rows) == brute(rows)
    assert any(n for _, n, _ in brute(rows))


def test_cells_and_chunks_lose_no_link(spark):
    rows = clusters(6, 60, 2, 0.09) + [(1000 + i, v, l) for i, v, l in clusters(1, 150, 3, 0.03)]
    want = brute(rows)
    assert run(spark, rows, cell_rows=16) == want == run(spark, rows, cell_rows=100_000)


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, the hardest ones."""
    r, rows = np.random.RandomState(4), []
    for k in range(400):
        a = r.standard_normal(32)
        a /= np.linalg.norm(a)
        b = r.standard_normal(32)
        b -= a * (a @ b)
        c = 0.9801
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * b / np.linalg.norm(b)).tolist(), 0)]
    got = run(spark, rows, cell_rows=64)
    assert sum(n for _, n, _ in got) >= 0.95 * sum(n for _, n, _ in brute(rows))


def test_edge_rows(spark):
    inf, nan = float("inf"), float("nan")
    a, b = [1.0, 0.5, -0.25], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (2, a, 0), (2, a, 0), (3, [2.0, 1.0, -0.5], 0), (4, a, 1), (5, a, None), (6, None, 0),
            (7, [0.0, 0.0, 0.0], 0), (8, [nan, 1.0, 0.0], 0), (9, [inf, 1.0, 0.0], 0), (10, [None, 1.0, 0.0], 0),
            (11, [], 0), (12, [1.0, 0.5], 0), (None, b, 0), (None, b, 0), (13, [0.0, 3e38, 0.0], 0),
            (14, [1e-38, 0.0, 0.0], 0), (None, [5.0, -5.0, 1.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_count_is_calibrated():
    p = math.erf(2 / math.sqrt(2))
    c = calibrated_count(24, 2.0, 0.9999)
    tail = [sum(math.comb(24, k) * p ** k * (1 - p) ** (24 - k) for k in range(x, 25)) for x in (c, c + 1)]
    assert tail[0] >= 0.9999 > tail[1]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op10_embedding_dedup"](spark, sf).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
