import random

import numpy as np
import xxhash

from repograph.llm.simhash import (GrayIndex, fingerprint, fingerprint_links, merge_labels, one_per_group,
                                   simhash_groups, split_mask)
from repograph.llm.common import connected_components
from .helpers import edge_docs, empty_docs, words


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def components(codes, k=3):
    label = np.arange(len(codes))
    while True:
        new = np.array([label[np.bitwise_count(codes ^ c) <= k].min() for c in codes])
        if (new == label).all():
            return label
        label = new


def brute(rows):
    fps = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    label = components(fps)
    name = {}
    for l, (d, _) in zip(label, rows):
        if d is not None:
            name[l] = min(name.get(l, d), d)
    return sorted(((d, int(f), name.get(l)) for (d, _), f, l in zip(rows, fps, label)), key=str)


def run(df):
    return sorted(((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash_groups(df).collect()), key=str)


def test_fingerprint_across_slices(monkeypatch):
    import repograph.llm.simhash as S
    text = words(900, 5, 60) + "  \n\t" + words(40, 6)
    for size in (1, 3, 17, 1000):
        monkeypatch.setattr(S, "SLICE", size)
        for t in (text, "a", "a b", " a  b c ", "  "):
            assert fingerprint(t) == plain_fingerprint(t)


def test_fingerprint_of_any_length():
    for t in (None, "", "a", "a b", "a b c", "A B\tc\x0bd", "é É x y", words(70_000, 1, 50)):
        assert fingerprint(t) == plain_fingerprint(t)


def test_groups_match_brute_force(spark):
    r, rows = random.Random(3), []
    for k in range(12):
        base = words(400, k).split()
        for c in range(5):
            w = list(base)
            for _ in range(c):
                w[r.randrange(len(w))] = f"edit{r.randrange(10 ** 6)}"
            rows.append((len(rows), " ".join(w)))
    got, want = run(spark.createDataFrame(rows, "doc_id long, text string")), brute(rows)
    assert got == want
    assert 12 <= len({c for *_, c in want}) < len(rows)


def test_edge_rows(spark):
    df, rows, _ = edge_docs(spark)
    assert run(df) == brute([r[:2] for r in rows])
    assert run(empty_docs(spark)) == []
    kept = one_per_group(df)
    assert kept.columns == df.columns
    names = {c for *_, c in brute([r[:2] for r in rows])}
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, names))


def test_hot_buckets_are_split_without_loss(spark):
    r = np.random.RandomState(1)
    base = r.randint(0, 1 << 62, 40).astype(np.uint64)
    near = base[r.randint(0, 40, 1500)]
    for _ in range(3):
        near = near ^ np.where(r.rand(1500) < 0.8, np.uint64(1) << r.randint(0, 64, 1500).astype(np.uint64),
                               np.uint64(0))
    same_block = (r.randint(0, 1 << 48, 1500).astype(np.uint64) << np.uint64(16)) | np.uint64(7)
    codes = np.unique(np.r_[base, near, same_block])
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    for rows in (100_000, 50):
        found = connected_components(fingerprint_links(df, 3, rows)).collect()
        root = {x.node: x.root for x in found}
        ours = np.array([root.get(int(c), int(c)) for c in codes.view(np.int64)])
        want = components(codes)
        assert len(set(zip(ours.tolist(), want.tolist()))) == len(set(want.tolist())) == len(set(ours.tolist()))


def test_index_finds_every_pair():
    r = np.random.RandomState(2)
    codes = np.unique(r.randint(0, 1 << 14, 700).astype(np.uint64))
    run_of = (codes >> np.uint64(12)).astype(int)
    got = set()
    for a, b in GrayIndex(codes, run_of).links(3):
        got |= set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
            if run_of[i] == run_of[j] and int(codes[i] ^ codes[j]).bit_count() <= 3}
    assert got == want


def test_masks_cover_all_bits():
    parts = split_mask(0xFFFF, 4)
    assert all(p & 0xFFFF == 0xFFFF for p in parts)
    assert sum(p ^ 0xFFFF for p in parts) == (1 << 64) - 1 - 0xFFFF


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7), (9, None)]
    got = {r.node: r.root for r in connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}}


def test_merge_labels():
    label = np.arange(6)
    merge_labels(label, np.array([4, 5, 2]), np.array([5, 1, 3]))
    assert label.tolist() == [0, 1, 2, 2, 1, 1]


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b, c, d, e = (words(80, 50 + k) for k in range(5))
    rows = [(1, a), (1, b), (None, c), (None, d), (None, d), (None, e), (2, e), (None, a), (3, None), (3, c.upper()), (4, b)]
    got = one_per_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "text"]
    want = [(1, a), (1, b), (None, d), (2, e), (3, None), (3, c.upper())]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
