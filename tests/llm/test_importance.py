import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from repograph.llm import importance as I
from repograph.llm.importance import bucket_counts, importance_resample, word_features
from tests.llm.helpers import edge_docs, empty_docs, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, runs, buckets):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets
                    for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, runs=1, buckets=10_000, percent=10, least=20, seed="2024"):
    """Sorted (id, n_features, weight, score) of all rows, and those of the draw in rank order."""
    found = [(i, *features(t, runs, buckets)) for i, t in docs]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for x in target for b in features(x, runs, buckets)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * s_all / ((s[b] + 1.0) * t_all))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n))
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return sorted((r[:4] for r in out), key=str), [r[:4] for r in able[:percent * len(able) // 100]]


def frames(spark, docs, target, partitions):
    d = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in docs],
                              "doc_id long, text string, id int, hash string, rank int").repartition(partitions)
    return d, spark.createDataFrame([(t,) for t in target], "text string")


def check(result, expected):
    rows = [tuple(r) for r in result.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    every, drawn = expected
    assert sorted((r[:4] for r in rows), key=str) == every
    ranked = sorted((r for r in rows if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r[:4] for r in ranked] == drawn


@pytest.mark.parametrize("runs,percent,partitions", [(1, 10, 5), (2, 37, 3), (3, 100, 1)])
def test_equal_to_the_plain_definition(spark, monkeypatch, runs, percent, partitions):
    monkeypatch.setattr(I, "SEGMENT_ROWS", 16)
    r = random.Random(runs)
    docs = [(i, words(r.randrange(0, 60), i, 50)) for i in range(400)]
    target = [words(30, 1000 + i, 20) for i in range(10)]
    d, t = frames(spark, docs, target, partitions)
    check(importance_resample(d, t, max_words=runs, percent=percent, buckets=500),
          brute(docs, target, runs, 500, percent))


def test_one_score_for_most_rows_is_split_and_ranked(spark, monkeypatch):
    monkeypatch.setattr(I, "SEGMENT_ROWS", 8)
    same = words(25, 1)
    docs = [(None, same)] * 150 + [(7, same)] * 100 + [(i, words(25, i)) for i in range(50)]
    d, t = frames(spark, docs, ["w1 w2"], 4)
    check(importance_resample(d, t, percent=60), brute(docs, ["w1 w2"], percent=60))


def test_segments_are_near_equal(spark, monkeypatch):
    monkeypatch.setattr(I, "SEGMENT_ROWS", 50)
    sizes = []
    ranks = I._ranks

    def spy(first, last):
        sizes.append(np.diff(first))
        return ranks(first, last)
    monkeypatch.setattr(I, "_ranks", spy)
    docs = [(i % 3, words(20 + i % 5, i % 40)) for i in range(2000)]
    d, t = frames(spark, docs, ["w1"], 8)
    importance_resample(d, t, percent=50).collect()
    assert len(sizes[0]) == 39 and sizes[0].max() <= 100


def test_edge_rows(spark):
    df, rows, _ = edge_docs(spark, "id int, hash string, rid long, run long, neg int, rank string")
    docs = [(r[0], r[1]) for r in rows]
    target = spark.createDataFrame([(None,), ("",), ("W1 w2 日本語",)], "text string")
    check(importance_resample(df, target, percent=50), brute(docs, [None, "", "W1 w2 日本語"], percent=50))


def test_empty_tables(spark):
    none = empty_docs(spark)
    assert importance_resample(none, none).collect() == []
    docs = [(i, words(30, i)) for i in range(30)]
    d, _ = frames(spark, docs, ["x"], 2)
    check(importance_resample(d, none), brute(docs, []))
    check(importance_resample(d, none, min_words=1000), brute(docs, [], least=1000))


def test_features_of_one_batch():
    texts = [None, "", "Ab1 c-déE  x\x00y", "z" * 70 + " " + "q" * 64, "tail", "head tail"]
    for runs in (1, 2, 3):
        doc, bucket, n = word_features(pa.array(["cut", *texts]).slice(1), runs, 997)
        for i, t in enumerate(texts):
            count, expected = features(t, runs, 997)
            assert (n[i], sorted(bucket[doc == i].tolist())) == (count, sorted(expected))


def test_counts(spark):
    d = spark.createDataFrame([("a a b",), (None,)], "text string")
    assert bucket_counts(d, buckets=10).sum() == 3
