import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers

from repograph.llm.lang_id import (LanguageModel, Pieces, expected_counts, forward, held_out, identified_documents,
                                   log_forward, predict, split_words, train, word_scores, _pieces)
from repograph.llm.queries import QUERIES
from .helpers import edge_docs, empty_docs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def segmentations(raw):
    for cuts in itertools.product((0, 1), repeat=len(raw) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(raw)]
        yield [raw[a:b] for a, b in zip(at, at[1:])]


def test_forward_sums_all_segmentations():
    pieces = _pieces(RANKS)
    r = np.random.RandomState(0)
    prob = np.vstack([r.rand(pieces.n, 2), np.zeros((1, 2))])
    word = " thé x"[:6]
    raw = word.encode()
    ids = {}
    for a, b in itertools.combinations(range(len(raw) + 1), 2):
        m = np.frombuffer(raw[a:b], np.uint8)[None, :]
        ids[raw[a:b]] = int(pieces.lookup(m)[b - a - 1][0, 0]) if b - a <= 8 else -1
    total, counts = 0, {}
    for s in segmentations(raw):
        p = np.prod([prob[ids[x]] for x in s], axis=0)
        total = total + p
        for x in s:
            counts[ids[x]] = counts.get(ids[x], 0) + p[0]
    alpha, _ = forward(pieces, np.frombuffer(raw, np.uint8)[None, :], prob)
    assert np.allclose(alpha[-1][0], total)
    got = expected_counts(pieces, [word[1:]], np.array([2.0]), prob[:, :1])
    for i, c in counts.items():
        if i >= 0:
            assert np.isclose(got[i], 2 * c / total[0])


def test_long_words_are_scored_whole():
    pieces = _pieces(RANKS)
    prob = np.vstack([np.full((pieces.n, 1), 1 / pieces.n), np.zeros((1, 1))])
    a, b = word_scores(pieces, ["ab" * 16, "ab" * 1600], prob)[:, 0]
    assert b < 50 * a < 0 and np.isfinite(b)


def slow_score(pieces, word, prob, language):
    """Log forward sum by exact fractions of a word's pieces, one at a time."""
    raw, known = b" " + word.encode(), {}
    alpha = [(1.0, 0)]                                     # mantissa and exponent
    for t in range(1, len(raw) + 1):
        terms = []
        for k in range(1, min(t, 8) + 1):
            part = raw[t - k:t]
            if part not in known:
                known[part] = int(pieces.lookup(np.frombuffer(part, np.uint8)[None, :])[k - 1][0, 0])
            if known[part] >= 0:
                m, e = alpha[t - k]
                terms.append((m * prob[known[part], language], e))
        top = max(e for _, e in terms)
        m, e = math.frexp(sum(math.ldexp(x, y - top) for x, y in terms))
        alpha.append((m, e + top))
    return math.log(alpha[-1][0]) + alpha[-1][1] * math.log(2)


THAI = "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอนหรือวรรณยุกต์เช่นเดียวกับภาษาจีน"


def small_model(smallest=1e-12):
    pieces, r = _pieces(RANKS), np.random.RandomState(5)
    prob = smallest ** r.rand(pieces.n, 3)
    return pieces, np.vstack([prob / prob.sum(axis=0), np.zeros((1, 3))])


def test_words_of_any_length_equal_brute_force(monkeypatch):
    pieces, prob = small_model()
    words = ["a", THAI, "x" * 31, "x" * 32, "é" * 200, "Donaudampfschifffahrtsgesellschaftskapitän", "ab" * 700]
    want = [[slow_score(pieces, w, prob, k) for k in range(3)] for w in words]
    assert np.allclose(word_scores(pieces, words, prob), want, rtol=1e-9)
    monkeypatch.setattr("repograph.llm.lang_id.BLOCK_BYTES", 13)          # blocks carry their last values
    assert np.allclose(word_scores(pieces, words, prob), want, rtol=1e-9)
    m = np.frombuffer(b" kurz", np.uint8)[None, :]
    assert np.allclose(log_forward(pieces, m, prob), np.log(forward(pieces, m, prob)[0][-1]))


def test_tiny_probabilities_do_not_underflow():
    pieces = _pieces(RANKS)
    prob = np.vstack([np.full((pieces.n, 1), 1e-15), np.zeros((1, 1))])
    assert np.isfinite(word_scores(pieces, ["\u0e01" * 5000, "q" * 16, "zq" * 100], prob)).all()
    got = expected_counts(pieces, ["zq" * 3000], np.array([1.0]), prob)
    assert np.isfinite(got).all() and got.sum() > 0


def test_expected_counts_of_long_words_cover_every_byte():
    pieces, prob = small_model()
    got = expected_counts(pieces, [THAI, "ab" * 500], np.array([2.0, 1.0]), prob[:, :1])
    size = np.zeros(pieces.n)
    for length, (keys, base) in enumerate(zip(pieces.keys, pieces.base), 1):
        size[base:base + len(keys)] = length
    assert np.isclose((got[:-1] * size).sum(), 2 * (1 + len(THAI.encode())) + 1001)


def test_predictions_equal_brute_force(spark):
    pieces, prob = small_model(1e-6)
    model = LanguageModel(RANKS, ["a", "b", "c"], np.log([0.5, 0.3, 0.2]), prob)
    texts = [THAI + " " + THAI[:9], "the cat sat", "ab" * 90 + " x", "É é", "a", "z", "", None, "1 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in predict(df, model).collect():
        found = [w for w in split_words(pa.array([texts[r.doc_id]]))[0].as_py() if w]
        logs = np.array([p + sum(slow_score(pieces, w, prob, k) for w in found) for k, p in enumerate(model.prior)])
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == "abc"[logs.argmax()]
            assert np.isclose(r.score, 1 / np.exp(logs - logs.max()).sum(), rtol=1e-6)


def test_sample_is_bounded_and_takes_rows_without_id(spark):
    rows = [(None, f"wort{i} und", "de") for i in range(40)] + [(7, "the same", "en")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(df, RANKS, sample_rows=10)
    assert model.languages == ["de", "en"] and np.allclose(np.exp(model.prior), [40 / 90, 50 / 90])
    assert [r.lang_pred for r in predict(df.dropDuplicates(), model).orderBy("lang_pred").collect()] == ["de"] * 40 + ["en"]


def test_edge_rows(spark):
    df, rows, _ = edge_docs(spark)
    model = train(df, RANKS)
    assert model.languages == ["de", "en", "fr"]
    out = [(r.doc_id, r.lang_pred, r.score) for r in predict(df, model).collect()]
    assert sorted(str(d) for d, *_ in out) == sorted(str(r[0]) for r in rows)
    by = {}
    for d, lang, score in out:
        by.setdefault(d, []).append((lang, score))
        assert 0 <= score <= 1
    assert by[2] == by[4] == [("und", 0.0)] and ("und", 0.0) in by[3]
    kept = identified_documents(df, model, min_score=0.0)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert predict(empty_docs(spark), model).count() == 0
    assert train(empty_docs(spark), RANKS) is None
    assert {r.lang_pred for r in predict(df, None).collect()} == {"und"}
    assert identified_documents(df, None).count() == 0


def test_text_without_letters_is_undetermined():
    m = LanguageModel(RANKS, ["a"], np.zeros(1), np.vstack([np.full((_pieces(RANKS).n, 1), 1e-5), np.zeros((1, 1))]))
    got = m.scorer()(pa.array(["12 %% 3", None, "", "x1", "1 é"]))[:, 0]
    assert np.isnan(got[:3]).all() and np.isfinite(got[3:]).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = QUERIES["op2_language_id"](spark, sf).collect()
    assert len(out) == len(lang)
    test = [r for r in out if r.held_out]
    assert {r.doc_id for r in test} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.97 * len(test)
