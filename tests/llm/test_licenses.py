import re

from repograph.llm.licenses import BASE, TEMPLATES, LicenseIndex, license_matches, license_word_frequencies
from repograph.llm.queries import QUERIES
from .helpers import LONG, edge_docs, empty_docs

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    """All templates at all places, without any index."""
    w, out = WORD.findall((text or "").translate(LOW)), []
    for label, phrase, keys, base in [(*b, (), True) for b in BASE] + [(*t, False) for t in TEMPLATES]:
        p = phrase.split()
        for s in range(1 - len(p), len(w)):
            same = [0 <= s + i < len(w) and w[s + i] == x for i, x in enumerate(p)]
            spans = [next(range(i, i + len(k)) for i in range(len(p)) if p[i:i + len(k)] == k)
                     for k in (key.split() for key in keys)]
            if sum(same) >= (len(p) if base else 0.8 * len(p)) and all(same[i] for r in spans for i in r):
                out.append((label, base, s, sum(same) / len(p)))
    return len(w), sorted(out)


TEXTS = ["Licensed under CC BY-NC 4.0.", "licensed under the GNU General Public License, version 3. All rights\nreserved.",
         "All rights all rights reserved reserved all Rights RESERVED", "by cc by cc by", "Released under the MIT License",
         "Licensed beneath the Apache License, Version 2.0", "the Apache Licence, Version 2.0", "general publicé license",
         "rights reserved all", "GNU Lesser General Public License v3 " * 3, "License, version 2.0", "İcc by ſ"]


def rows_of(df):
    return sorted((str(r.doc_id), r.n_words, sorted((m.label, m.base, m.start, m.score) for m in r.found))
                  for r in license_matches(df).collect())


def test_matches_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert rows_of(df) == sorted((str(i), *brute(t)) for i, t in enumerate(TEXTS))


def test_edge_rows(spark):
    df, rows, _ = edge_docs(spark)
    assert rows_of(df) == sorted((str(r[0]), len(WORD.findall((r[1] or "").translate(LOW))), []) for r in rows)
    assert license_matches(empty_docs(spark)).count() == 0


def test_statistics_cover_all_rows(spark):
    df = spark.createDataFrame([("license license",), ("the license",), (None,)], "text string").repartition(3)
    words, n = license_word_frequencies(df)
    assert (n, words[b"license"], words[b"the"], words[b"gnu"]) == (3, 2, 1, 0)


def test_words_across_slices():
    import repograph.llm.licenses as L
    index, text = LicenseIndex(), LONG + " all rights reserved é " * 500
    whole = index.word_ids(text)
    L.SLICE, old = 1000, L.SLICE
    try:
        assert (index.word_ids(text) == whole).all() and len(whole) == len(WORD.findall(text))
    finally:
        L.SLICE = old


def test_query_digest(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op6_license_scan"](spark, sf).collect():
        n, found = docs[r.doc_id]
        base = [m for m in found if m[1]]
        assert (r.n_words, r.n_base) == (n, len(base))
        assert r.first_word == min((m[2] for m in base), default=None)
        assert r.last_word == max((m[2] for m in base), default=None)
        assert r.base_labels == ",".join(sorted({m[0] for m in base}))
        assert r.labels == ",".join(sorted({m[0] for m in found}))
