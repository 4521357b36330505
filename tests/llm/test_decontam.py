from repograph.llm.decontam import clean_documents, contained_items
from .helpers import LONG, edge_docs, empty_docs, words


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def brute(docs, items):
    out = set()
    for i, q in items:
        s = shingles(q)
        for d, t in docs:
            n = len(s & shingles(t))
            if s and n / len(s) >= 0.8:
                out.add((d, i, len(s), n))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in contained_items(d, i).collect()}


def test_matches_brute_force(spark):
    items = [(k, words(n, 100 + k)) for k, n in enumerate((3, 5, 6, 9, 14, 30, 70, 300))] + [(99, None), (98, "")]
    docs = []
    for k, (i, t) in enumerate(items[:8]):
        w = t.split()
        cut = max(1, len(w) // 6)
        docs += [(10 * k, words(200, k) + " " + t.upper() + "\n" + words(300, k + 50)),
                 (10 * k + 1, words(40, k) + " " + " ".join(w[cut:]) + " " + words(40, k + 1)),
                 (10 * k + 2, " ".join(w[:len(w) // 2])), (10 * k + 3, t),
                 (10 * k + 4, " ".join(w[:cut] + ["changed"] + w[cut + 1:]))]
    docs += [(900, items[4][1] + " " + items[5][1]), (901, None), (902, ""), (903, words(5000, 7))]
    assert run(spark, docs, items) == brute(docs, items)
    assert {d for d, *_ in brute(docs, items)} >= {900, 50, 60}


def test_edge_rows(spark):
    df, rows, _ = edge_docs(spark)
    items = spark.createDataFrame([(1, rows[0][1][:200]), (1, rows[0][1][:200]), (2, "one"), (None, "two words"),
                                   (3, " ".join(LONG.split()[500:520]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contained_items(df, items).collect()}
    assert got == {(0, 1), (1, 1), (None, 1), (5, 2), (None, None), (6, 3)}
    left = clean_documents(df, items)
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 3, 4, 7, 8]
    assert contained_items(empty_docs(spark), items).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert clean_documents(df, none).count() == len(rows)


def test_clean_rows_stay_beside_hits_with_their_id(spark):
    item, a, b = words(30, 90), words(60, 91), words(60, 92)
    rows = [(1, a), (1, a + " " + item), (None, b), (None, b + " " + item), (None, None), (2, item), (3, "")]
    got = clean_documents(spark.createDataFrame(rows, "doc_id long, text string"),
                          spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, a), (None, b), (None, None), (3, "")]))
