import pytest

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["repo_id", "a", "b", "co_change_count"]
    assert df.count() > 0


def test_every_query_has_a_callable_and_names_are_unique():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert all(callable(f) for f in q.values())
    assert len(q) >= 90


def test_small_query_runs_on_whole_table(spark):
    df = E.queries()["line_count"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert df.count() == docs.count()


@pytest.mark.parametrize("missing", [("repograph.llm.queries", "corpus_pipeline"), ("public_tokenizers",)])
def test_entry_works_without_the_corpus_package(monkeypatch, missing):
    """Without the folders, or without a module that they import."""
    import importlib
    import sys
    with monkeypatch.context() as m:
        for name in [n for n in sys.modules if n.startswith("repograph.llm") or n == "corpus_pipeline"]:
            m.delitem(sys.modules, name)
        for name in missing:
            m.setitem(sys.modules, name, None)
        bare = set(importlib.reload(E).queries())
    importlib.reload(E)
    assert len(bare) >= 90 and not any(k.startswith("op") or k == "pipeline" for k in bare)
