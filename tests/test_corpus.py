"""Derived tables are built when they are read, and their shuffles grow in number of partitions."""
import json
import re
import tempfile

from pyspark.sql import functions as F

from conftest import SF
from repograph.plans import corpus as C
from repograph.plans import queries as Q


def _built(spark):
    return {k[1:] for k in C._MATERIALIZED if k[0] == spark.sparkContext.applicationId}


def test_a_query_builds_only_the_tables_it_reads(spark, monkeypatch):
    monkeypatch.setattr(C, "_MATERIALIZED", {})
    monkeypatch.setattr(Q, "_FACTS", {})
    Q.QUERIES["dup_perspective_ids"](spark, SF).count()
    assert _built(spark) == {("n_perspectives", SF)}
    Q.QUERIES["tier0_nodes"](spark, SF).count()
    assert _built(spark) == {("n_perspectives", SF), ("n_nodes", SF)}
    Q.QUERIES["manifest_rows"](spark, SF).count()
    Q.QUERIES["js_imports_stmt"](spark, SF).count()
    assert {k[0] for k in _built(spark)} == {"n_perspectives", "n_nodes", "d_files", "m_files"}


def test_partitions_grow_with_the_stored_table(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="repograph-spread-", dir="/tmp") + "/t"
    spark.range(50_000).select("id", F.xxhash64("id").alias("v")).write.parquet(path)
    t = spark.read.parquet(path)
    few = C.spread(t, t, "id").rdd.getNumPartitions()
    monkeypatch.setattr(C, "PART_BYTES", 1 << 14)
    many = C.spread(t, t, "id").rdd.getNumPartitions()
    assert few == spark.sparkContext.defaultParallelism and many > 2 * few


def _odd_tables(spark):
    """Orders that share a key, lack a customer, a key or a priority, and lines without a part."""
    d = tempfile.mkdtemp(prefix="repograph-odd-", dir="/tmp")
    for name, schema, rows in [
            ("orders", "o_orderkey long, o_custkey long, o_orderpriority string",
             [(10, 1, "1-URGENT"), (10, 42, "1-URGENT"), (10, 1, "2-HIGH"), (20, None, "3-MEDIUM"),
              (None, 4, "5-LOW"), (30, 3, None), (17, 2, "1-URGENT"), (21, 80, "4-NOT")]),
            ("lineitem", "l_orderkey long, l_partkey long, l_linenumber int",
             [(10, 2, 1), (10, 1, 2), (10, None, 3), (10, 2, None), (None, 1, 1), (20, 2, 1), (21, 1, 1)]),
            ("part", "p_partkey long, p_brand string, p_type string, p_size int",
             [(1, "Brand#12", "ECONOMY", 5), (2, "Brand#13", None, 5), (2, "Brand#13", "PROMO", 5)])]:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_documents_carry_all_orders_of_shared_and_missing_keys(spark):
    docs = [(r.doc_id, json.loads(r.json)) for r in C.n_documents(spark, _odd_tables(spark)).collect()]
    assert sorted((k or "" for k, _ in docs)) == ["", "", "1-URGENT#0", "1-URGENT#1", "2-HIGH#0", "4-NOT#2", "5-LOW#0"]
    by_id = dict(docs)
    first, second = by_id["1-URGENT#0"]["perspectives"][0]["nodes"]
    assert [first["id"], second["id"]] == ["n1", "n2"]
    # Two orders of one key and priority: every line and edge twice, a package once a customer.
    files, mods = ["f0002", "f0002", "f0001", "fnull"], [None, "pkg_economy", "pkg_promo"]
    assert first["factRefs"] == {"fileIds": [f for f in files for _ in range(2)],
                                 "moduleIds": [m for m in mods for _ in range(2)]}
    assert second["factRefs"] == {"moduleIds": [], "fileIds": []} and second["children"] == ["n3", "n4"]
    edges = lambda k: [r["factEdgeIds"] for r in by_id[k]["perspectives"][0]["relationships"]]
    assert edges("1-URGENT#0") == [["e10", "e10"], []]
    assert edges("2-HIGH#0") == [["e10"]]
    assert by_id["2-HIGH#0"]["perspectives"][0]["nodes"][0]["factRefs"] == {"fileIds": files, "moduleIds": mods}
    assert by_id["4-NOT#2"]["businessBrief"]["problem"]["factRefs"]["fileIds"] == ["f0001"]
    apart = [d for k, d in docs if k is None]
    assert sorted((len(d["perspectives"][0]["nodes"]), len(d["perspectives"][0]["relationships"]))
                  for d in apart) == [(0, 1), (1, 0)] and not any("businessBrief" in d for d in apart)
    assert [n["id"] for n in by_id["5-LOW#0"]["nodes"]] == ["n4"] and by_id["5-LOW#0"]["relationships"][0]["factEdgeIds"] == []


def test_documents_need_no_stored_tables(spark, monkeypatch):
    monkeypatch.setattr(C, "_MATERIALIZED", {})
    Q.QUERIES["normalize_perspectives"](spark, SF).count()
    assert _built(spark) == {("n_docs", SF)}


def test_import_rows_meet_their_files_in_partitions_that_grow(spark, monkeypatch):
    Q.QUERIES["merge_edges"](spark, SF).count()  # its tables are stored
    monkeypatch.setattr(C, "PART_BYTES", 1 << 9)
    for name in ("merge_edges", "js_imports_line"):
        plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        dealt = [int(n) for n in re.findall(r"hashpartitioning\(repo_id#\d+, path#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]
        assert dealt and min(dealt) > 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), plan
