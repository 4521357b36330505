import random

from pyspark.sql import functions as F

from conftest import rows
from repograph.operators import report as RP
from repograph.operators import verify as V


def _gate(spark):
    files = spark.createDataFrame([("r", "f0001", "a.py"), ("r", "f0002", "b.py")],
                                  "repo_id string, file_id string, path string")
    mods = spark.createDataFrame([("r", "m001", ".")], "repo_id string, module_id string, path string")
    mf = spark.createDataFrame([("r", "m001", "f0001"), ("r", "m001", "f0002")],
                               "repo_id string, module_id string, file_id string")
    edges = spark.createDataFrame([("r", "e0001", "resolved")],
                                  "repo_id string, edge_id string, resolution string")
    nodes = spark.createDataFrame(
        [("r", "p", 0, "n1", 0, "A", "d", "high", False),
         ("r", "p", 1, "n2", 1, "B", "d", "high", False),
         ("r", "p", 2, "n2", 1, "B", "d", "high", False),          # duplicate id
         ("r", "p", 3, "n3", 1, "C", "", "low", True),              # ungrounded, no description
         ("r", "p", 4, "n4", 1, "D", "guess", "low", True)],       # allowed interpretation
        "repo_id string, perspective_id string, ord long, node_id string, tier int, label string, "
        "description string, confidence string, interpretation boolean")
    refs = spark.createDataFrame(
        [("r", "p", 0, "n1", "file", "f0001", 0), ("r", "p", 1, "n2", "file", "f9999", 0),
         ("r", "p", 2, "n2", "module", "m404", 0)],
        "repo_id string, perspective_id string, ord long, node_id string, ref_kind string, "
        "ref_id string, ref_pos long")
    rels = spark.createDataFrame([("r", "p", 0, "n1", "n2", "uses", "high"),
                                  ("r", "p", 1, "n1", "ghost", "x", "low")],
                                 "repo_id string, perspective_id string, ord long, from_id string, "
                                 "to_id string, label string, confidence string")
    rrefs = spark.createDataFrame([("r", "p", 0, "e0001"), ("r", "p", 1, "e0404")],
                                  "repo_id string, perspective_id string, ord long, edge_id string")
    return files, mods, mf, edges, nodes, refs, rels, rrefs


def test_gate_checks(spark):
    files, mods, mf, edges, nodes, refs, rels, rrefs = _gate(spark)
    assert rows(V.dup_node_ids(nodes), "subject") == [("n2",)]
    assert rows(V.orphan_file_refs(refs, files), "ref") == [("f9999",)]
    assert rows(V.orphan_module_refs(refs, mods), "ref") == [("m404",)]
    assert rows(V.orphan_edge_refs(rrefs, edges), "ref") == [("e0404",)]
    assert rows(V.relationship_endpoints(rels, nodes), "subject", "ref") == [("to", "ghost")]
    assert rows(V.empty_grounding(nodes, refs), "subject") == [("n3",)]
    present = spark.createDataFrame([("r", "b.py")], "repo_id string, path string")
    assert rows(V.file_existence(refs, files, present), "subject", "ref") == [("f0001", "a.py")]
    cov = V.covered_files(refs, mf, files)
    assert rows(cov, "file_id") == [("f0001",)]  # m404 is unknown, so no module members
    persp = spark.createDataFrame([("r", "p")], "repo_id string, perspective_id string")
    c = V.coverage_by_perspective(persp, nodes, V.coverage_bitmaps(refs, mf, files), files).first()
    assert (c.node_count, c.files_covered, c.coverage_pct) == (5, 1, 50.0)
    viol = V.union_all([V.dup_node_ids(nodes), V.commit_match(
        spark.createDataFrame([("r", "x", None)], "repo_id string, narrative_id string, "
                                                   "based_on_facts_commit string"),
        spark.createDataFrame([("r", None)], "repo_id string, head_commit string"))])
    g = V.gate_status(persp.withColumnRenamed("perspective_id", "scope"), viol).first()
    assert (g.n_errors, g.n_warnings, g.status) == (1, 0, "FAIL")


def test_bitmap_coverage_equals_distinct_files(spark):
    """Buckets of 32,768 files, files covered several times over, unknown ids, by perspective and in all."""
    r = random.Random(5)
    n = 100_000
    files = spark.range(1, n + 1).select(F.lit("r").alias("repo_id"), F.format_string("f%04d", "id").alias("file_id"))
    mf = files.withColumn("module_id", F.concat(F.lit("m"), F.xxhash64("file_id") % 50))
    refs = [("r", p, "file", f"f{r.randrange(1, n + 5000):04d}") for p in "pq" for _ in range(500)]
    refs += [("r", p, "module", f"m{k}") for p, ks in (("p", (1, 2, 2, -3, 99)), ("q", (2, 3))) for k in ks]
    refs = spark.createDataFrame(refs + refs[:50], "repo_id string, perspective_id string, ref_kind string, ref_id string")
    rows_ = V.covered_files(refs, mf, files)
    bits = V.coverage_bitmaps(refs, mf, files)
    persp = spark.createDataFrame([("r", "p"), ("r", "q"), ("r", "none")], "repo_id string, perspective_id string")
    nodes = persp.withColumn("node_id", F.lit("n"))
    expected = {x.perspective_id: x.n for x in rows_.groupBy("perspective_id").agg(F.count("*").alias("n")).collect()}
    got = {x.perspective_id: x.files_covered for x in V.coverage_by_perspective(persp, nodes, bits, files).collect()}
    assert got == {**expected, "none": 0}
    edges = spark.createDataFrame([], "repo_id string, resolution string")
    total = V.coverage_total(persp, nodes, bits, files, edges).first().files_covered
    assert total == rows_.select("file_id").distinct().count()
    assert bits.count() <= 2 * 5


def test_coverage_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 32)], "c long, t long")
    assert df.select(V._pct(F.col("c"), F.col("t")).alias("p")).first().p == 3.12


def test_capability_refs_both_errors(spark):
    claims = spark.createDataFrame(
        [("r", "b", "capability", 1, "cap1", "unknown-p", "n1"),
         ("r", "b", "capability", 2, "cap2", None, "n1"),
         ("r", "b", "capability", 3, "cap3", "p", "n1")],
        "repo_id string, brief_id string, claim_kind string, ord long, label string, "
        "perspective_ref string, node_ref string")
    persp = spark.createDataFrame([("r", "p")], "repo_id string, perspective_id string")
    nodes = spark.createDataFrame([("r", "p", "n1")], "repo_id string, perspective_id string, "
                                                      "node_id string")
    assert rows(V.capability_refs(claims, persp, nodes), "subject", "ref") == [
        ("cap1", "n1"), ("cap1", "unknown-p"), ("cap2", "n1")]


def test_code_budget_greedy_not_prefix(spark):
    sized = spark.createDataFrame(
        [("r", "f1", 0), ("r", "f2", 150), ("r", "f3", 80), ("r", "f4", 30), ("r", "f5", 10)],
        "repo_id string, file_id string, n long")
    out = rows(RP.code_budget(sized, 100), "file_id", "dropped")
    # total is 0 after the empty file, so the 150-byte file is admitted; later ones only
    # fit while the running total stays within 100 - none does.
    assert out == [("f1", False), ("f2", False), ("f3", True), ("f4", True), ("f5", True)]
    sized2 = spark.createDataFrame([("r", "a", 80), ("r", "b", 80), ("r", "c", 20)],
                                   "repo_id string, file_id string, n long")
    assert rows(RP.code_budget(sized2, 100), "file_id", "dropped") == [
        ("a", False), ("b", True), ("c", False)]


def test_code_payload_flags(spark):
    refs = spark.createDataFrame([("r", "p", 0, "n", "file", "f1", 0), ("r", "p", 0, "n", "file", "f2", 0),
                                  ("r", "p", 0, "n", "file", "f3", 0), ("r", "p", 0, "n", "file", "zz", 0)],
                                 "repo_id string, perspective_id string, ord long, node_id string, "
                                 "ref_kind string, ref_id string, ref_pos long")
    files = spark.createDataFrame([("r", "f1", "a.py", "python"), ("r", "f2", "b.py", "python"),
                                   ("r", "f3", "c.py", "python")],
                                  "repo_id string, file_id string, path string, lang string")
    contents = spark.createDataFrame([("r", "a.py", "é" * 60), ("r", "b.py", "x" * 30)],
                                     "repo_id string, path string, content string")
    out = {r.file_id: r for r in RP.code_payload(refs, files, contents, 101, 1000).collect()}
    assert set(out) == {"f1", "f2", "f3"}
    assert out["f1"].truncated and len(out["f1"].content.encode()) == 100
    assert out["f3"].missing and out["f3"].content == ""
    assert not out["f2"].dropped
