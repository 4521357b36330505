import os
import tempfile

from conftest import rows
from repograph.operators import inventory as I
from repograph.operators import report as RP
from repograph.sources.files import read_checkouts


def test_read_checkouts(spark):
    root = tempfile.mkdtemp(prefix="repograph-co-", dir="/tmp")
    for repo, rel, data in [("r1", "a.py", b"import os\n"), ("r1", "pkg/b.js", b"x\ny"),
                            ("r2", "bin.dat", b"\xff\xfe\x00"), ("r2", "doc/readme.md", "é\n".encode()),
                            ("r2", "latin.py", "# caf\xe9\n".encode("latin-1"))]:
        p = os.path.join(root, repo, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)
    df = read_checkouts(spark, root)
    assert rows(df, "repo_id", "path", "content", "size_bytes", "loc", "decodable") == [
        ("r1", "a.py", "import os\n", 10, 1, True), ("r1", "pkg/b.js", "x\ny", 3, 1, True),
        ("r2", "bin.dat", None, 3, 0, False), ("r2", "doc/readme.md", "é\n", 3, 1, True),
        ("r2", "latin.py", None, 7, 1, False)]
    inv = I.file_inventory(df)
    assert rows(inv, "path", "loc", "size_bytes") == [
        ("a.py", 1, 10), ("bin.dat", 0, 3), ("doc/readme.md", 1, 3), ("latin.py", 1, 7), ("pkg/b.js", 1, 3)]
    files = I.file_ids(inv)
    refs = files.selectExpr("repo_id", "'file' as ref_kind", "file_id as ref_id")
    shown = RP.code_payload(refs, files, df, per_file_cap=100, total_cap=1000)
    assert rows(shown.where("path = 'latin.py'"), "content", "missing") == [("# caf\ufffd\n", False)]


def test_narrative_json_is_read_once(spark):
    from repograph.sources.narrative import read_narrative
    doc = ('{"schemaVersion": "1.0", "tiers": [{"level": 0, "name": "T"}], "relationships": [], "nodes": '
           '[{"id": "n1", "tier": 0, "factRefs": {"fileIds": ["f0001"]}}]}')
    t = read_narrative(spark.createDataFrame([("d", doc), ("bad", "{")], "doc_id string, json string"))
    assert [r["ref_id"] for r in t.node_refs.collect()] == ["f0001"]
    assert {r["doc_id"]: r["shape"] for r in t.documents.collect()} == {"d": "v1", "bad": "invalid"}
    for table in (t.nodes, t.node_refs, t.perspectives, t.brief_claims):
        assert "from_json" not in table._jdf.queryExecution().optimizedPlan().toString()


def test_payload_text_is_cut_before_the_join(spark):
    from repograph.operators.report import code_payload
    refs = spark.createDataFrame([("r", "p", 1, "n", "file", f, 1) for f in ("f1", "f2", "f3")],
                                 "repo_id string, perspective_id string, ord long, node_id string, ref_kind string, "
                                 "ref_id string, ref_pos long")
    files = spark.createDataFrame([("r", f"f{i}", f"{i}.py", "python") for i in (1, 2, 3)],
                                  "repo_id string, file_id string, path string, lang string")
    texts = spark.createDataFrame([("r", "1.py", "é" * 50), ("r", "2.py", "ab"), ("r", "3.py", None)],
                                  "repo_id string, path string, content string")
    out = code_payload(refs, files, texts, 5, 100)
    assert sorted(tuple(r) for r in out.select("file_id", "content", "truncated", "missing").collect()) == [
        ("f1", "éé", True, False), ("f2", "ab", False, False), ("f3", "", False, True)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan[:plan.index("> 5)")].count("Join ") >= 2
