import json

from conftest import files_df, rows
from fixtures import PY_APP
from repograph.plans.extract import Facts
from repograph.plans.gate import run_gate


def test_extract_then_verify(spark):
    facts = Facts(files_df(spark, {"r": PY_APP}))
    ids = {r.path: r.file_id for r in facts.files.collect()}
    edge = facts.edges.where("to_id is not null").first().edge_id
    doc = {"schemaVersion": "1.0", "basedOnFactsCommit": None, "openQuestions": [],
           "tiers": [{"level": 0, "name": "Top"}],
           "nodes": [
               {"id": "core", "tier": 0, "label": "Core", "description": "d",
                "factRefs": {"fileIds": [ids["pkg/core.py"]], "moduleIds": []},
                "children": [], "confidence": "high", "interpretation": False},
               {"id": "ghost", "tier": 0, "label": "Ghost", "description": "",
                "factRefs": {"fileIds": ["f9999"]}, "children": [], "confidence": "low",
                "interpretation": True},
               {"id": "idea", "tier": 1, "label": "Idea", "description": "a guess",
                "factRefs": {}, "children": [], "confidence": "low", "interpretation": True}],
           "relationships": [{"from": "core", "to": "ghost", "label": "uses",
                              "factEdgeIds": [edge, "e9999"], "confidence": "high"}]}
    docs = spark.createDataFrame([("n1", "r", json.dumps(doc))], "doc_id string, repo_id string, json string")
    g = run_gate(facts, docs)
    assert rows(g.violations, "check", "ref") == [("referential-integrity", "e9999"),
                                                 ("referential-integrity", "f9999")]
    assert rows(g.status, "scope", "n_errors", "status") == [("n1", 2, "FAIL")]
    assert rows(g.perspective_status, "scope", "status") == [("n1::default", "FAIL")]
    c = g.coverage_by_perspective.first()
    assert (c.node_count, c.files_covered) == (3, 1)


def test_a_broken_brief_fails_the_gate(spark):
    facts = Facts(files_df(spark, {"r": {**PY_APP, "requirements.txt": "flask==1.0\n"}}))
    fid = facts.files.where("path = 'pkg/core.py'").first().file_id

    def claim(**kw):
        return {"text": "t", "factRefs": {"fileIds": [fid]}, "confidence": "high", "interpretation": False, **kw}

    def doc(brief):
        return json.dumps({"schemaVersion": "2.0", "basedOnFactsCommit": None, "openQuestions": [],
                           "perspectives": [{"id": "p", "name": "P", "kind": "structural", "tiers": [], "nodes": [],
                                             "relationships": []}], "businessBrief": brief})
    good = {"headline": "h", "problem": claim(), "solution": claim(),
            "capabilities": [claim(label="c", perspectiveRef="p")],
            "techStack": [{"name": "Flask", "role": "web", "factRef": "flask"}]}
    bad = {"headline": "", "problem": claim(factRefs={}), "solution": claim(factRefs={"fileIds": ["f9999"],
                                                                                     "moduleIds": ["m999"]}),
           "capabilities": [claim(label="c", perspectiveRef="none"), claim(label="d", nodeRef="x"),
                            claim(label="e", perspectiveRef="p", nodeRef="x")],
           "techStack": [{"name": "N", "role": "r", "factRef": "nope"}]}
    docs = spark.createDataFrame([("good", "r", doc(good)), ("bad", "r", doc(bad)),
                                  ("empty", "r", json.dumps({"perspectives": []}))],
                                 "doc_id string, repo_id string, json string")
    g = run_gate(facts, docs)
    assert rows(g.status, "scope", "n_errors", "n_warnings", "status") == [
        ("bad", 7, 1, "FAIL"), ("empty", 0, 0, "PASS"), ("good", 0, 0, "PASS")]
    assert rows(g.violations, "check") == sorted([
        ("capability-ref",), ("capability-ref",), ("capability-ref",), ("empty-grounding",), ("headline",),
        ("referential-integrity",), ("referential-integrity",), ("techstack-ref",)])
    assert rows(g.perspective_status, "scope") == [("bad::p",), ("good::p",)]
