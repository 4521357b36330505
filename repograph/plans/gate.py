"""The verification gate end to end: extracted facts + narrative documents ->
violations, coverage per perspective, total coverage, and status per narrative.

Narrative documents are ``docs(doc_id, repo_id, json)`` (v1 or v2 shape); each document
is checked against the facts of its ``repo_id``. Perspective scopes are qualified by the
document id (``doc::perspective``) so several narratives of one repository never mix.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.operators import verify as V
from repograph.plans.extract import Facts
from repograph.sources.narrative import read_narrative


SEP = "::"


@dataclass
class GateResult:
    violations: DataFrame
    coverage_by_perspective: DataFrame
    coverage_total: DataFrame
    status: DataFrame              # per narrative document: FAIL iff any error in it
    perspective_status: DataFrame  # per perspective of a document


def run_gate(facts: Facts, docs: DataFrame, present_paths: DataFrame | None = None,
             head_commits: DataFrame | None = None) -> GateResult:
    """``present_paths(repo_id, path)`` enables the file-existence check (the reference
    checks the checkout on disk); ``head_commits(repo_id, head_commit)`` the commit match."""
    t = read_narrative(docs)
    owner = docs.select("doc_id", "repo_id")

    def scoped(df: DataFrame) -> DataFrame:
        return (df.join(owner, "doc_id")
                .withColumn("perspective_id", F.concat_ws(SEP, "doc_id", "perspective_id")))

    persp, nodes = scoped(t.perspectives), scoped(t.nodes)
    refs, rels, rrefs = scoped(t.node_refs), scoped(t.relationships), scoped(t.rel_edge_refs)
    files, mf = facts.files, facts.module_files
    modules = mf.select("repo_id", "module_id").distinct()
    checks = [V.dup_perspective_ids(persp), V.dup_node_ids(nodes),
              V.orphan_file_refs(refs, files), V.orphan_module_refs(refs, modules),
              V.orphan_edge_refs(rrefs, facts.edges), V.relationship_endpoints(rels, nodes),
              V.empty_grounding(nodes, refs)]
    # the business brief: its scope is the document
    def of_doc(df: DataFrame) -> DataFrame:
        return df.join(owner, "doc_id").withColumnRenamed("doc_id", "brief_id")

    claims = of_doc(t.brief_claims).withColumn("perspective_ref", F.when(
        F.col("perspective_ref").isNotNull(), F.concat_ws(SEP, "brief_id", "perspective_ref")))
    brefs = of_doc(t.brief_refs)
    checks += [V.headline_warning(of_doc(t.briefs)), V.brief_grounding(claims, brefs),
               V.brief_orphan_refs(brefs, files, modules), V.capability_refs(claims, persp, nodes),
               V.techstack_refs(of_doc(t.tech_stack), facts.deps, scope="brief_id")]
    if present_paths is not None:
        checks += [V.file_existence(refs, files, present_paths),
                   V.brief_file_existence(brefs, files, present_paths)]
    if head_commits is not None:
        narr = t.documents.join(owner, "doc_id").select(
            "repo_id", F.col("doc_id").alias("narrative_id"), "based_on_facts_commit")
        checks.append(V.commit_match(narr, head_commits))
    violations = V.union_all(checks)
    covered = V.coverage_bitmaps(refs, mf, files)
    by_p = V.coverage_by_perspective(persp, nodes, covered, files)
    total = V.coverage_total(files.select("repo_id").distinct(), nodes, covered, files,
                             facts.edges)
    per_p = V.gate_status(persp.select("repo_id", F.col("perspective_id").alias("scope")),
                          violations)
    by_doc = violations.withColumn("scope", F.substring_index("scope", SEP, 1))
    status = V.gate_status(docs.select("repo_id", F.col("doc_id").alias("scope")), by_doc)
    return GateResult(violations, by_p, total, status, per_p)
