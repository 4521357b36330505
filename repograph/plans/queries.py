"""Registered queries: one per operator key of the inventory, bound to a test corpus.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole tables.
Computed columns carry the same names as the matching oracle SQL.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.functions import text as T
from repograph.operators import history as H
from repograph.operators import inventory as I
from repograph.operators.reachability import entry_reachability
from repograph.plans import corpus as C
from repograph.plans.extract import Facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn):
        QUERIES[key] = fn
        return fn
    return deco


_FACTS: dict[tuple, Facts] = {}


def _facts(spark: SparkSession, kind: str, sf_dir: str, repos, **kw) -> Facts:
    """One ``Facts`` for each session, corpus and option: queries share its stored tables."""
    key = (spark.sparkContext.applicationId, kind, sf_dir, *sorted(kw.items()))
    if key not in _FACTS:
        d = repos(spark, sf_dir)
        _FACTS[key] = Facts(d.files, lambda: d.commits, **kw)
    return _FACTS[key]


def forget_facts() -> None:
    """Let the next queries extract their facts anew (for measurements)."""
    _FACTS.clear()


def facts_d(spark: SparkSession, sf_dir: str, **kw) -> Facts:
    return _facts(spark, "d", sf_dir, C.corpus_d, **kw)


# ------------------------------------------------------------------ history
@query("cochange_pairs")
def q_cochange_pairs(spark, sf_dir):
    return facts_d(spark, sf_dir).coupling.select("repo_id", "a", "b", "co_change_count")


@query("churn")
def q_churn(spark, sf_dir):
    return facts_d(spark, sf_dir).churn.select("repo_id", "file_id", "churn")


@query("last_modified")
def q_last_modified(spark, sf_dir):
    return facts_d(spark, sf_dir).last_modified.select("repo_id", "file_id", "last_modified")


@query("apply_git_signals")
def q_apply_git_signals(spark, sf_dir):
    return facts_d(spark, sf_dir).files_with_signals.select(
        "repo_id", "file_id", "path", "churn", "last_modified")


@query("indexed_only")
def q_indexed_only(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    py_files = f.files.where(F.col("path").endswith(".py"))
    return H.indexed_only(f.commits_raw, py_files).select(
        "repo_id", "commit_id", "seq", "committed_at", "file_id")


@query("module_coupling")
def q_module_coupling(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return H.module_coupling(f.touches, f.module_files).select(
        "repo_id", "a", "b", "co_change_count")


# ------------------------------------------------------------------ inventory
@query("file_inventory")
def q_file_inventory(spark, sf_dir):
    return facts_d(spark, sf_dir).inventory.select("repo_id", "path", "lang", "loc",
                                                   "size_bytes")


@query("line_count")
def q_line_count(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.line_count("text").alias("loc"),
                       T.byte_size("text").alias("size_bytes"))


def with_junk_paths(files: DataFrame) -> DataFrame:
    """D plus copies under skipped segments (build/, dist/, node_modules, a file named
    __pycache__) that the inventory must drop."""
    k = F.regexp_extract("path", r"m(\d+)\.", 1).try_cast("bigint")
    junk = files.where(k % 7 == 0)
    return (files
            .unionByName(junk.withColumn("path", F.concat(F.lit("build/"), "path")))
            .unionByName(junk.withColumn("path", F.regexp_replace("path", "/m", "/dist/m")))
            .unionByName(junk.withColumn("path", F.concat("path", F.lit("/node_modules/x.js"))))
            .unionByName(junk.withColumn("path", F.regexp_replace("path", r"m\d+\.\w+$",
                                                                  "__pycache__"))))


@query("skip_segments")
def q_skip_segments(spark, sf_dir):
    d = C.corpus_d(spark, sf_dir)
    return I.skip_segments(with_junk_paths(d.files)).select("repo_id", "path")


GITIGNORE_D = "# generated rules\n*.md\n!pkg_promo/**/*.md\n\nsrc/pkg_small/\n"


def with_gitignore(files: DataFrame) -> DataFrame:
    ign = files.select("repo_id").distinct().select(
        "repo_id", F.lit(".gitignore").alias("path"), F.lit(GITIGNORE_D).alias("content"))
    return files.unionByName(ign)


@query("ignore_rules")
def q_ignore_rules(spark, sf_dir):
    d = C.corpus_d(spark, sf_dir)
    raw = with_gitignore(d.files)
    return I.ignore_rules(raw, I.gitignore_rules(raw)).select("repo_id", "path")


@query("detect_language")
def q_detect_language(spark, sf_dir):
    d = C.corpus_d(spark, sf_dir)
    return d.files.select("repo_id", "path", T.detect_language("path").alias("lang"))


@query("file_ids")
def q_file_ids(spark, sf_dir):
    return facts_d(spark, sf_dir).files.select("repo_id", "file_id", "path")


@query("module_rollup")
def q_module_rollup(spark, sf_dir):
    return facts_d(spark, sf_dir).module_files.select("repo_id", "module_id", "module_path",
                                                      "file_id")


@query("module_ids")
def q_module_ids(spark, sf_dir):
    return I.module_summary(facts_d(spark, sf_dir).module_files)


@query("repo_totals")
def q_repo_totals(spark, sf_dir):
    return facts_d(spark, sf_dir).totals.select("repo_id", "total_files", "total_loc")


@query("languages_detected")
def q_languages_detected(spark, sf_dir):
    return facts_d(spark, sf_dir).languages.select(
        "repo_id", F.array_join("languages", ",").alias("languages"))


@query("focus_subtree")
def q_focus_subtree(spark, sf_dir):
    f = facts_d(spark, sf_dir, focus="src")
    return f.module_files.join(f.files.select("repo_id", "file_id", "path"),
                               ["repo_id", "file_id"]).select(
        "repo_id", "file_id", "path", "module_id")


@query("scan_eligible")
def q_scan_eligible(spark, sf_dir):
    return I.scan_eligible(facts_d(spark, sf_dir).files).select("repo_id", "path", "family")


# ------------------------------------------------------------------ imports
from repograph.operators import imports as M  # noqa: E402
from repograph.operators import graph as G  # noqa: E402
from repograph.operators import resolve as R  # noqa: E402


@query("explode_lines")
def q_explode_lines(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    return M.explode_lines(docs, "text", ("doc_id",)).select("doc_id", "line_no", "text")


def _with_file_ids(f: Facts, items: DataFrame) -> DataFrame:
    """Scanned rows with the id of their file. The rows, many times the files, are dealt into
    partitions that grow in number with the stored text, so a task's sort does not."""
    return C.spread(items, f.raw_files, "repo_id", "path").join(
        f.files.select("repo_id", "path", "file_id"), ["repo_id", "path"])


def _raw_out(f: Facts, df: DataFrame) -> DataFrame:
    return _with_file_ids(f, df).select(
        "repo_id", "file_id", F.col("line").cast("bigint").alias("line"), "raw",
        F.col("level").cast("bigint").alias("level"), "module")


#: Source forms on which the statement scan and the line scan differ, appended to the parts
#: whose key is a multiple of 23: a docstring, one-line blocks and a multi-line import; a regex
#: literal with quotes, a comment and a multi-line import.
PY_FORMS = """\"\"\"
import fake_doc
\"\"\"
try: import ext_one
except ImportError: import ext_two
from os import (
    path)
"""
JS_FORMS = """const re = /[`'"/*]+/g;
/*
import no from 'no';
*/
import {
  a
} from 'multi';
"""


def _with_forms(contents: DataFrame) -> DataFrame:
    k = F.regexp_extract("path", r"/m(\d+)\.(?:py|js|ts)$", 1).try_cast("bigint")
    forms = F.when(F.col("path").endswith(".py"), F.lit(PY_FORMS)).otherwise(F.lit(JS_FORMS))
    return contents.withColumn("content", F.when(k % 23 == 0, F.concat("content", forms))
                               .otherwise(F.col("content")))


@query("python_imports_line")
def q_python_imports_line(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return _raw_out(f, M.python_imports_line(_with_forms(f.contents)))


@query("js_imports_line")
def q_js_imports_line(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return _raw_out(f, M.js_imports_line(_with_forms(f.contents)))


@query("python_imports_stmt")
def q_python_imports_stmt(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return _raw_out(f, M.python_imports_stmt(_with_forms(f.contents)))


@query("js_imports_stmt")
def q_js_imports_stmt(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return _raw_out(f, M.js_imports_stmt(_with_forms(f.contents)))


@query("merge_edges")
def q_merge_edges(spark, sf_dir):
    """Statement edges for files of even part key only; the rest falls back to lines."""
    f = facts_d(spark, sf_dir)
    k = F.regexp_extract("path", r"/m(\d+)\.[a-z]+$", 1).try_cast("bigint")
    scanned = M.scanned_files(f.contents).withColumn(
        "s", F.when(k % 2 == 0, F.col("s")).otherwise(F.filter("s", lambda _: F.lit(False))))
    return _with_file_ids(f, M.merge_edges(scanned)).select(
        "repo_id", "file_id", F.col("line").cast("bigint").alias("line"), "raw", "module", "extractor")


@query("package_roots")
def q_package_roots(spark, sf_dir):
    return facts_d(spark, sf_dir).roots.select(
        "repo_id", "name", F.array_join("prefixes", ",").alias("prefixes"))


def _edge_out(df: DataFrame) -> DataFrame:
    return df.select("repo_id", F.col("from_id"), "line", "module", "to_id", "resolution")


@query("resolve_python_absolute")
def q_resolve_python_absolute(spark, sf_dir):
    e = facts_d(spark, sf_dir).edges
    return _edge_out(e.where((F.col("lang") == "python") & (F.col("level") == 0)))


@query("resolve_python_srclayout")
def q_resolve_python_srclayout(spark, sf_dir):
    e = facts_d(spark, sf_dir).edges
    return _edge_out(e.where((F.col("lang") == "python") & (F.col("level") == 0)
                             & (F.col("hit_priority") >= 2)))


@query("resolve_python_relative")
def q_resolve_python_relative(spark, sf_dir):
    e = facts_d(spark, sf_dir).edges
    return _edge_out(e.where((F.col("lang") == "python") & (F.col("level") > 0)))


@query("resolve_js")
def q_resolve_js(spark, sf_dir):
    return _edge_out(facts_d(spark, sf_dir).edges.where(F.col("lang") == "js"))


@query("normalize_path")
def q_normalize_path(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages")
    p = pages.select("page_id", F.concat(
        F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1),
        F.lit("/../x/./y/../../z//w")).alias("raw_path"))
    return p.select("page_id", "raw_path", T.normalize_path("raw_path").alias("norm_path"))


@query("edge_ids")
def q_edge_ids(spark, sf_dir):
    return facts_d(spark, sf_dir).edges.select(
        "repo_id", "edge_id", "type", "from_id", "to_id", "file", "line", "raw",
        "resolution", "extractor")


@query("resolution_counts")
def q_resolution_counts(spark, sf_dir):
    return G.resolution_counts(facts_d(spark, sf_dir).edges)


@query("extraction_report")
def q_extraction_report(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    r = G.extraction_report(f.files, f.edges)
    return r.select("repo_id", F.array_join("languages", ",").alias("languages"),
                    "edges_resolved", "edges_unresolved",
                    F.array_join("tools", ",").alias("tools"),
                    F.array_join("skipped", ",").alias("skipped"),
                    F.array_join("warnings", ",").alias("warnings"))


@query("mutual_imports")
def q_mutual_imports(spark, sf_dir):
    return G.mutual_imports(facts_d(spark, sf_dir).edges)


@query("fan_in_out")
def q_fan_in_out(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return G.fan_in_out(f.files, f.edges)


@query("module_dependencies")
def q_module_dependencies(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return G.module_dependencies(f.edges, f.module_files)


# ------------------------------------------------------------------ manifests, entrypoints
from repograph.operators import entrypoints as EP  # noqa: E402
from repograph.operators import build_files as BF  # noqa: E402
from repograph.operators import manifests as MF  # noqa: E402
from repograph.operators import report as RP  # noqa: E402


def facts_dm(spark: SparkSession, sf_dir: str, **kw) -> Facts:
    return _facts(spark, "dm", sf_dir, C.corpus_dm, **kw)


DEP_OUT = ["repo_id", "name", "version", "ecosystem", "manifest"]


@query("manifest_rows")
def q_manifest_rows(spark, sf_dir):
    d = C.corpus_dm(spark, sf_dir)
    nested = d.files.where(F.col("path") == "package.json").withColumn(
        "path", F.lit("web/package.json"))
    return MF.manifest_rows(d.files.unionByName(nested)).select("repo_id", "path")


@query("requirement_token")
def q_requirement_token(spark, sf_dir):
    return MF.requirements_deps(C.corpus_dm(spark, sf_dir).files).select(
        "repo_id", "name", "version")


@query("requirements_deps")
def q_requirements_deps(spark, sf_dir):
    return MF.requirements_deps(C.corpus_dm(spark, sf_dir).files).select(*DEP_OUT)


@query("npm_deps")
def q_npm_deps(spark, sf_dir):
    return MF.npm_deps(C.corpus_dm(spark, sf_dir).files).select(*DEP_OUT)


@query("pep621_deps")
def q_pep621_deps(spark, sf_dir):
    return MF.pep621_deps(C.corpus_dm(spark, sf_dir).files).select(*DEP_OUT)


@query("poetry_deps")
def q_poetry_deps(spark, sf_dir):
    return MF.poetry_deps(C.corpus_dm(spark, sf_dir).files).select(*DEP_OUT)


@query("merge_deps")
def q_merge_deps(spark, sf_dir):
    return MF.merge_deps(C.corpus_dm(spark, sf_dir).files).select(
        *DEP_OUT, F.col("dep_ord").cast("bigint").alias("dep_ord"))


ENTRY_OUT = ["repo_id", "file_id", "kind", "evidence"]


@query("node_start_entry")
def q_node_start_entry(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    return MF.node_entrypoints(f.raw_files, f.files).where(F.col("ord") == 0).select(*ENTRY_OUT)


@query("node_main_entry")
def q_node_main_entry(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    return MF.node_entrypoints(f.raw_files, f.files).where(F.col("ord") == 1).select(*ENTRY_OUT)


@query("pyproject_script_entry")
def q_pyproject_script_entry(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    e = MF.script_entrypoints(f.raw_files, f.files)
    return e.where(F.col("evidence").startswith("pyproject [project.scripts]")).select(*ENTRY_OUT)


@query("poetry_script_entry")
def q_poetry_script_entry(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    e = MF.script_entrypoints(f.raw_files, f.files)
    return e.where(F.col("evidence").startswith("pyproject [tool.poetry")).select(*ENTRY_OUT)


@query("script_entry_join")
def q_script_entry_join(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    vals = MF.script_values(MF.toml_rows(f.raw_files))
    return R.module_to_file(vals, f.files, "module", ["repo_id", "ord3"]).select(
        "repo_id", "module", "target_id")


@query("web_entrypoints")
def q_web_entrypoints(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return EP.web_entrypoints(f.contents).join(
        f.files.select("repo_id", "path", "file_id"), ["repo_id", "path"]).select(*ENTRY_OUT)


@query("merge_entrypoints")
def q_merge_entrypoints(spark, sf_dir):
    return facts_dm(spark, sf_dir).entrypoints.select(*ENTRY_OUT)


@query("dependency_usage")
def q_dependency_usage(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    return RP.dependency_usage(f.edges, MF.merge_deps(f.raw_files)).select(
        "repo_id", "name", "file_id")


@query("dep_lookup")
def q_dep_lookup(spark, sf_dir):
    d = C.corpus_dm(spark, sf_dir)
    return RP.dep_lookup(C.tech_stack(spark, sf_dir), MF.merge_deps(d.files)).select(
        "repo_id", "ord", "tech_name", "role", "fact_ref", "version")


@query("tech_by_role")
def q_tech_by_role(spark, sf_dir):
    return RP.tech_by_role(C.tech_stack(spark, sf_dir)).select(
        "repo_id", "role", "role_ord", "n_items",
        F.array_join(F.transform("items", lambda x: x["tech_name"]), "|").alias("items"))


@query("stat_tiles")
def q_stat_tiles(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    return RP.stat_tiles(f.files, f.module_files, f.entrypoints, f.deps)


# ------------------------------------------------------------------ narrative gate (N)
from repograph.operators import verify as V  # noqa: E402

VCOLS = V.VIOLATION_COLS


def _n(spark, sf_dir):
    return C.corpus_n(spark, sf_dir), C.n_facts(spark, sf_dir)


@query("dup_perspective_ids")
def q_dup_perspective_ids(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    extra = n.perspectives.where(F.col("perspective_id") == "3-MEDIUM").withColumn(
        "ord", F.lit(6))
    return V.dup_perspective_ids(n.perspectives.unionByName(extra)).select(*VCOLS)


@query("dup_node_ids")
def q_dup_node_ids(spark, sf_dir):
    return V.dup_node_ids(_n(spark, sf_dir)[0].nodes).select(*VCOLS)


@query("orphan_file_refs")
def q_orphan_file_refs(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return V.orphan_file_refs(n.node_refs, f.files).select(*VCOLS)


@query("orphan_module_refs")
def q_orphan_module_refs(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return V.orphan_module_refs(n.node_refs, f.modules).select(*VCOLS)


@query("orphan_edge_refs")
def q_orphan_edge_refs(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return V.orphan_edge_refs(n.rel_edge_refs, f.edges).select(*VCOLS)


@query("relationship_endpoints")
def q_relationship_endpoints(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return V.relationship_endpoints(n.relationships, n.nodes).select(*VCOLS)


@query("empty_grounding")
def q_empty_grounding(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return V.empty_grounding(n.nodes, n.node_refs).select(*VCOLS)


@query("file_existence")
def q_file_existence(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return V.file_existence(n.node_refs, f.files, f.present).select(*VCOLS)


@query("covered_files")
def q_covered_files(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return V.covered_files(n.node_refs, f.module_files, f.files).select(
        "repo_id", "perspective_id", "file_id")


@query("coverage_by_perspective")
def q_coverage_by_perspective(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    cov = V.coverage_bitmaps(n.node_refs, f.module_files, f.files)
    return V.coverage_by_perspective(n.perspectives, n.nodes, cov, f.files)


@query("coverage_total")
def q_coverage_total(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    cov = V.coverage_bitmaps(n.node_refs, f.module_files, f.files)
    return V.coverage_total(f.repos, n.nodes, cov, f.files, f.edges)


@query("commit_match")
def q_commit_match(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return V.commit_match(n.narratives, f.repos).select(*VCOLS)


@query("brief_grounding")
def q_brief_grounding(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return V.brief_grounding(n.brief_claims, n.brief_refs).select(*VCOLS)


@query("brief_orphan_refs")
def q_brief_orphan_refs(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return V.brief_orphan_refs(n.brief_refs, f.files, f.modules).select(*VCOLS)


@query("brief_file_existence")
def q_brief_file_existence(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return V.brief_file_existence(n.brief_refs, f.files, f.present).select(*VCOLS)


@query("capability_refs")
def q_capability_refs(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return V.capability_refs(n.brief_claims, n.perspectives, n.nodes).select(*VCOLS)


@query("techstack_refs")
def q_techstack_refs(spark, sf_dir):
    d = C.corpus_dm(spark, sf_dir)
    return V.techstack_refs(C.tech_stack(spark, sf_dir), MF.merge_deps(d.files)).select(*VCOLS)


@query("headline_warning")
def q_headline_warning(spark, sf_dir):
    return V.headline_warning(_n(spark, sf_dir)[0].briefs).select(*VCOLS)


def gate_violations(n, f) -> DataFrame:
    return V.union_all([
        V.dup_perspective_ids(n.perspectives), V.dup_node_ids(n.nodes),
        V.orphan_file_refs(n.node_refs, f.files), V.orphan_module_refs(n.node_refs, f.modules),
        V.orphan_edge_refs(n.rel_edge_refs, f.edges),
        V.relationship_endpoints(n.relationships, n.nodes),
        V.empty_grounding(n.nodes, n.node_refs),
        V.file_existence(n.node_refs, f.files, f.present),
        V.brief_grounding(n.brief_claims, n.brief_refs),
        V.brief_orphan_refs(n.brief_refs, f.files, f.modules),
        V.brief_file_existence(n.brief_refs, f.files, f.present),
        V.capability_refs(n.brief_claims, n.perspectives, n.nodes),
        V.headline_warning(n.briefs), V.commit_match(n.narratives, f.repos)])


@query("gate_status")
def q_gate_status(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    scopes = n.perspectives.select("repo_id", F.col("perspective_id").alias("scope"))
    return V.gate_status(scopes, gate_violations(n, f))


@query("dangling_children")
def q_dangling_children(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return V.dangling_children(n.node_children, n.nodes).select(*VCOLS)


@query("ungrounded_relationships")
def q_ungrounded_relationships(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return V.ungrounded_relationships(n.relationships, n.rel_edge_refs).select(*VCOLS)


@query("tier_sizing")
def q_tier_sizing(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return V.tier_sizing(n.nodes, n.node_refs).select(*VCOLS)


# ------------------------------------------------------------------ report queries
NODE_KEY = ["repo_id", "perspective_id", "ord", "node_id"]


def _n_contents(spark, sf_dir) -> DataFrame:
    """D file text re-keyed to the narrative's repo; parts whose key is a multiple of 3
    are absent (missing)."""
    k = F.regexp_extract("path", r"/m(\d+)\.[a-z]+$", 1).try_cast("bigint")
    d = C.corpus_d(spark, sf_dir).files
    return d.where(k.isNotNull() & (k % 3 != 0)).select(F.lit(C.N_REPO).alias("repo_id"),
                                                          "path", "content")


@query("referenced_files")
def q_referenced_files(spark, sf_dir):
    return RP.referenced_files(_n(spark, sf_dir)[0].node_refs)


@query("code_truncate")
def q_code_truncate(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    cut = T.utf8_truncate("text", 500)
    trunc = F.octet_length("text") > 500
    return docs.select("doc_id", trunc.alias("truncated"),
                       F.when(trunc, cut).otherwise(F.col("text")).alias("text"))


@query("code_budget")
def q_code_budget(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    sized = (RP.referenced_files(n.node_refs).join(f.files, ["repo_id", "file_id"])
             .join(_n_contents(spark, sf_dir).select(
                 "repo_id", "path", F.octet_length("content").cast("bigint").alias("n")), ["repo_id", "path"])
             .select("repo_id", "file_id", "n"))
    return RP.code_budget(sized, 20_000).select("repo_id", "file_id", "n", "dropped")


@query("code_payload")
def q_code_payload(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    p = RP.code_payload(n.node_refs, f.files, _n_contents(spark, sf_dir), 120, 20_000)
    return p.select("repo_id", "file_id", "path", "lang",
                    F.octet_length("content").cast("bigint").alias("n_bytes"),
                    "truncated", "dropped", "missing")


@query("tier0_nodes")
def q_tier0_nodes(spark, sf_dir):
    return RP.tier0_nodes(_n(spark, sf_dir)[0].nodes).select(*NODE_KEY)


@query("children_of")
def q_children_of(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return RP.children_of(n.node_children, n.nodes).select(
        "repo_id", "perspective_id", "node_id", "pos", "child_id")


@query("verified_only")
def q_verified_only(spark, sf_dir):
    return RP.verified_only(_n(spark, sf_dir)[0].nodes).select(*NODE_KEY)


@query("visible_subgraph")
def q_visible_subgraph(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    nodes, rels = RP.visible_subgraph(n.nodes, n.relationships)
    key = ["repo_id", "perspective_id"]
    return nodes.select(*key, F.lit("node").alias("kind"), "ord", F.col("node_id").alias("from_id"),
                        F.lit(None).cast("string").alias("to_id")).unionByName(
        rels.select(*key, F.lit("relationship").alias("kind"), "ord", "from_id", "to_id"))


@query("node_relations")
def q_node_relations(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return RP.node_relations(n.relationships, n.nodes).select(
        "repo_id", "perspective_id", "ord", "node_id", "direction", "other_id", "other_label")


@query("node_provenance")
def q_node_provenance(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    p = RP.node_provenance(n.node_refs, f.files, f.modules)
    return p.select(*NODE_KEY, F.array_join("file_paths", "|").alias("file_paths"),
                    F.array_join("module_paths", "|").alias("module_paths"))


@query("node_context")
def q_node_context(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return RP.node_context(n.perspectives, n.nodes, n.node_refs, n.relationships, n.rel_edge_refs,
                           f.files, f.modules)


@query("brief_context")
def q_brief_context(spark, sf_dir):
    n, f = _n(spark, sf_dir)
    return RP.brief_context(n.brief_claims, n.brief_refs, f.files, f.modules)


@query("coverage_banner")
def q_coverage_banner(spark, sf_dir):
    f = facts_d(spark, sf_dir)
    return RP.coverage_banner(G.extraction_report(f.files, f.edges))


@query("capability_cards")
def q_capability_cards(spark, sf_dir):
    return RP.capability_cards(_n(spark, sf_dir)[0].brief_claims)


@query("leaf_nodes")
def q_leaf_nodes(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return RP.leaf_nodes(n.nodes, n.node_children).select(*NODE_KEY)


@query("escape_inline_json")
def q_escape_inline_json(spark, sf_dir):
    pages = C.table(spark, sf_dir, "pages")
    esc = RP.escape_inline_json(F.struct("html"))
    back = F.from_json(esc, "html string")["html"]
    n_breaks = ((F.length("html") - F.length(F.replace(F.col("html"), F.lit("</"), F.lit(""))))
                / 2).cast("bigint")
    return pages.select("page_id", n_breaks.alias("n_breaks"),
                        (~esc.contains("</")).alias("safe"), (back == F.col("html")).alias("roundtrip"))


@query("hover_counts")
def q_hover_counts(spark, sf_dir):
    n, _ = _n(spark, sf_dir)
    return RP.hover_counts(n.nodes, n.node_refs, n.relationships)


# ------------------------------------------------------------------ sources and sinks
from repograph.session import ensure_checkpoint_dir  # noqa: E402
from repograph.sources import gitlog as GL  # noqa: E402
from repograph.sources import narrative as NR  # noqa: E402
from repograph.sources import sinks as SK  # noqa: E402


def d_log_chunks(spark, sf_dir) -> DataFrame:
    """D's history exported as log text, in chunks of 500 commits, newest first."""
    t = C.d_touches(spark, sf_dir).join(C.d_parts(spark, sf_dir).select("partkey", "path"),
                                         "partkey")
    commits = t.select("repo_id", F.concat(F.lit("c"), "commit_id").alias("commit_hash"),
                       F.date_format("committed_ts", C.ISO_FORMAT).alias("committed_at"),
                       F.unix_timestamp(F.col("committed_ts").cast("timestamp")).alias("sort_ts"),
                       F.col("commit_id").alias("tiebreak"),
                       "path")
    return GL.log_chunks_from_commits(commits)


@query("commit_log_rows")
def q_commit_log_rows(spark, sf_dir):
    rows = GL.commit_log_rows(d_log_chunks(spark, sf_dir))
    return rows.select("repo_id", "commit_hash", "seq", "committed_at", "path")


@query("commit_log_export")
def q_commit_log_export(spark, sf_dir):
    """The same history from exported files, split between tasks at record separators."""
    root = ensure_checkpoint_dir(spark).rstrip("/") + f"/log-{uuid.uuid4().hex}"
    GL.write_log_exports(d_log_chunks(spark, sf_dir), root)
    return GL.read_log_exports(spark, root).select("repo_id", "commit_hash", "seq", "committed_at", "path")


def _n_docs(spark, sf_dir) -> DataFrame:
    """The serialized narrative documents - stored input, materialised once."""
    return C.materialize(spark, ("n_docs", sf_dir), lambda: C.n_documents(spark, sf_dir))


@query("read_narrative")
def q_read_narrative(spark, sf_dir):
    """Every parsed row by value: (doc_id, kind, ord, pos, value)."""
    t = NR.read_narrative(_n_docs(spark, sf_dir))
    none = F.lit(0)

    def rows(df: DataFrame, kind, ord_, pos, *values) -> DataFrame:
        text = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])
        return df.select("doc_id", kind.alias("kind"), ord_.cast("bigint").alias("ord"),
                         pos.cast("bigint").alias("pos"), text.alias("value"))

    ref_kind = F.concat(F.col("ref_kind"), F.lit("_ref"))
    parts = [
        rows(t.nodes, F.lit("node"), F.col("ord"), none, "node_id", "label", "description", "tier",
             "confidence", "interpretation"),
        rows(t.node_refs, ref_kind, F.col("ord"), F.col("ref_pos"), "ref_id"),
        rows(t.node_children, F.lit("child"), none, F.col("pos"), "node_id", "child_id"),
        rows(t.relationships, F.lit("relationship"), F.col("ord"), none, "from_id", "to_id", "confidence"),
        rows(t.rel_edge_refs, F.lit("edge_ref"), F.col("ord"), F.col("ref_pos"), "edge_id"),
        rows(t.tiers, F.lit("tier"), F.col("ord"), none, "level", "name"),
        rows(t.briefs, F.lit("brief"), none, none, "headline"),
        rows(t.brief_claims, F.col("claim_kind"), F.col("ord"), none, "label", "text", "confidence",
             "interpretation", "perspective_ref", "node_ref"),
        rows(t.brief_refs, F.concat(F.lit("claim_"), ref_kind), F.col("ord"), F.col("ref_pos"), "ref_id"),
        rows(t.tech_stack, F.lit("tech"), F.col("ord"), none, "tech_name", "role", "fact_ref"),
        rows(t.open_questions, F.lit("question"), F.col("ord"), none, "question")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("normalize_perspectives")
def q_normalize_perspectives(spark, sf_dir):
    t = NR.read_narrative(_n_docs(spark, sf_dir), once=False)
    return t.perspectives.join(t.documents, "doc_id").select(
        "doc_id", F.col("ord").cast("bigint").alias("ord"), "perspective_id", "name", "kind",
        "shape")


#: Sections whose records the oracle rebuilds and compares by value.
VALUE_SECTIONS = ("repo", "modules", "edges", "gitCoupling")


def _facts_by_value(records: DataFrame) -> DataFrame:
    """Records of each section and the sum of their hashed JSON texts."""
    part = F.conv(F.substring(F.md5("json"), 1, 8), 16, 10).cast("bigint")
    return records.groupBy("repo_id", "section").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.sum(F.when(F.col("section").isin(*VALUE_SECTIONS), part)).alias("digest"),
        F.count_if(F.get_json_object("json", "$").isNotNull()).alias("n_parsed"))


def _dm_records(spark, sf_dir) -> DataFrame:
    f = facts_dm(spark, sf_dir)
    repos = f.totals.select("repo_id", F.concat(F.lit("/src/"), "repo_id").alias("root"),
                            F.concat(F.lit("head-"), "repo_id").alias("head_commit"),
                            F.lit("main").alias("branch"))
    return SK.facts_records(f, repos=repos, generated_at="2024-01-01T00:00:00+00:00")


@query("facts_document")
def q_facts_document(spark, sf_dir):
    return _facts_by_value(_dm_records(spark, sf_dir))


@query("write_facts")
def q_write_facts(spark, sf_dir):
    path = ensure_checkpoint_dir(spark).rstrip("/") + f"/facts-{uuid.uuid4().hex}"
    SK.write_facts(_dm_records(spark, sf_dir), path)
    return _facts_by_value(SK.read_facts(spark, path))


# ------------------------------------------------------------------ schema rules
from repograph.operators import constraints as K  # noqa: E402


def _inject(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Append a few deliberately broken rows (nullable copy of the schema)."""
    from pyspark.sql import types as Ty
    schema = Ty.StructType([Ty.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return df.unionByName(df.sparkSession.createDataFrame(rows, schema=schema))


@query("facts_constraints")
def q_facts_constraints(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    files = _inject(f.files_with_signals.select("repo_id", "file_id", "path", "lang", "loc",
                                                "size_bytes", "churn", "last_modified"),
                    [("repo0", "x0001", "bad.py", "python", -1, 3, 0, None)])
    edges = _inject(f.edges.select("repo_id", "edge_id", "type", "from_id", "to_id", "file",
                                   "line", "raw", "resolution", "extractor"),
                    [("repo0", "E1", "call", "f0001", None, "a.py", -2, "", "maybe", "magic")])
    ents = _inject(f.entrypoints.select("repo_id", "file_id", "kind", "evidence"),
                   [("repo0", "f0001", "daemon", "x")])
    cpl = _inject(f.coupling.select("repo_id", "a", "b", "co_change_count"),
                  [("repo0", "f0001", None, -1)])
    repos = _inject(f.totals.select("repo_id", F.col("repo_id").alias("root"), "total_files", "total_loc",
                                    F.lit("2024-01-01").alias("generated_at")),
                    [("repo0", None, -1, None, None)])
    report = _inject(G.extraction_report(f.files, f.edges),
                     [("repo0", None, -1, None, None, None, None)])
    return V.union_all([
        K.facts_constraints("repos", repos), K.facts_constraints("report", report), K.facts_constraints("files", files),
        K.facts_constraints("modules", f.modules.select("repo_id", "module_id", "path",
                                                        "file_ids")),
        K.facts_constraints("edges", edges), K.facts_constraints("entrypoints", ents),
        K.facts_constraints("deps", f.deps), K.facts_constraints("coupling", cpl)])


#: One document that breaks both shapes, and one that breaks each other rule once.
BAD_DOCUMENTS = [
    ("bad#both", {"schemaVersion": "2.0", "basedOnFactsCommit": None, "tiers": [], "nodes": [],
                  "relationships": [], "perspectives": [], "openQuestions": []}),
    ("bad#rules", {
        "perspectives": [
            {"kind": "odd", "tiers": []},
            {"id": "p", "name": "P", "kind": "domain", "description": "", "tiers": [{"level": -1}],
             "nodes": [{"tier": -1, "confidence": "certain"}],
             "relationships": [{"confidence": "none"}]}],
        "businessBrief": {"headline": "", "capabilities": [{"label": "", "text": "", "confidence": "no"}],
                          "techStack": [{"name": "", "role": "", "factRef": ""}]}})]


@query("narrative_constraints")
def q_narrative_constraints(spark, sf_dir):
    import json
    docs = _inject(_n_docs(spark, sf_dir), [(i, json.dumps(d)) for i, d in BAD_DOCUMENTS])
    t = NR.read_narrative(docs)
    return V.union_all([K.narrative_constraints(name, df) for name, df in (
        ("documents", t.documents), ("perspectives", t.perspectives), ("tiers", t.tiers),
        ("nodes", t.nodes), ("relationships", t.relationships), ("briefs", t.briefs),
        ("brief_claims", t.brief_claims), ("tech", t.tech_stack))])


# ------------------------------------------------------------------ streaming (Tier X)
from repograph.streaming import signals as ST  # noqa: E402


def _stream_dirs(spark) -> tuple[str, str]:
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    return base + "/out", base + "/state"


def _event_touches(spark, sf_dir) -> DataFrame:
    """Event time as the instant whose UTC wall clock is the stored (zone-less) time, so
    windows align to UTC hours whatever the session time zone is."""
    ev = ST.parquet_stream(spark, sf_dir, "events.parquet")
    return ev.select("event_id", ST.ntz_as_utc(spark, "ts").alias("ts"),
                     F.col("user_id").alias("file_id"))


def _run_to_end(spark, streams: list[DataFrame], build) -> DataFrame:
    """Append-mode rows of ``build`` over streams whose input is there and has ended."""
    out, state = _stream_dirs(spark)
    ended = [s.union(ST.end_marks(spark, f"{out}-marks", s)) for s in streams]
    ST.write_end_mark(spark, f"{out}-marks", streams[0])
    ST.run_append(build(*ended), out, state)
    return spark.read.parquet(out)


@query("stream_churn")
def q_stream_churn(spark, sf_dir):
    rows = _run_to_end(spark, [_event_touches(spark, sf_dir)], ST.stream_churn)
    return rows.select("file_id", ST.utc_text(spark, "window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                       "touches")


@query("stream_last_touch")
def q_stream_last_touch(spark, sf_dir):
    out, state = _stream_dirs(spark)
    key, order = ["file_id"], ["last_ts", "last_event_id"]
    ST.run_update(ST.stream_last_touch(_event_touches(spark, sf_dir)), out, state, key, order)
    return ST.latest_per_key(spark, out, key, order).select(
        "file_id", ST.utc_text(spark, "last_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"), "last_event_id")


@query("stream_orphan_refs_changing")
def q_stream_orphan_refs_changing(spark, sf_dir):
    """Clicks on a file that nobody viewed in the two hours before or the hour after."""
    def kind(name: str) -> DataFrame:
        return ST.parquet_stream(spark, sf_dir, "events.parquet").where(F.col("event_type") == name).select(
            "event_id", ST.ntz_as_utc(spark, "ts").alias("ts"), F.col("user_id").alias("file_id"))
    rows = _run_to_end(spark, [kind("click"), kind("view")], lambda refs, seen: ST.stream_orphan_refs_changing(
        refs, seen, keep="2 hours", wait="1 hour"))
    return rows.select("event_id", "file_id")


@query("stream_orphan_refs")
def q_stream_orphan_refs(spark, sf_dir):
    out, state = _stream_dirs(spark)
    files = C.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0).select(
        F.col("c_custkey").alias("file_id"))
    ST.run_append(ST.stream_orphan_refs(_event_touches(spark, sf_dir), files), out, state)
    return spark.read.parquet(out).select("event_id", "file_id")


# ------------------------------------------------------------------ planned extensions (Tier P)
@query("snapshot_diff")
def q_snapshot_diff(spark, sf_dir):
    """D at two part subsets; parts with key % 11 = 0 get one more line in the new one."""
    d = C.corpus_d(spark, sf_dir).files
    k = F.regexp_extract("path", r"/m(\d+)\.[a-z]+$", 1).try_cast("bigint")
    old = d.where(k.isNull() | (k % 5 != 0))
    new = d.where(k.isNull() | (k % 7 != 0)).withColumn(
        "content", F.when(k % 11 == 0, F.concat("content", F.lit("# touched\n")))
        .otherwise(F.col("content")))
    diff = I.snapshot_diff(I.file_inventory(old, use_ignore_file=False),
                           I.file_inventory(new, use_ignore_file=False),
                           ["repo_id", "path"], ["lang", "loc", "size_bytes"])
    return diff.where(F.col("status") != "same").select("repo_id", "path", "status")


@query("entry_reachability")
def q_entry_reachability(spark, sf_dir):
    f = facts_dm(spark, sf_dir)
    return entry_reachability(f.entrypoints, f.edges).select(
        "repo_id", "entry_id", "file_id", "depth")


@query("main_guard_entry")
def q_main_guard_entry(spark, sf_dir):
    """D with a ``__main__`` guard appended to .py parts with key % 53 = 0 and a route
    decorator to those with key % 59 = 0."""
    d = C.corpus_d(spark, sf_dir).files
    k = F.regexp_extract("path", r"/m(\d+)\.py$", 1).try_cast("bigint")
    content = F.concat(
        "content",
        F.when(k % 53 == 0, F.lit('\nif __name__ == "__main__":\n    main()\n')).otherwise(F.lit("")),
        F.when(k % 59 == 0, F.lit('\n@app.get("/health")\ndef health():\n    return 1\n'))
        .otherwise(F.lit("")))
    return EP.main_guard_entrypoints(d.withColumn("content", content)).select(
        "repo_id", "path", "kind")


@query("nested_manifests")
def q_nested_manifests(spark, sf_dir):
    """pom.xml, .csproj, setup.cfg and build.gradle per repo, versions through properties."""
    files = C.corpus_d(spark, sf_dir).files.unionByName(C.m_nested_manifests(spark, sf_dir))
    return BF.nested_manifest_deps(files).select("repo_id", "name", "version", "ecosystem", "manifest")


@query("more_manifests")
def q_more_manifests(spark, sf_dir):
    files = C.corpus_d(spark, sf_dir).files.unionByName(C.m_more_manifests(spark, sf_dir))
    return BF.line_manifest_deps(files).select("repo_id", "name", "version", "ecosystem",
                                               "manifest")
