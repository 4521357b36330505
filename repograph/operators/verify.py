"""Verification gate: data-quality checks of a narrative against the fact tables.

Every check returns the same violations schema
``(repo_id, severity, check, scope, subject, ref)`` where ``scope`` is the perspective
(or brief) the finding belongs to. Checks are independent branches; ``violations``
unions them and ``gate_status`` groups them. Duplicate-id checks count with an
aggregation (no sort of a hot id's rows) and emit n-1 rows per repeated id.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.session import store

VIOLATION_COLS = ["repo_id", "severity", "check", "scope", "subject", "ref"]

SLICE = 10_000                # repeats of one key that one row makes


def _v(df: DataFrame, severity: str, check: str, scope, subject, ref=None) -> DataFrame:
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    return df.select("repo_id", F.lit(severity).alias("severity"), F.lit(check).alias("check"),
                     c(scope).cast("string").alias("scope"),
                     c(subject).cast("string").alias("subject"),
                     (c(ref) if ref is not None else F.lit(None)).cast("string").alias("ref"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per occurrence after the first of each key (n - 1 rows), made in slices so that
    no array grows with a key's repeats."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    slices = counted.select(*keys, "_n", F.explode(F.sequence(F.lit(2).cast("long"), F.col("_n"),
                                                              F.lit(SLICE).cast("long"))).alias("_from"))
    return slices.select(*keys, F.explode(F.sequence("_from", F.least(F.col("_from") + SLICE - 1, F.col("_n"))))
                         .alias("occurrence"))


# ------------------------------------------------------------------ structure
def dup_perspective_ids(perspectives: DataFrame) -> DataFrame:
    r = _repeats(perspectives, ["repo_id", "perspective_id"])
    return _v(r, "error", "perspective-ids", "perspective_id", "perspective_id")


def dup_node_ids(nodes: DataFrame) -> DataFrame:
    r = _repeats(nodes, ["repo_id", "perspective_id", "node_id"])
    return _v(r, "error", "node-ids", "perspective_id", "node_id")


# ------------------------------------------------------------------ referential integrity
def orphan_file_refs(node_refs: DataFrame, files: DataFrame) -> DataFrame:
    """One error per file reference (duplicates kept) to an unknown file id."""
    refs = node_refs.where(F.col("ref_kind") == "file")
    bad = refs.join(files.select("repo_id", F.col("file_id").alias("ref_id")),
                    ["repo_id", "ref_id"], "left_anti")
    return _v(bad, "error", "referential-integrity", "perspective_id", "node_id", "ref_id")


def orphan_module_refs(node_refs: DataFrame, modules: DataFrame) -> DataFrame:
    refs = node_refs.where(F.col("ref_kind") == "module")
    bad = refs.join(modules.select("repo_id", F.col("module_id").alias("ref_id")).distinct(),
                    ["repo_id", "ref_id"], "left_anti")
    return _v(bad, "error", "referential-integrity", "perspective_id", "node_id", "ref_id")


def orphan_edge_refs(rel_edge_refs: DataFrame, edges: DataFrame) -> DataFrame:
    bad = rel_edge_refs.join(edges.select("repo_id", "edge_id").distinct(),
                             ["repo_id", "edge_id"], "left_anti")
    return _v(bad, "error", "referential-integrity", "perspective_id", "ord", "edge_id")


def relationship_endpoints(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """``from`` and ``to`` must each be a node of the SAME perspective."""
    ends = relationships.select(
        "repo_id", "perspective_id", "ord",
        F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("from_id").alias("ref")),
                          F.struct(F.lit("to").alias("end"), F.col("to_id").alias("ref"))))
        .alias("e")).select("repo_id", "perspective_id", "ord", "e.end", "e.ref")
    ids = nodes.select("repo_id", "perspective_id", F.col("node_id").alias("ref")).distinct()
    bad = ends.join(ids, ["repo_id", "perspective_id", "ref"], "left_anti")
    return _v(bad, "error", "relationship-endpoints", "perspective_id", "end", "ref")


# ------------------------------------------------------------------ grounding
def _allowed(interp: str, conf: str, text: str) -> F.Column:
    return (F.coalesce(F.col(interp), F.lit(False)) & (F.col(conf) == "low")
            & (F.coalesce(F.col(text), F.lit("")) != ""))


def empty_grounding(nodes: DataFrame, node_refs: DataFrame) -> DataFrame:
    """No refs at all is an error unless interpretation AND low confidence AND a
    non-empty description. An unknown ref still counts as grounding."""
    has = node_refs.select("repo_id", "perspective_id", "ord").distinct()
    bare = nodes.join(has, ["repo_id", "perspective_id", "ord"], "left_anti")
    bad = bare.where(~_allowed("interpretation", "confidence", "description"))
    return _v(bad, "error", "empty-grounding", "perspective_id", "node_id")


def file_existence(node_refs: DataFrame, files: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct file ids referenced per perspective whose path is absent from the
    checkout; ids unknown to the facts are skipped; module refs are not checked."""
    ref = (node_refs.where(F.col("ref_kind") == "file")
           .select("repo_id", "perspective_id", F.col("ref_id").alias("file_id")).distinct())
    known = ref.join(files.select("repo_id", "file_id", "path"), ["repo_id", "file_id"])
    bad = known.join(present.select("repo_id", "path").distinct(), ["repo_id", "path"],
                     "left_anti")
    return _v(bad, "error", "file-existence", "perspective_id", "file_id", "path")


# ------------------------------------------------------------------ coverage
def covered_files(node_refs: DataFrame, module_files: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, perspective_id, file_id): direct file refs and members of referenced
    modules, intersected with real files."""
    direct = (node_refs.where(F.col("ref_kind") == "file")
              .select("repo_id", "perspective_id", F.col("ref_id").alias("file_id")))
    via = (node_refs.where(F.col("ref_kind") == "module")
           .select("repo_id", "perspective_id", F.col("ref_id").alias("module_id")).distinct()
           .join(module_files.select("repo_id", "module_id", "file_id"), ["repo_id", "module_id"])
           .select("repo_id", "perspective_id", "file_id"))
    return (direct.unionByName(via).distinct()
            .join(files.select("repo_id", "file_id"), ["repo_id", "file_id"], "left_semi"))


def coverage_bitmaps(node_refs: DataFrame, module_files: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, perspective_id, bucket, bits): the covered files of each perspective as bitmaps
    over the numbers in their positional ids (``f0001``), 32,768 files a bucket; stored.

    A module's files become bitmaps once, so a reference to a module is joined to one row for
    each bucket and not for each file. Perspectives and the total are read from the same rows by
    merging bitmaps: files that several references cover need no distinct.
    """
    number = F.regexp_extract("file_id", "([0-9]+)$", 1).cast("bigint")
    place = [F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit")]
    known = files.select("repo_id", "file_id")
    members = module_files.join(known, ["repo_id", "file_id"], "left_semi").select("repo_id", "module_id", *place)
    members = members.groupBy("repo_id", "module_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    refs = node_refs.select("repo_id", "perspective_id", "ref_kind", "ref_id").distinct()
    direct = (refs.where(F.col("ref_kind") == "file").withColumnRenamed("ref_id", "file_id")
              .join(known, ["repo_id", "file_id"], "left_semi").select("repo_id", "perspective_id", *place)
              .groupBy("repo_id", "perspective_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    via = (refs.where(F.col("ref_kind") == "module").withColumnRenamed("ref_id", "module_id")
           .join(members, ["repo_id", "module_id"]).select("repo_id", "perspective_id", "bucket", "bits"))
    return store(direct.unionByName(via).groupBy("repo_id", "perspective_id", "bucket")
                 .agg(F.bitmap_or_agg("bits").alias("bits")), "coverage")


def _pct(c, t) -> F.Column:
    return F.when(t > 0, F.bround(F.lit(100.0) * c / t, 2)).otherwise(F.lit(0.0))


def coverage_by_perspective(perspectives: DataFrame, nodes: DataFrame, covered: DataFrame,
                            files: DataFrame) -> DataFrame:
    """Files that each perspective covers, from ``coverage_bitmaps``."""
    total = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
    n = nodes.groupBy("repo_id", "perspective_id").agg(F.count(F.lit(1)).alias("node_count"))
    c = covered.groupBy("repo_id", "perspective_id").agg(
        F.sum(F.bitmap_count("bits")).alias("files_covered"))
    p = perspectives.select("repo_id", "perspective_id").distinct()
    out = (p.join(n, ["repo_id", "perspective_id"], "left")
           .join(c, ["repo_id", "perspective_id"], "left").join(total, "repo_id", "left")
           .fillna(0, ["node_count", "files_covered", "total_files"]))
    return out.select("repo_id", "perspective_id",
                      F.col("node_count").cast("bigint").alias("node_count"),
                      F.col("files_covered").cast("bigint").alias("files_covered"),
                      _pct(F.col("files_covered"), F.col("total_files")).alias("coverage_pct"))


def coverage_total(repos: DataFrame, nodes: DataFrame, covered: DataFrame, files: DataFrame,
                   edges: DataFrame) -> DataFrame:
    """Files that any perspective covers, from ``coverage_bitmaps``."""
    n = nodes.groupBy("repo_id").agg(F.count(F.lit(1)).alias("node_count"))
    c = covered.groupBy("repo_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")).groupBy("repo_id").agg(
        F.sum(F.bitmap_count("bits")).alias("files_covered"))
    t = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"))
    u = edges.groupBy("repo_id").agg(
        F.count_if(F.col("resolution") == "unresolved").alias("unresolved_edges"))
    out = (repos.select("repo_id").distinct().join(n, "repo_id", "left")
           .join(c, "repo_id", "left").join(t, "repo_id", "left").join(u, "repo_id", "left")
           .fillna(0, ["node_count", "files_covered", "total_files", "unresolved_edges"]))
    return out.select("repo_id", F.col("node_count").cast("bigint").alias("node_count"),
                      F.col("files_covered").cast("bigint").alias("files_covered"),
                      F.col("total_files").cast("bigint").alias("total_files"),
                      _pct(F.col("files_covered"), F.col("total_files")).alias("coverage_pct"),
                      F.col("unresolved_edges").cast("bigint").alias("unresolved_edges"))


def commit_match(narratives: DataFrame, repos: DataFrame) -> DataFrame:
    """WARN when the narrative's commit differs from the facts head (null = null)."""
    j = narratives.join(repos.select("repo_id", "head_commit"), "repo_id", "left")
    bad = j.where(~F.col("based_on_facts_commit").eqNullSafe(F.col("head_commit")))
    return _v(bad, "warning", "commit-match", "narrative_id", "based_on_facts_commit",
              "head_commit")


# ------------------------------------------------------------------ business brief
CLAIM_KINDS = ["problem", "solution", "audience", "capability"]


def brief_grounding(claims: DataFrame, brief_refs: DataFrame) -> DataFrame:
    has = brief_refs.select("repo_id", "brief_id", "ord").distinct()
    bare = claims.where(F.col("claim_kind").isin(*CLAIM_KINDS)).join(
        has, ["repo_id", "brief_id", "ord"], "left_anti")
    bad = bare.where(~_allowed("interpretation", "confidence", "text"))
    return _v(bad, "error", "empty-grounding", "brief_id", "claim_kind", "ord")


def brief_orphan_refs(brief_refs: DataFrame, files: DataFrame, modules: DataFrame
                      ) -> DataFrame:
    f = brief_refs.where(F.col("ref_kind") == "file").join(
        files.select("repo_id", F.col("file_id").alias("ref_id")), ["repo_id", "ref_id"],
        "left_anti")
    m = brief_refs.where(F.col("ref_kind") == "module").join(
        modules.select("repo_id", F.col("module_id").alias("ref_id")).distinct(),
        ["repo_id", "ref_id"], "left_anti")
    return _v(f.unionByName(m), "error", "referential-integrity", "brief_id", "ord", "ref_id")


def brief_file_existence(brief_refs: DataFrame, files: DataFrame, present: DataFrame
                         ) -> DataFrame:
    """Per reference (not distinct)."""
    known = (brief_refs.where(F.col("ref_kind") == "file")
             .join(files.select("repo_id", F.col("file_id").alias("ref_id"), "path"),
                   ["repo_id", "ref_id"]))
    bad = known.join(present.select("repo_id", "path").distinct(), ["repo_id", "path"],
                     "left_anti")
    return _v(bad, "error", "file-existence", "brief_id", "ref_id", "path")


def capability_refs(claims: DataFrame, perspectives: DataFrame, nodes: DataFrame) -> DataFrame:
    """perspectiveRef must exist; a nodeRef needs a perspectiveRef and must be a node in
    it. Both errors may fire for one capability."""
    caps = claims.where(F.col("claim_kind") == "capability")
    pids = perspectives.select("repo_id", F.col("perspective_id").alias("perspective_ref")
                               ).distinct()
    bad_p = caps.where(F.col("perspective_ref").isNotNull()).join(
        pids, ["repo_id", "perspective_ref"], "left_anti")
    no_p = caps.where(F.col("node_ref").isNotNull() & F.col("perspective_ref").isNull())
    nids = nodes.select("repo_id", F.col("perspective_id").alias("perspective_ref"),
                        F.col("node_id").alias("node_ref")).distinct()
    bad_n = caps.where(F.col("node_ref").isNotNull() & F.col("perspective_ref").isNotNull()
                       ).join(nids, ["repo_id", "perspective_ref", "node_ref"], "left_anti")
    return union_all([
        _v(bad_p, "error", "capability-ref", "brief_id", "label", "perspective_ref"),
        _v(no_p, "error", "capability-ref", "brief_id", "label", "node_ref"),
        _v(bad_n, "error", "capability-ref", "brief_id", "label", "node_ref")])


def techstack_refs(tech: DataFrame, deps: DataFrame, scope: str = "repo_id") -> DataFrame:
    """Each tech-stack entry must name an external dependency of its repository."""
    bad = tech.join(deps.select("repo_id", F.col("name").alias("fact_ref")).distinct(),
                    ["repo_id", "fact_ref"], "left_anti")
    return _v(bad, "error", "techstack-ref", scope, "tech_name", "fact_ref")


def headline_warning(briefs: DataFrame) -> DataFrame:
    bad = briefs.where(F.coalesce(F.col("headline"), F.lit("")) == "")
    return _v(bad, "warning", "headline", "brief_id", "brief_id")


# ------------------------------------------------------------------ planned (not enforced by
# the reference): children, relationship grounding, tier sizing
def dangling_children(node_children: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("repo_id", "perspective_id", F.col("node_id").alias("child_id")).distinct()
    bad = node_children.join(ids, ["repo_id", "perspective_id", "child_id"], "left_anti")
    return _v(bad, "error", "dangling-child", "perspective_id", "node_id", "child_id")


def ungrounded_relationships(relationships: DataFrame, rel_edge_refs: DataFrame) -> DataFrame:
    has = rel_edge_refs.select("repo_id", "perspective_id", "ord").distinct()
    bad = relationships.join(has, ["repo_id", "perspective_id", "ord"], "left_anti")
    return _v(bad, "error", "ungrounded-relationship", "perspective_id", "ord")


def tier_sizing(nodes: DataFrame, node_refs: DataFrame, lo: int = 3, hi: int = 7,
                max_files: int = 15) -> DataFrame:
    """Guidance: tier 0 holds 3-7 nodes; a node backing more than 15 files needs
    another tier."""
    t0 = (nodes.where(F.col("tier") == 0).groupBy("repo_id", "perspective_id")
          .agg(F.count(F.lit(1)).alias("n")).where((F.col("n") < lo) | (F.col("n") > hi)))
    wide = (node_refs.where(F.col("ref_kind") == "file")
            .groupBy("repo_id", "perspective_id", "ord", "node_id")
            .agg(F.count_distinct("ref_id").alias("n")).where(F.col("n") > max_files))
    return union_all([_v(t0, "warning", "tier0-size", "perspective_id", "n"),
                      _v(wide, "warning", "node-too-broad", "node_id", "ord", "n")])


# ------------------------------------------------------------------ gate
def gate_status(scopes: DataFrame, violations: DataFrame) -> DataFrame:
    """FAIL iff any error in the scope; warnings never fail."""
    agg = violations.groupBy("repo_id", "scope").agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    out = scopes.select("repo_id", "scope").distinct().join(agg, ["repo_id", "scope"], "left")
    return out.select("repo_id", "scope",
                      F.coalesce("n_errors", F.lit(0)).cast("bigint").alias("n_errors"),
                      F.coalesce("n_warnings", F.lit(0)).cast("bigint").alias("n_warnings"),
                      F.when(F.coalesce("n_errors", F.lit(0)) > 0, F.lit("FAIL"))
                      .otherwise(F.lit("PASS")).alias("status"))
