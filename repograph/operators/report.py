"""Report queries: what the one-page map asks of the fact and narrative tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repograph.operators.ids import running_offsets
from repograph.session import store


def dependency_usage(edges: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo_id, name, file_id): files whose unresolved import names a declared
    dependency - first segment of an absolute Python module, or the bare JS package
    (scoped ``@scope/name`` kept whole)."""
    un = edges.where(F.col("to_id").isNull())
    spec = F.col("module")
    js_pkg = F.when(spec.startswith("@"), F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1)) \
        .otherwise(F.regexp_extract(spec, r"^([^/]+)", 1))
    pkg = (F.when((F.col("lang") == "python") & (F.col("level") == 0),
                  F.split(spec, r"\.").getItem(0))
           .when((F.col("lang") == "js") & ~spec.startswith("."), js_pkg))
    used = un.select("repo_id", pkg.alias("name"), F.col("from_id").alias("file_id")).where(
        F.col("name").isNotNull() & (F.col("name") != ""))
    names = deps.select("repo_id", "name").distinct()
    return used.join(names, ["repo_id", "name"]).distinct()


def used_by_arrays(usage: DataFrame) -> DataFrame:
    """usedByFileIds arrays for the document form."""
    return usage.groupBy("repo_id", "name").agg(
        F.array_sort(F.collect_set("file_id")).alias("used_by_file_ids"))


def dep_lookup(tech: DataFrame, deps: DataFrame) -> DataFrame:
    """The FIRST dependency row (dependency order) with the tech item's name supplies
    the version chip."""
    first = Window.partitionBy("repo_id", "name").orderBy("dep_ord")
    d = (deps.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1)
         .select("repo_id", F.col("name").alias("fact_ref"), "version"))
    return tech.join(d, ["repo_id", "fact_ref"], "left")


def tech_by_role(tech: DataFrame) -> DataFrame:
    """Items grouped by role (empty -> 'other'); roles in order of first appearance,
    items in their original order."""
    role = F.when(F.coalesce(F.col("role"), F.lit("")) == "", F.lit("other")).otherwise(
        F.col("role"))
    return (tech.withColumn("role", role).groupBy("repo_id", "role")
            .agg(F.min("ord").alias("role_ord"), F.count(F.lit(1)).alias("n_items"),
                 F.array_sort(F.collect_list(F.struct("ord", "tech_name", "fact_ref")))
                 .alias("items")))


def stat_tiles(files: DataFrame, mod_files: DataFrame, entrypoints: DataFrame,
               deps: DataFrame) -> DataFrame:
    """Files, LOC, modules, languages, entrypoints and dependencies per repo."""
    f = files.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("loc").cast("bigint").alias("total_loc"),
        F.count_distinct(F.when(F.col("lang") != "unknown", F.col("lang"))).alias("n_languages"))
    m = mod_files.groupBy("repo_id").agg(F.count_distinct("module_id").alias("n_modules"))
    e = entrypoints.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_entrypoints"))
    d = deps.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_dependencies"))
    out = f.join(m, "repo_id", "left").join(e, "repo_id", "left").join(d, "repo_id", "left")
    return out.select("repo_id", "n_files", "total_loc",
                      F.coalesce("n_modules", F.lit(0)).cast("bigint").alias("n_modules"),
                      F.col("n_languages").cast("bigint").alias("n_languages"),
                      F.coalesce("n_entrypoints", F.lit(0)).cast("bigint").alias("n_entrypoints"),
                      F.coalesce("n_dependencies", F.lit(0)).cast("bigint")
                      .alias("n_dependencies"))


# ------------------------------------------------------------------ narrative views
def verified_only(nodes: DataFrame, conf: str = "confidence", interp: str = "interpretation"
                  ) -> DataFrame:
    """Hide rows whose interpretation is true OR whose confidence is low."""
    return nodes.where(~(F.coalesce(F.col(interp), F.lit(False))
                         | F.col(conf).eqNullSafe(F.lit("low"))))


def tier0_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("tier") == 0)


def children_of(node_children: DataFrame, nodes: DataFrame, parent_id: str | None = None
                ) -> DataFrame:
    """Child nodes of one parent (or of all) with their place ``pos`` in its child list;
    unknown children dropped."""
    if parent_id is not None:
        node_children = node_children.where(F.col("node_id") == parent_id)
    ids = nodes.select("repo_id", "perspective_id", F.col("node_id").alias("child_id")).distinct()
    return node_children.join(ids, ["repo_id", "perspective_id", "child_id"])


def leaf_nodes(nodes: DataFrame, node_children: DataFrame) -> DataFrame:
    has = node_children.select("repo_id", "perspective_id", "node_id").distinct()
    return nodes.join(has, ["repo_id", "perspective_id", "node_id"], "left_anti")


def visible_subgraph(nodes: DataFrame, relationships: DataFrame, only_verified: bool = True
                     ) -> tuple[DataFrame, DataFrame]:
    """Visible nodes and the relationships with both ends visible."""
    vis = verified_only(nodes) if only_verified else nodes
    ids = vis.select("repo_id", "perspective_id", "node_id").distinct()
    rels = (relationships
            .join(ids.withColumnRenamed("node_id", "from_id"),
                  ["repo_id", "perspective_id", "from_id"], "left_semi")
            .join(ids.withColumnRenamed("node_id", "to_id"),
                  ["repo_id", "perspective_id", "to_id"], "left_semi"))
    return vis, rels


def node_relations(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outbound and inbound relationships per node with the other end's label: that of the
    last node with the id, or the id itself if that label is empty or there is no node."""
    labels = nodes.groupBy("repo_id", "perspective_id", F.col("node_id").alias("other_id")).agg(
        F.max_by("label", "ord").alias("other_label"))
    out = relationships.select("repo_id", "perspective_id", "ord",
                               F.col("from_id").alias("node_id"), F.col("to_id").alias("other_id"),
                               F.lit("out").alias("direction"))
    inn = relationships.select("repo_id", "perspective_id", "ord",
                               F.col("to_id").alias("node_id"), F.col("from_id").alias("other_id"),
                               F.lit("in").alias("direction"))
    return (out.unionByName(inn).join(labels, ["repo_id", "perspective_id", "other_id"], "left")
            .withColumn("other_label", F.coalesce(_nonempty(F.col("other_label")), "other_id")))


def hover_counts(nodes: DataFrame, node_refs: DataFrame, relationships: DataFrame
                 ) -> DataFrame:
    """Per node: module refs, file refs, and relationships out + in (a self-loop counts
    twice)."""
    refs = node_refs.groupBy("repo_id", "perspective_id", "ord").agg(
        F.count_if(F.col("ref_kind") == "module").alias("n_modules"),
        F.count_if(F.col("ref_kind") == "file").alias("n_files"))
    ends = relationships.select("repo_id", "perspective_id", F.explode(
        F.array("from_id", "to_id")).alias("node_id"))
    rel = ends.groupBy("repo_id", "perspective_id", "node_id").agg(
        F.count(F.lit(1)).alias("n_relationships"))
    return (nodes.select("repo_id", "perspective_id", "ord", "node_id")
            .join(refs, ["repo_id", "perspective_id", "ord"], "left")
            .join(rel, ["repo_id", "perspective_id", "node_id"], "left")
            .select("repo_id", "perspective_id", "ord", "node_id",
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                      for c in ["n_modules", "n_files", "n_relationships"]]))


def _ref_paths(node_refs: DataFrame, files: DataFrame, modules: DataFrame,
               key: list[str], with_ids: bool = False) -> DataFrame:
    """Per key: file paths and module paths in reference order (unknown id shown as
    itself), with the id in brackets on request."""
    fp = files.select("repo_id", F.col("file_id").alias("ref_id"), F.col("path").alias("fpath"))
    mp = modules.select("repo_id", F.col("module_id").alias("ref_id"),
                        F.col("path").alias("mpath")).distinct()
    r = (node_refs.join(fp, ["repo_id", "ref_id"], "left").join(mp, ["repo_id", "ref_id"], "left")
         .withColumn("shown", F.when(F.col("ref_kind") == "file", F.coalesce("fpath", "ref_id"))
                     .otherwise(F.coalesce("mpath", "ref_id"))))
    if with_ids:
        r = r.withColumn("shown", F.concat("shown", F.lit(" ("), "ref_id", F.lit(")")))
    pos = F.struct(F.col("ref_pos"), F.col("shown"))

    def ordered(kind):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("ref_kind") == kind, pos))),
                           lambda x: x["shown"])
    return r.groupBy(*key).agg(ordered("file").alias("file_paths"),
                               ordered("module").alias("module_paths"))


def node_provenance(node_refs: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    return _ref_paths(node_refs, files, modules, ["repo_id", "perspective_id", "ord", "node_id"])


def _line(prefix: str, arr) -> F.Column:
    return F.when(F.size(arr) > 0, F.concat(F.lit(prefix), F.array_join(arr, ", ")))


def _nonempty(c) -> F.Column:
    return F.when(c != "", c)


def _confidence() -> F.Column:
    mark = F.when(F.coalesce("interpretation", F.lit(False)), F.lit(" (interpretation)"))
    return F.concat(F.lit("Confidence: "), "confidence", F.coalesce(mark, F.lit("")))


def node_context(perspectives: DataFrame, nodes: DataFrame, node_refs: DataFrame,
                 relationships: DataFrame, rel_edge_refs: DataFrame, files: DataFrame,
                 modules: DataFrame) -> DataFrame:
    """One text block per node: repository, perspective, label, description, modules and
    files with their ids, the fact edges of all relationships that leave the node and then of
    those that enter it, confidence; empty lines dropped."""
    prov = _ref_paths(node_refs, files, modules, ["repo_id", "perspective_id", "ord", "node_id"], True)
    ends = relationships.select("repo_id", "perspective_id", F.col("ord").alias("rel"), F.posexplode(
        F.array("from_id", "to_id")).alias("side", "node_id"))
    met = ends.join(rel_edge_refs.withColumnRenamed("ord", "rel"), ["repo_id", "perspective_id", "rel"])
    edges = met.groupBy("repo_id", "perspective_id", "node_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("side", "rel", "ref_pos", "edge_id"))),
        lambda x: x["edge_id"]).alias("edge_ids"))
    p = perspectives.select("repo_id", "perspective_id", F.col("name").alias("pname")).distinct()
    j = (nodes.join(p, ["repo_id", "perspective_id"], "left")
         .join(prov, ["repo_id", "perspective_id", "ord", "node_id"], "left")
         .join(edges, ["repo_id", "perspective_id", "node_id"], "left"))
    empty = F.array().cast("array<string>")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Repository: "), "repo_id"), F.concat(F.lit("Perspective: "), "pname"),
        F.concat(F.lit("Node: "), "label"), _nonempty(F.col("description")),
        _line("Modules: ", F.coalesce("module_paths", empty)),
        _line("Files: ", F.coalesce("file_paths", empty)),
        _line("Edges: ", F.coalesce("edge_ids", empty)), _confidence())
    return j.select("repo_id", "perspective_id", "ord", "node_id", text.alias("context"))


def brief_context(brief_claims: DataFrame, brief_refs: DataFrame, files: DataFrame,
                  modules: DataFrame) -> DataFrame:
    """One text block per claim, its modules and files in reference order with their ids."""
    prov = _ref_paths(brief_refs, files, modules, ["repo_id", "brief_id", "ord"], True)
    j = brief_claims.join(prov, ["repo_id", "brief_id", "ord"], "left")
    empty = F.array().cast("array<string>")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Repository: "), "repo_id"), F.concat(F.lit("Claim: "), "claim_kind"),
        _nonempty(F.col("text")),
        _line("Modules: ", F.coalesce("module_paths", empty)),
        _line("Files: ", F.coalesce("file_paths", empty)), _confidence())
    return j.select("repo_id", "brief_id", "ord", text.alias("context"))


def capability_cards(brief_claims: DataFrame) -> DataFrame:
    caps = verified_only(brief_claims.where(F.col("claim_kind") == "capability"))
    return caps.select("repo_id", "brief_id", "ord", "label",
                       (F.col("perspective_ref").isNotNull() & F.col("node_ref").isNotNull())
                       .alias("linkable"))


def coverage_banner(report: DataFrame) -> DataFrame:
    """Display strings; a dash when a list is empty."""
    def show(c):
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit("—"))
    return report.select("repo_id", show(F.col("languages")).alias("languages"),
                         F.col("edges_resolved").cast("string").alias("resolved"),
                         F.col("edges_unresolved").cast("string").alias("unresolved"),
                         show(F.col("tools")).alias("tools"),
                         show(F.col("skipped")).alias("skipped"))


def escape_inline_json(col) -> F.Column:
    """JSON text safe inside a script element: every ``</`` becomes ``<\\/``."""
    return F.regexp_replace(F.to_json(col), "</", "<\\\\/")


# ------------------------------------------------------------------ code payload
def referenced_files(node_refs: DataFrame) -> DataFrame:
    """Distinct file ids referenced by nodes of any perspective (module refs excluded)."""
    return (node_refs.where(F.col("ref_kind") == "file")
            .select("repo_id", F.col("ref_id").alias("file_id")).distinct())


def code_budget(sized: DataFrame, total_cap: int) -> DataFrame:
    """Admit files in id order under a byte budget: a file that does not fit is dropped
    and LATER smaller files may still fit; nothing is dropped while the running total is
    0. This is a greedy choice (not a prefix cut): adds ``dropped``.

    Computed in rounds over all repositories at once, on (file_id, n) pairs in range
    partitions, never a repository in one group: prefix sums admit the files up to the first
    that does not fit; it is dropped, and so is every later file larger than what is left;
    the rest goes into the next round. A round leaves less than half the budget or drops
    everything above half of it, so their number grows with the logarithm of the budget.
    """
    rest = store(sized.select("repo_id", "file_id", "n"), "sized")
    total = rest.select("repo_id").distinct().withColumn("total", F.lit(0).cast("bigint"))
    done = None
    while not rest.isEmpty():
        placed = running_offsets(rest, ["repo_id"], ["file_id"], "n", "before").join(total, "repo_id")
        at = F.col("total") + F.col("before")
        placed = store(placed.withColumn("fits", (at == 0) | (at + F.col("n") <= total_cap)), "placed")
        cut = placed.where(~F.col("fits")).groupBy("repo_id").agg(F.min("file_id").alias("cut"))
        judged = placed.join(cut, "repo_id", "left")
        taken = F.col("cut").isNull() | (F.col("file_id") < F.col("cut"))
        total = store(judged.groupBy("repo_id").agg(
            (F.first("total") + F.coalesce(F.sum(F.when(taken, F.col("n"))), F.lit(0))).alias("total")), "totals")
        judged = judged.drop("total").join(total, "repo_id")
        over = (F.col("file_id") == F.col("cut")) | ((F.col("total") > 0)
                                                     & (F.col("total") + F.col("n") > total_cap))
        judged = store(judged.select("repo_id", "file_id", "n", F.when(taken, F.lit(False)).when(
            over, F.lit(True)).alias("dropped")), "judged")
        closed = judged.where(F.col("dropped").isNotNull())
        done = closed if done is None else done.unionByName(closed)
        rest = judged.where(F.col("dropped").isNull()).drop("dropped")
    flags = done if done is not None else rest.withColumn("dropped", F.lit(False))
    return sized.join(flags.select("repo_id", "file_id", "dropped"), ["repo_id", "file_id"])


def code_payload(node_refs: DataFrame, files: DataFrame, contents: DataFrame,
                 per_file_cap: int, total_cap: int) -> DataFrame:
    """Referenced and known files with content: ``truncated`` at ``per_file_cap`` bytes
    on a character boundary, ``missing`` when the content is absent, ``dropped`` by the
    total budget (then content is empty). Unknown ids are skipped. Files that are no valid
    UTF-8 are shown with replacement characters where the source has them (``replaced``)."""
    from repograph.functions.text import utf8_truncate
    ref = referenced_files(node_refs).join(files.select("repo_id", "file_id", "path", "lang"),
                                           ["repo_id", "file_id"])
    text = F.coalesce("content", "replaced") if "replaced" in contents.columns else F.col("content")
    # Texts are cut in their own rows: only what is shown of them goes through the join.
    shown = (contents.select("repo_id", "path", text.alias("content")).where(F.col("content").isNotNull())
             .withColumn("truncated", F.octet_length("content") > per_file_cap)
             .withColumn("content", F.when(F.col("truncated"), utf8_truncate("content", per_file_cap))
                         .otherwise(F.col("content"))))
    cut = (ref.join(shown, ["repo_id", "path"], "left")
           .withColumn("missing", F.col("content").isNull())
           .withColumn("truncated", F.coalesce("truncated", F.lit(False)))
           .withColumn("content", F.coalesce("content", F.lit("")))
           .withColumn("n", F.octet_length("content").cast("bigint")))
    sized = cut.where(~F.col("missing")).select("repo_id", "file_id", "n")
    budget = code_budget(sized, total_cap).select("repo_id", "file_id", "dropped")
    out = cut.join(budget, ["repo_id", "file_id"], "left").withColumn(
        "dropped", F.coalesce("dropped", F.lit(False)))
    return (out.withColumn("content", F.when(F.col("dropped"), F.lit("")).otherwise(F.col("content")))
            .withColumn("truncated", F.col("truncated") & ~F.col("dropped")))
