"""Narrative documents (v1 or v2 shape) -> exploded narrative tables.

``read_narrative`` takes ``docs(doc_id, json)`` and parses with an explicit schema (no
inference). A v1 document (root-level tiers/nodes/relationships) becomes one
perspective ``default`` of kind structural, so every check runs on both shapes.
Positions are kept (``posexplode``) because order matters downstream; an empty array gives
no rows.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from repograph.session import store

S = Ty.StringType()
REFS = Ty.StructType([Ty.StructField("moduleIds", Ty.ArrayType(S)),
                      Ty.StructField("fileIds", Ty.ArrayType(S))])
NODE = Ty.StructType([
    Ty.StructField("id", S), Ty.StructField("tier", Ty.IntegerType()),
    Ty.StructField("label", S), Ty.StructField("description", S),
    Ty.StructField("factRefs", REFS), Ty.StructField("children", Ty.ArrayType(S)),
    Ty.StructField("confidence", S), Ty.StructField("interpretation", Ty.BooleanType())])
REL = Ty.StructType([
    Ty.StructField("from", S), Ty.StructField("to", S), Ty.StructField("label", S),
    Ty.StructField("factEdgeIds", Ty.ArrayType(S)), Ty.StructField("confidence", S)])
TIER = Ty.StructType([Ty.StructField("level", Ty.IntegerType()), Ty.StructField("name", S)])
PERSPECTIVE = Ty.StructType([
    Ty.StructField("id", S), Ty.StructField("name", S), Ty.StructField("kind", S),
    Ty.StructField("description", S), Ty.StructField("tiers", Ty.ArrayType(TIER)),
    Ty.StructField("nodes", Ty.ArrayType(NODE)),
    Ty.StructField("relationships", Ty.ArrayType(REL))])
CLAIM = Ty.StructType([
    Ty.StructField("label", S), Ty.StructField("text", S), Ty.StructField("factRefs", REFS),
    Ty.StructField("confidence", S), Ty.StructField("interpretation", Ty.BooleanType()),
    Ty.StructField("perspectiveRef", S), Ty.StructField("nodeRef", S)])
BRIEF = Ty.StructType([
    Ty.StructField("headline", S), Ty.StructField("problem", CLAIM),
    Ty.StructField("solution", CLAIM), Ty.StructField("audience", CLAIM),
    Ty.StructField("howItWorks", S), Ty.StructField("capabilities", Ty.ArrayType(CLAIM)),
    Ty.StructField("techStack", Ty.ArrayType(Ty.StructType([
        Ty.StructField("name", S), Ty.StructField("role", S), Ty.StructField("factRef", S)])))])
NARRATIVE = Ty.StructType([
    Ty.StructField("schemaVersion", S), Ty.StructField("basedOnFactsCommit", S),
    Ty.StructField("tiers", Ty.ArrayType(TIER)), Ty.StructField("nodes", Ty.ArrayType(NODE)),
    Ty.StructField("relationships", Ty.ArrayType(REL)),
    Ty.StructField("perspectives", Ty.ArrayType(PERSPECTIVE)),
    Ty.StructField("businessBrief", BRIEF), Ty.StructField("openQuestions", Ty.ArrayType(S))])

#: The brief's claims that are no list, in order.
SINGLE_CLAIMS = ("problem", "solution", "audience")


@dataclass
class NarrativeTables:
    documents: DataFrame
    perspectives: DataFrame
    nodes: DataFrame
    node_refs: DataFrame
    node_children: DataFrame
    relationships: DataFrame
    rel_edge_refs: DataFrame
    tiers: DataFrame
    briefs: DataFrame          # documents with a brief: headline, how it works
    brief_claims: DataFrame    # problem, solution, audience, then the capabilities, by ord
    brief_refs: DataFrame
    tech_stack: DataFrame
    open_questions: DataFrame


def parse_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, doc struct, shape) - ``shape`` is v2 / v1 / invalid (exactly one)."""
    d = docs.select("doc_id", F.from_json("json", NARRATIVE).alias("doc"))
    has_p = F.col("doc.perspectives").isNotNull()
    has_v1 = (F.col("doc.tiers").isNotNull() & F.col("doc.nodes").isNotNull()
              & F.col("doc.relationships").isNotNull())
    shape = F.when(has_p & ~has_v1, "v2").when(~has_p & has_v1, "v1").otherwise("invalid")
    return d.withColumn("shape", shape)


def normalize_perspectives(parsed: DataFrame) -> DataFrame:
    """(doc_id, ord, p): the v2 array, or the v1 root wrapped as perspective
    ``default`` / ``Overview`` / structural."""
    v1 = F.array(F.struct(F.lit("default").alias("id"), F.lit("Overview").alias("name"),
                          F.lit("structural").alias("kind"), F.lit("").alias("description"),
                          F.col("doc.tiers").alias("tiers"), F.col("doc.nodes").alias("nodes"),
                          F.col("doc.relationships").alias("relationships")))
    ps = F.when(F.col("doc.perspectives").isNotNull(), F.col("doc.perspectives")).otherwise(v1)
    return parsed.select("doc_id", F.posexplode(ps).alias("ord", "p"))


def read_narrative(docs: DataFrame, once: bool = True) -> NarrativeTables:
    """All tables of the documents. With ``once`` the parsed documents are stored, so the JSON is
    read a single time; a caller of one or two tables may have it read for each instead."""
    parsed = parse_documents(docs)
    parsed = store(parsed, "narratives") if once else parsed
    per = normalize_perspectives(parsed)
    perspectives = per.select("doc_id", "ord", F.col("p.id").alias("perspective_id"),
                              F.col("p.name").alias("name"), F.col("p.kind").alias("kind"),
                              F.col("p.description").alias("description"),
                              F.coalesce(F.size("p.tiers"), F.lit(0)).alias("n_tiers"),
                              F.col("p.nodes").isNotNull().alias("has_nodes"),
                              F.col("p.relationships").isNotNull().alias("has_relationships"))
    nodes_x = per.select("doc_id", F.col("p.id").alias("perspective_id"),
                         F.posexplode("p.nodes").alias("ord", "n"))
    nodes = nodes_x.select("doc_id", "perspective_id", "ord", F.col("n.id").alias("node_id"),
                           F.col("n.tier").alias("tier"), F.col("n.label").alias("label"),
                           F.col("n.description").alias("description"),
                           F.col("n.confidence").alias("confidence"),
                           F.col("n.interpretation").alias("interpretation"),
                           F.col("n.factRefs").isNotNull().alias("has_fact_refs"),
                           F.col("n.children").isNotNull().alias("has_children"))
    key = ["doc_id", "perspective_id", "ord", F.col("n.id").alias("node_id")]
    frefs = nodes_x.select(*key, F.lit("file").alias("ref_kind"),
                           F.posexplode("n.factRefs.fileIds").alias("ref_pos", "ref_id"))
    mrefs = nodes_x.select(*key, F.lit("module").alias("ref_kind"),
                           F.posexplode("n.factRefs.moduleIds").alias("ref_pos", "ref_id"))
    children = nodes_x.select("doc_id", "perspective_id", F.col("n.id").alias("node_id"),
                              F.posexplode("n.children").alias("pos", "child_id"))
    rel_x = per.select("doc_id", F.col("p.id").alias("perspective_id"),
                       F.posexplode("p.relationships").alias("ord", "r"))
    rels = rel_x.select("doc_id", "perspective_id", "ord", F.col("r.from").alias("from_id"),
                        F.col("r.to").alias("to_id"), F.col("r.label").alias("label"),
                        F.col("r.confidence").alias("confidence"),
                        F.col("r.factEdgeIds").isNotNull().alias("has_fact_edge_ids"))
    rel_refs = rel_x.select("doc_id", "perspective_id", "ord",
                            F.posexplode("r.factEdgeIds").alias("ref_pos", "edge_id"))
    documents = parsed.select("doc_id", "shape",
                              F.col("doc.schemaVersion").alias("schema_version"),
                              F.col("doc.basedOnFactsCommit").alias("based_on_facts_commit"))
    tiers = per.select("doc_id", F.col("p.id").alias("perspective_id"),
                       F.posexplode("p.tiers").alias("ord", "t")).select(
        "doc_id", "perspective_id", "ord", F.col("t.level").alias("level"), F.col("t.name").alias("name"))
    questions = parsed.select("doc_id", F.posexplode("doc.openQuestions").alias("ord", "question"))
    return NarrativeTables(documents, perspectives, nodes, frefs.unionByName(mrefs), children,
                           rels, rel_refs, tiers, *_read_brief(parsed), questions)


def _read_brief(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The optional business brief: briefs, claims, claim references, tech stack."""
    brief = parsed.where(F.col("doc.businessBrief").isNotNull()).select("doc_id", "doc.businessBrief.*")
    briefs = brief.select("doc_id", "headline", F.col("howItWorks").alias("how_it_works"),
                          F.col("problem").isNotNull().alias("has_problem"),
                          F.col("solution").isNotNull().alias("has_solution"))

    def claim(kind, ord_, c):
        return F.struct(F.lit(kind).alias("claim_kind"), ord_.cast("int").alias("ord"), c.alias("c"))

    single = F.filter(F.array(*[claim(k, F.lit(i), F.col(k)) for i, k in enumerate(SINGLE_CLAIMS)]),
                      lambda x: x["c"].isNotNull())
    many = F.transform("capabilities", lambda c, i: claim("capability", i + len(SINGLE_CLAIMS), c))
    one = brief.select("doc_id", F.explode(F.concat(single, F.coalesce(many, F.slice(single, 1, 0))))
                       .alias("x")).select("doc_id", "x.*")
    claims = one.select("doc_id", "claim_kind", "ord", F.col("c.label").alias("label"),
                        F.col("c.text").alias("text"),
                        F.col("c.factRefs").isNotNull().alias("has_fact_refs"), F.col("c.confidence").alias("confidence"),
                        F.col("c.interpretation").alias("interpretation"),
                        F.col("c.perspectiveRef").alias("perspective_ref"),
                        F.col("c.nodeRef").alias("node_ref"))
    refs = [one.select("doc_id", "ord", F.lit(kind).alias("ref_kind"),
                       F.posexplode(f"c.factRefs.{ids}").alias("ref_pos", "ref_id"))
            for kind, ids in (("file", "fileIds"), ("module", "moduleIds"))]
    tech = brief.select("doc_id", F.posexplode("techStack").alias("ord", "t")).select(
        "doc_id", "ord", F.col("t.name").alias("tech_name"), F.col("t.role").alias("role"),
        F.col("t.factRef").alias("fact_ref"))
    return briefs, claims, refs[0].unionByName(refs[1]), tech
