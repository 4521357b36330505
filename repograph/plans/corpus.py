"""Test corpora derived from the TPC-H-style tables (see FIXTURES.md).

* **D** - source repositories: parts are files, orders are commits, consecutive parts of
  an order import each other. File *text* is generated here; the operators parse it.
* **M** - manifests (requirements.txt, package.json, pyproject.toml) from ``supplier``.
* **N** - narrative tables from ``orders`` / ``lineitem`` / ``customer``.

Operators never know about TPC-H: they receive the generic tables built here.
Everything is a DataFrame transformation; nothing is collected.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repograph.functions.text import detect_language
from repograph.operators.ids import positional_ids

SRC_TYPES = ["economy", "small", "large"]
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'+00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PART_BYTES = 1 << 19          # stored bytes of a table that one shuffle partition takes


def spread(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions that grow in number, not in size, with the
    stored bytes of ``source``: a task's sorts and aggregates stay bounded whatever number of
    shuffle partitions the session has."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return df.repartition(min(n, 1 << 15), *keys)


# ---------------------------------------------------------------- D: repositories
def _layout(key: str, p_type: str, p_brand: str) -> dict[str, F.Column]:
    """Layout attributes of part-files from the columns of ``part``."""
    k, ptype = F.col(key), F.lower(p_type)
    e = F.expr(f"({key} div 4) % 8")
    root = F.when(ptype.isin(*SRC_TYPES), F.lit("src/")).otherwise(F.lit(""))
    pkg = F.concat(F.lit("pkg_"), ptype)
    bdir = F.concat(F.lit("b"), F.regexp_extract(p_brand, r"(\d+)$", 1))
    ext = (F.when(e <= 4, ".py").when(e == 5, ".js").when(e == 6, ".ts").otherwise(".md"))
    folder = F.concat(root, pkg, F.lit("/"), bdir)
    return {"ptype": ptype, "root": root, "pkg": pkg, "bdir": bdir, "ext": ext,
            "repo_id": F.concat(F.lit("repo"), k % 4), "dir": folder,
            "path": F.concat(folder, F.lit("/m"), k, ext),
            "modname": F.concat(pkg, F.lit("."), bdir, F.lit(".m"), k)}


def d_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part-file with its layout attributes."""
    layout = _layout("p_partkey", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"), "p_size", *[c.alias(n) for n, c in layout.items()])


def _repo(key: str) -> F.Column:
    return F.concat(F.lit("repo"), F.col(key) % 4)


def d_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (repo_id, commit, part) with the commit date, dealt by commit."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("partkey"))
    li = spread(li, li, "commit_id").distinct()
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("committed_ts"))
    return li.join(orders, "commit_id").withColumn("repo_id", _repo("partkey"))


def d_import_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (f, t), dealt by t: consecutive parts of a commit in a repository, direction by
    key parity."""
    t = d_touches(spark, sf_dir).select("commit_id", (F.col("partkey") % 4).alias("repo"), "partkey")
    w = Window.partitionBy("commit_id", "repo").orderBy("partkey")
    nxt = t.withColumn("nxt", F.lead("partkey").over(w)).where(F.col("nxt").isNotNull())
    even = F.col("commit_id") % 2 == 0
    pairs = nxt.select(F.when(even, F.col("partkey")).otherwise(F.col("nxt")).alias("f"),
                       F.when(even, F.col("nxt")).otherwise(F.col("partkey")).alias("t"))
    source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return spread(pairs, source, "t").distinct()


def _import_line() -> F.Column:
    f, t = F.col("f"), F.col("t")
    t_py = F.col("t_ext") == ".py"
    abs_from = F.concat(F.lit("from "), "t_modname", F.lit(" import thing"))
    plain = F.concat(F.lit("import "), "t_modname")
    rel = F.concat(F.lit("from .."), "t_bdir", F.lit(".m"), t, F.lit(" import thing"))
    k3 = (f + t) % 3
    py_line = F.when(
        t_py,
        F.when(k3 == 0, abs_from).when(k3 == 1, plain)
        .when(F.col("f_ptype") == F.col("t_ptype"), rel).otherwise(abs_from)
    ).otherwise(F.concat(F.lit("import ext_lib_"), t % 10))
    up = F.when(F.col("f_dir") == F.col("t_dir"), F.lit("./")).otherwise(
        F.concat(F.repeat(F.lit("../"), F.size(F.split("f_dir", "/"))), "t_dir", F.lit("/")))
    spec = F.concat(up, F.lit("m"), t, F.when(F.col("t_ext") == ".md", F.lit(".md"))
                    .otherwise(F.lit("")))
    req = f % 5 == 0
    js_target = F.when(req, F.concat(F.lit("const m"), t, F.lit(" = require('"), spec,
                                     F.lit("');"))).otherwise(
        F.concat(F.lit("import { m"), t, F.lit(" } from '"), spec, F.lit("';")))
    js_react = F.when(req, F.lit("const React = require('react');")).otherwise(
        F.lit("import React from 'react';"))
    js_line = F.when(t_py, js_react).otherwise(js_target)
    return (F.when(F.col("f_ext") == ".py", py_line)
            .when(F.col("f_ext").isin(".js", ".ts"), js_line)
            .otherwise(F.concat(F.lit("Related to m"), t, F.lit("."))))


def d_import_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, t, text), dealt by f: the generated line of f that refers to t. Pairs meet the stored
    columns of both parts; what is derived from them is never shuffled."""
    part = table(spark, sf_dir, "part")
    tp = part.select(F.col("p_partkey").alias("t"), F.col("p_type").alias("_t_type"),
                     F.col("p_brand").alias("_t_brand"))
    fp = part.select(F.col("p_partkey").alias("f"), F.col("p_type").alias("_f_type"),
                     F.col("p_brand").alias("_f_brand"))
    source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = spread(d_import_pairs(spark, sf_dir).join(tp, "t"), source, "f").join(fp, "f")
    of = {end: _layout(end, f"_{end}_type", f"_{end}_brand") for end in "ft"}
    pairs = pairs.select("f", "t", *[of["f"][c].alias(f"f_{c}") for c in ("ext", "ptype", "dir")],
                         *[of["t"][c].alias(f"t_{c}") for c in ("ext", "ptype", "dir", "bdir", "modname")])
    return pairs.select("f", "t", _import_line().alias("text"))


WEB_DIRECT = ["app = FastAPI()"]
WEB_FACTORY = ["def create_app():", "    return Flask(__name__)", "", "application = create_app()"]


def d_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(repo_id, path, content) for D: part files plus package ``__init__.py``."""
    parts = d_parts(spark, sf_dir)
    lines = (d_import_lines(spark, sf_dir)
             .groupBy(F.col("f").alias("partkey"))
             .agg(F.array_sort(F.collect_list(F.struct("t", "text"))).alias("ls"))
             .select("partkey", F.transform("ls", lambda x: x["text"]).alias("body")))
    k = F.col("partkey")
    header = (F.when(F.col("ext") == ".py", F.concat(F.lit("# m"), k, F.lit(" module")))
              .when(F.col("ext").isin(".js", ".ts"), F.concat(F.lit("// m"), k, F.lit(" module")))
              .otherwise(F.concat(F.lit("# Notes on m"), k)))
    is_py = F.col("ext") == ".py"
    web = (F.when(is_py & (k % 97 == 0), F.array(*[F.lit(x) for x in WEB_DIRECT]))
           .when(is_py & (k % 89 == 0), F.array(*[F.lit(x) for x in WEB_FACTORY])))
    part_files = (parts.join(lines, "partkey", "left")
                  .select("repo_id", "path",
                          F.concat(F.concat_ws("\n", header, "body", web), F.lit("\n"))
                          .alias("content")))
    pkg_inits = parts.select("repo_id", "root", "pkg").distinct().select(
        "repo_id", F.concat("root", "pkg", F.lit("/__init__.py")).alias("path"),
        F.concat(F.lit('"""Package '), "pkg", F.lit('."""\n')).alias("content"))
    brand_inits = parts.select("repo_id", "dir", "bdir").distinct().select(
        "repo_id", F.concat("dir", F.lit("/__init__.py")).alias("path"),
        F.concat(F.lit('"""Package '), "bdir", F.lit('."""\n')).alias("content"))
    return part_files.unionByName(pkg_inits).unionByName(brand_inits)


def d_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commits(repo_id, commit_id, seq, committed_at, path); seq 1 = newest per repo."""
    touches = d_touches(spark, sf_dir)
    heads = touches.select("repo_id", "commit_id", "committed_ts").distinct()
    heads = positional_ids(heads, ["repo_id"],
                           [F.col("committed_ts").desc(), F.col("commit_id").desc()],
                           "seq")
    paths = d_parts(spark, sf_dir).select("partkey", "path")
    numbered = touches.join(heads.drop("committed_ts"), ["repo_id", "commit_id"])
    source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (spread(numbered, source, "partkey").join(paths, "partkey")
            .select("repo_id", "commit_id", "seq",
                    F.date_format("committed_ts", ISO_FORMAT).alias("committed_at"),
                    "committed_ts", "path"))


class Repos:
    """Files and commits, each built and stored when it is first read."""

    def __init__(self, files: Callable[[], DataFrame], commits: Callable[[], DataFrame]):
        self._files, self._commits = files, commits

    @cached_property
    def files(self) -> DataFrame:
        return self._files()

    @cached_property
    def commits(self) -> DataFrame:
        return self._commits()


_MATERIALIZED: dict[tuple, DataFrame] = {}


def materialize(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Write a derived table once per session as parquet in the shared checkpoint
    folder and read it back - the stand-in for the stored ``files``/``commits`` tables
    a deployment reads (parquet, so later scans prune columns and push filters)."""
    import uuid

    from repograph.session import ensure_checkpoint_dir
    k = (spark.sparkContext.applicationId, *key)
    if k not in _MATERIALIZED:
        path = ensure_checkpoint_dir(spark).rstrip("/") + f"/table-{key[0]}-{uuid.uuid4().hex}"
        build().write.mode("overwrite").parquet(path)
        _MATERIALIZED[k] = spark.read.parquet(path)
    return _MATERIALIZED[k]


def corpus_d(spark: SparkSession, sf_dir: str) -> Repos:
    """D's files and commits, generated once per session and stored as parquet."""
    return Repos(lambda: materialize(spark, ("d_files", sf_dir), lambda: d_files(spark, sf_dir)),
                 lambda: materialize(spark, ("d_commits", sf_dir), lambda: d_commits(spark, sf_dir)))


# ---------------------------------------------------------------- M: manifests
def _repo_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repo: the first .js and .ts file (start / main), and the first two root-layout
    Python modules (script targets)."""
    p = d_parts(spark, sf_dir)
    k = F.col("partkey")
    root_py = (F.col("ext") == ".py") & (F.col("root") == "")
    return p.groupBy("repo_id").agg(
        F.min_by("path", F.when(F.col("ext") == ".js", k)).alias("start_path"),
        F.min_by("path", F.when(F.col("ext") == ".ts", k)).alias("main_path"),
        F.min_by("modname", F.when(root_py, k)).alias("mod1"),
        F.max_by("modname", F.when(root_py, k)).alias("mod2"))


def m_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("k"), "s_name", "s_nationkey",
        F.concat(F.lit("repo"), F.col("s_suppkey") % 4).alias("repo_id"),
        F.concat(F.lit("lib-"), F.col("s_suppkey")).alias("name"))


REQ_HEAD = ["# pinned requirements", "", "-r base.txt"]
REQ_TAIL = [f"ext_lib_{i}" for i in range(5)]


def _joined(lines) -> F.Column:
    return F.transform(F.array_sort(lines), lambda x: x["v"])


def m_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root manifests per repo: requirements.txt, package.json, pyproject.toml."""
    s = m_suppliers(spark, sf_dir)
    k = F.col("k")
    req_line = (F.when(k % 3 == 0, F.concat("name", F.lit("==1."), k))
                .when(k % 3 == 1, F.concat("name", F.lit(">=2.0"))).otherwise(F.col("name")))
    npm_ver = (F.when(k % 7 == 0, k.cast("string"))
               .when(k % 11 == 0, F.lit('""'))
               .when(k % 2 == 1, F.concat(F.lit('"^1.'), k, F.lit('"')))
               .otherwise(F.concat(F.lit('"~2.'), k, F.lit('"'))))
    npm_entry = F.concat(F.lit('"'), "name", F.lit('": '), npm_ver)
    pep_line = F.when(k % 10 == 0, F.concat(F.lit('    "'), "name", F.lit('==1.0",'))).otherwise(
        F.concat(F.lit('    "'), "name", F.lit('>=1.0",')))
    poe_line = F.when(k % 2 == 1, F.concat("name", F.lit(' = "^'), k, F.lit('.0"'))).otherwise(
        F.concat("name", F.lit(' = { version = "^'), k, F.lit('.1", optional = true }')))
    agg = s.groupBy("repo_id").agg(
        _joined(F.collect_list(F.struct(k.alias("o"), req_line.alias("v")))).alias("req"),
        _joined(F.collect_list(F.when(k % 2 == 1, F.struct(k.alias("o"), npm_entry.alias("v")))))
        .alias("deps"),
        _joined(F.collect_list(F.when(k % 2 == 0, F.struct(k.alias("o"), npm_entry.alias("v")))))
        .alias("dev"),
        _joined(F.collect_list(F.when(k % 5 == 0, F.struct(k.alias("o"), pep_line.alias("v")))))
        .alias("pep"),
        _joined(F.collect_list(F.when(k % 5 != 0, F.struct(k.alias("o"), poe_line.alias("v")))))
        .alias("poe"),
        F.min(F.when(k % 5 == 0, F.col("name"))).alias("repeated"))
    a = agg.join(_repo_picks(spark, sf_dir), "repo_id")
    lit_arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    req = F.concat(F.concat_ws("\n", lit_arr(REQ_HEAD), "req", lit_arr(REQ_TAIL)), F.lit("\n"))
    serve = F.when(F.col("repo_id").isin("repo0", "repo2"), F.lit(" --serve")).otherwise(F.lit(""))
    start = F.concat(F.lit("node "), "start_path", serve)
    pkg = F.concat(
        F.lit('{"name": "'), "repo_id", F.lit('", "main": "./'), "main_path",
        F.lit('", "scripts": {"start": "'), start, F.lit('"}, "dependencies": {"react": "18.2.0"'),
        F.when(F.size("deps") > 0, F.concat(F.lit(", "), F.array_join("deps", ", ")))
        .otherwise(F.lit("")),
        F.lit('}, "devDependencies": {'), F.array_join("dev", ", "), F.lit("}}\n"))
    poetry_target = F.when(F.col("repo_id").isin("repo1", "repo3"), F.col("mod2")).otherwise(
        F.col("mod1"))
    pyproject = F.concat_ws(
        "\n",
        F.lit("[project]"), F.concat(F.lit('name = "'), "repo_id", F.lit('"')),
        F.lit("dependencies = ["), F.concat_ws("\n", "pep"), F.lit("]"), F.lit(""),
        F.lit("[project.scripts]"),
        F.concat("repo_id", F.lit('-cli = "'), "mod1", F.lit(':main"')), F.lit(""),
        F.lit("[tool.poetry.dependencies]"), F.lit('python = "^3.9"'), F.concat_ws("\n", "poe"),
        F.when(F.col("repeated").isNotNull(), F.concat("repeated", F.lit(' = "^9.9"'))),
        F.lit(""), F.lit("[tool.poetry.group.dev.dependencies]"), F.lit('pytest = "^8.0"'),
        F.lit(""), F.lit("[tool.poetry.scripts]"),
        F.concat("repo_id", F.lit(' = "'), poetry_target, F.lit(':run"')), F.lit(""))
    pyproject = F.regexp_replace(pyproject, "\n\n+(?=\\])", "\n")
    return (a.select("repo_id", F.lit("requirements.txt").alias("path"), req.alias("content"))
            .unionByName(a.select("repo_id", F.lit("package.json").alias("path"),
                                  pkg.alias("content")))
            .unionByName(a.select("repo_id", F.lit("pyproject.toml").alias("path"),
                                  pyproject.alias("content"))))


def tech_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tech-stack items: one per supplier; factRef unknown when k % 9 = 0."""
    s = m_suppliers(spark, sf_dir)
    return s.select("repo_id", F.col("k").alias("ord"), F.col("s_name").alias("tech_name"),
                    F.concat(F.lit("role-"), F.col("s_nationkey") % 4).alias("role"),
                    F.when(F.col("k") % 9 == 0, F.concat(F.lit("nolib-"), "k"))
                    .otherwise(F.col("name")).alias("fact_ref"))


def corpus_dm(spark: SparkSession, sf_dir: str) -> Repos:
    """D with the manifests of M at each repo root."""
    d = corpus_d(spark, sf_dir)
    return Repos(lambda: d.files.unionByName(materialize(spark, ("m_files", sf_dir),
                                                         lambda: m_files(spark, sf_dir))),
                 lambda: d.commits)


# ---------------------------------------------------------------- N: narrative
N_REPO = "repo0"
KINDS = ["structural", "functional", "dataflow", "runtime", "domain"]
CLAIM_KINDS = ["problem", "solution", "audience", "capability"]


@dataclass
class Narrative:
    perspectives: DataFrame
    nodes: DataFrame
    node_refs: DataFrame
    relationships: DataFrame
    rel_edge_refs: DataFrame
    node_children: DataFrame
    brief_claims: DataFrame
    brief_refs: DataFrame
    briefs: DataFrame
    narratives: DataFrame


@dataclass
class NFacts:
    repos: DataFrame
    files: DataFrame
    modules: DataFrame
    module_files: DataFrame
    edges: DataFrame
    present: DataFrame


class Stored:
    """Tables of a corpus by name, each built and stored when it is first read."""

    def __init__(self, spark: SparkSession, prefix: str, sf_dir: str, names, build):
        self._spark, self._prefix, self._sf_dir, self._names = spark, prefix, sf_dir, frozenset(names)
        self._build = build

    @cached_property
    def _plans(self):
        return self._build(self._spark, self._sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._names:
            raise AttributeError(name)
        return materialize(self._spark, (self._prefix + name, self._sf_dir),
                           lambda: getattr(self._plans, name))


def _conf(c) -> F.Column:
    return F.when(c % 3 == 0, F.lit("low")).when(c % 3 == 1, F.lit("medium")).otherwise(
        F.lit("high"))


def _kind(pid) -> F.Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]),
                        F.regexp_extract(pid, r"^(\d+)", 1).cast("int"))


def n_facts(spark: SparkSession, sf_dir: str) -> Stored:
    """The narrative's facts (``NFacts``), stored once per session (stored input)."""
    return Stored(spark, "n_facts_", sf_dir, NFacts.__dataclass_fields__, _build_n_facts)


def _build_n_facts(spark: SparkSession, sf_dir: str) -> NFacts:
    """Facts the narrative is checked against: parts with p_size > 3 are files (id
    ``f%04d`` of the part key); modules ``pkg_<type>`` except promo; fact edges are the
    even order keys; present paths are parts whose key is not a multiple of 3."""
    p = d_parts(spark, sf_dir).where(F.col("p_size") > 3)
    repo = F.lit(N_REPO).alias("repo_id")
    files = p.select(repo, F.format_string("f%04d", "partkey").alias("file_id"), "path",
                     detect_language("path").alias("lang"))
    mf = p.where(F.col("ptype") != "promo").select(
        repo, F.col("pkg").alias("module_id"), F.format_string("f%04d", "partkey").alias("file_id"),
        F.concat("root", "pkg").alias("module_path"))
    modules = mf.select("repo_id", "module_id", F.col("module_path").alias("path")).distinct()
    o = table(spark, sf_dir, "orders")
    edges = o.where(F.col("o_orderkey") % 2 == 0).select(
        repo, F.concat(F.lit("e"), "o_orderkey").alias("edge_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("unresolved")).otherwise(F.lit("resolved"))
        .alias("resolution"))
    present = d_parts(spark, sf_dir).where(F.col("partkey") % 3 != 0).select(repo, "path")
    repos = spark.range(1).select(repo, F.lit("head0").alias("head_commit"))
    return NFacts(repos, files, modules, mf, edges, present)


def corpus_n(spark: SparkSession, sf_dir: str) -> Stored:
    """The narrative tables (``Narrative``), stored once per session (stored input)."""
    return Stored(spark, "n_", sf_dir, Narrative.__dataclass_fields__, _build_n)


def _build_n(spark: SparkSession, sf_dir: str) -> Narrative:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    c = F.col("o_custkey")
    repo = F.lit(N_REPO).alias("repo_id")
    pid = F.col("o_orderpriority").alias("perspective_id")
    nodes = o.select(repo, pid, F.col("o_orderkey").alias("ord"),
                     F.concat(F.lit("n"), c).alias("node_id"), (c % 3).cast("int").alias("tier"),
                     F.when(F.col("o_orderkey") % 11 == 0, F.lit("")).otherwise(F.concat(
                         F.lit("Customer "), c, F.lit("/"), F.col("o_orderkey") % 3)).alias("label"),
                     F.when(c % 7 == 0, F.lit("")).otherwise(
                         F.concat(F.lit("Order "), "o_orderkey")).alias("description"),
                     _conf(c).alias("confidence"), (c % 2 == 0).alias("interpretation"))
    prio = o.select("o_orderpriority").distinct()
    perspectives = prio.select(
        repo, F.regexp_extract("o_orderpriority", r"^(\d+)", 1).cast("int").alias("ord"),
        pid, F.col("o_orderpriority").alias("name"),
        _kind(F.col("o_orderpriority")).alias("kind"), F.concat(F.lit("Lens "), "o_orderpriority").alias("description"))
    lines = spread(li, li, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    ptype = d_parts(spark, sf_dir).select(F.col("partkey").alias("l_partkey"), "pkg")
    file_refs = lines.select(repo, pid, F.col("o_orderkey").alias("ord"),
                             F.concat(F.lit("n"), c).alias("node_id"),
                             F.lit("file").alias("ref_kind"),
                             F.format_string("f%04d", "l_partkey").alias("ref_id"),
                             F.row_number().over(Window.partitionBy("o_orderkey").orderBy(
                                 "l_linenumber", "l_partkey")).cast("bigint").alias("ref_pos"))
    mod_refs = (lines.where(F.col("o_orderkey") % 10 == 0).join(ptype, "l_partkey")
                .select(repo, pid, F.col("o_orderkey").alias("ord"),
                        F.concat(F.lit("n"), c).alias("node_id"), F.lit("module").alias("ref_kind"),
                        F.col("pkg").alias("ref_id")).distinct()
                .withColumn("ref_pos", F.lit(0).cast("bigint")))
    node_refs = file_refs.unionByName(mod_refs)
    rel_ord = (F.col("o_orderkey") * 2 + 1).alias("ord")      # unlike any node's position
    relationships = o.select(repo, pid, rel_ord,
                             F.concat(F.lit("n"), c).alias("from_id"),
                             F.concat(F.lit("n"), c + 1).alias("to_id"),
                             F.lit("next").alias("label"), _conf(c).alias("confidence"))
    rel_edge_refs = o.where(F.col("o_orderkey") % 17 != 0).select(
        repo, pid, rel_ord, F.lit(0).alias("ref_pos"),
        F.concat(F.lit("e"), "o_orderkey").alias("edge_id"))
    heads = o.where(c % 5 != 0).select(repo, pid, c).distinct()
    node_children = heads.select(
        "repo_id", "perspective_id", F.concat(F.lit("n"), c).alias("node_id"),
        F.posexplode(F.array(F.concat(F.lit("n"), c + 1), F.concat(F.lit("n"), c + 2)))
        .alias("pos", "child_id"))
    # N-brief: every order is a claim.
    fo = o
    where = F.element_at(F.array(*[F.lit(x) for x in CLAIM_KINDS]), (c % 4 + 1).cast("int"))
    pref = (F.when(c % 13 == 0, F.lit(None).cast("string"))
            .when(c % 11 == 0, F.lit("none")).otherwise(F.col("o_orderpriority")))
    is_cap = where == "capability"
    brief_claims = fo.select(
        repo, F.col("o_orderpriority").alias("brief_id"), where.alias("claim_kind"),
        F.col("o_orderkey").alias("ord"), F.concat(F.lit("cap-"), c).alias("label"),
        F.when(c % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Order "), "o_orderkey"))
        .alias("text"),
        _conf(c).alias("confidence"), (c % 2 == 0).alias("interpretation"),
        F.when(is_cap, pref).alias("perspective_ref"),
        F.when(is_cap, F.concat(F.lit("n"), c + 1)).alias("node_ref"))
    brief_refs = (node_refs.join(fo.select(F.col("o_orderkey").alias("ord"),
                                           F.col("o_orderpriority").alias("brief_id")), "ord")
                  .select("repo_id", "brief_id", "ord", "ref_kind", "ref_id", "ref_pos"))
    briefs = prio.select(repo, F.col("o_orderpriority").alias("brief_id"),
                         F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(
                             F.concat(F.lit("Brief "), "o_orderpriority")).alias("headline"))
    narratives = prio.select(
        repo, F.col("o_orderpriority").alias("narrative_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("abc123"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit(None).cast("string"))
        .otherwise(F.lit("head0")).alias("based_on_facts_commit"))
    return Narrative(perspectives, nodes, node_refs, relationships, rel_edge_refs,
                     node_children, brief_claims, brief_refs, briefs, narratives)


#: Customers whose orders share a narrative document: documents grow in number, not in size.
DOC_CUSTOMERS = 40


def _doc_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with a priority: (perspective_id, c, ord, parts, pkgs, n_rows, n_ids): its
    line's parts in order, the packages of a tenth of the orders, and how many orders and customers
    share its priority and key. Lines meet orders by key, as keys; nothing that is derived from
    them is shuffled here."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("perspective_id"), F.col("o_custkey").alias("c"),
        F.col("o_orderkey").alias("ord")).where(F.col("perspective_id").isNotNull())
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), "l_linenumber", "l_partkey")
    ptype = d_parts(spark, sf_dir).select(F.col("partkey").alias("l_partkey"), "pkg")
    of_order = F.col("ord").isNotNull()
    parts = spread(li.where(of_order), li, "ord").groupBy("ord").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
                    lambda x: x["l_partkey"]).alias("parts"))
    tenth = spread(li.where(F.col("ord") % 10 == 0).select("ord", "l_partkey"), li, "l_partkey")
    pkgs = spread(tenth.join(ptype, "l_partkey").select("ord", "pkg"), li, "ord").groupBy("ord").agg(
        F.transform(F.sort_array(F.collect_set(F.struct("pkg"))), lambda x: x["pkg"]).alias("pkgs"))
    same = spread(o.where(of_order), li, "ord").groupBy("ord", "perspective_id").agg(
        F.collect_list(F.struct("c")).alias("_same"))
    keyed = (same.join(parts, "ord", "left").join(pkgs, "ord", "left")
             .select("perspective_id", "ord", "parts", "pkgs", F.size("_same").alias("n_rows"),
                     F.size(F.array_distinct("_same")).alias("n_ids"), F.inline("_same")))
    return keyed.unionByName(o.where(~of_order), allowMissingColumns=True)


def n_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N serialized as narrative JSON documents, one per (priority, block of customers):
    v1 shape for 5-LOW, v2 (one perspective, a business brief) otherwise. Each document is
    a bounded slice; nothing is gathered per repository.

    The rows are those of ``corpus_n``, derived from the orders of a document where they meet:
    an order travels once, as keys, for its node, its relationship and its claim."""
    c, order, pid = F.col("c"), F.col("ord"), F.col("perspective_id")
    source = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    block = F.floor(F.regexp_extract(F.concat(F.lit("n"), c), r"^n(\d+)$", 1).cast("bigint") / DOC_CUSTOMERS)
    orders = spread(_doc_orders(spark, sf_dir).withColumn("block", block), source, "perspective_id", "block")
    empty = F.array().cast("array<string>")
    node_id = lambda k: F.concat(F.lit("n"), k)
    times = lambda xs, n, text: F.flatten(F.transform(xs, lambda x: F.array_repeat(text(x), n)))
    refs = F.struct(
        F.coalesce(times(F.col("pkgs"), F.col("n_ids"), lambda x: x), empty).alias("moduleIds"),
        F.coalesce(times(F.col("parts"), F.col("n_rows"), lambda x: F.format_string("f%04d", x)), empty)
        .alias("fileIds"))
    text = F.when(c % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Order "), order))
    even = (c % 2 == 0).alias("interpretation")
    node = F.struct(
        node_id(c).alias("id"), (c % 3).cast("int").alias("tier"),
        F.when(order % 11 == 0, F.lit("")).otherwise(F.concat(
            F.lit("Customer "), c, F.lit("/"), order % 3)).alias("label"),
        text.alias("description"), F.col("refs").alias("factRefs"),
        F.when(c % 5 != 0, F.array(node_id(c + 1), node_id(c + 2))).otherwise(empty).alias("children"),
        _conf(c).alias("confidence"), even)
    rel = F.struct(
        node_id(c).alias("from"), node_id(c + 1).alias("to"), F.lit("next").alias("label"),
        F.when(order % 17 != 0, F.array_repeat(F.concat(F.lit("e"), order), F.col("n_rows")))
        .otherwise(empty).alias("factEdgeIds"), _conf(c).alias("confidence"))
    is_cap = F.col("kind") == "capability"
    pref = (F.when(c % 13 == 0, F.lit(None).cast("string"))
            .when(c % 11 == 0, F.lit("none")).otherwise(pid))
    claim = F.struct(
        F.when(is_cap, F.concat(F.lit("cap-"), c)).alias("label"), text.alias("text"),
        F.col("refs").alias("factRefs"), _conf(c).alias("confidence"), even,
        F.when(is_cap, pref).alias("perspectiveRef"), F.when(is_cap, node_id(c + 1)).alias("nodeRef"))
    where = F.element_at(F.array(*[F.lit(x) for x in CLAIM_KINDS]), (c % 4 + 1).cast("int"))
    rows = (orders.withColumns({"refs": refs, "kind": where})
            .select("perspective_id", "block", "ord", "kind", node.alias("node"), rel.alias("rel"),
                    claim.alias("claim")))
    in_order = lambda what, x: F.transform(F.sort_array(F.collect_list(what)), lambda y: y[x])
    of_kind = lambda k: F.when(F.col("kind") == k, F.struct("ord", "claim"))
    d = rows.groupBy("perspective_id", "block").agg(
        in_order(F.struct("ord", "node"), "node").alias("nodes"),
        in_order(F.struct("ord", "rel"), "rel").alias("relationships"),
        *[F.min(of_kind(k))["claim"].alias(k) for k in CLAIM_KINDS[:3]],
        in_order(of_kind("capability"), "claim").alias("capabilities"))
    # Orders without a customer belong to no document: their nodes and relationships stay apart.
    sides = F.when(F.col("block").isNull(), F.array(F.lit("nodes"), F.lit("relationships"))).otherwise(
        F.array(F.lit("")))
    d = d.withColumn("side", F.explode(sides))
    brief = F.when(F.col("block").isNotNull(), F.struct(
        F.concat(F.lit("Brief "), pid).alias("headline"), *CLAIM_KINDS[:3], "capabilities",
        F.array(F.struct(F.lit("Flask").alias("name"), F.lit("web").alias("role"),
                         F.lit("flask").alias("factRef"))).alias("techStack")))
    tiers = F.array(F.struct(F.lit(0).alias("level"), F.lit("Top").alias("name")))
    nodes_c, rels_c = (F.when(F.col("side") == other, F.array().cast(d.schema[x].dataType)).otherwise(F.col(x))
                       for x, other in (("nodes", "relationships"), ("relationships", "nodes")))
    v2 = F.to_json(F.struct(
        F.lit("2.0").alias("schemaVersion"), F.lit("head0").alias("basedOnFactsCommit"),
        F.array(F.struct(pid.alias("id"), pid.alias("name"), _kind(pid).alias("kind"),
                         F.concat(F.lit("Lens "), pid).alias("description"),
                         tiers.alias("tiers"), nodes_c.alias("nodes"),
                         rels_c.alias("relationships"))).alias("perspectives"),
        brief.alias("businessBrief"), F.array(F.lit("Why?")).alias("openQuestions")))
    v1 = F.to_json(F.struct(
        F.lit("1.0").alias("schemaVersion"), F.lit("head0").alias("basedOnFactsCommit"),
        tiers.alias("tiers"), nodes_c.alias("nodes"), rels_c.alias("relationships"),
        empty.alias("openQuestions")))
    return d.select(F.concat(pid, F.lit("#"), F.col("block").cast("string")).alias("doc_id"),
                    F.when(pid == "5-LOW", v1).otherwise(v2).alias("json"))


def m_more_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """go.mod, Gemfile, Cargo.toml and composer.json per repo from ``supplier``
    (dependency ``lib-<k>`` / ``example.org/lib<k>``, version ``1.<k>.0``)."""
    s = m_suppliers(spark, sf_dir)
    k = F.col("k")
    ver = F.concat(F.lit("1."), k, F.lit(".0"))
    go_line = F.concat(F.lit("\texample.org/lib"), k, F.lit(" v"), ver)
    gem_line = F.when(k % 2 == 0, F.concat(F.lit("gem '"), "name", F.lit("', '"), ver, F.lit("'")))\
        .otherwise(F.concat(F.lit("gem \""), "name", F.lit("\"")))
    cargo_line = F.when(k % 2 == 0, F.concat("name", F.lit(' = "'), ver, F.lit('"'))).otherwise(
        F.concat("name", F.lit(' = { version = "'), ver, F.lit('", features = ["x"] }')))
    comp_entry = F.concat(F.lit('"vendor/'), "name", F.lit('": "^'), ver, F.lit('"'))
    a = s.groupBy("repo_id").agg(
        _joined(F.collect_list(F.struct(k.alias("o"), go_line.alias("v")))).alias("go"),
        _joined(F.collect_list(F.struct(k.alias("o"), gem_line.alias("v")))).alias("gem"),
        _joined(F.collect_list(F.struct(k.alias("o"), cargo_line.alias("v")))).alias("cargo"),
        _joined(F.collect_list(F.struct(k.alias("o"), comp_entry.alias("v")))).alias("comp"))
    go = F.concat(F.lit("module example.org/"), "repo_id", F.lit("\n\ngo 1.21\n\nrequire (\n"),
                  F.array_join("go", "\n"), F.lit("\n)\n"))
    gem = F.concat(F.lit("source 'https://rubygems.org'\n"), F.array_join("gem", "\n"), F.lit("\n"))
    cargo = F.concat(F.lit('[package]\nname = "'), "repo_id", F.lit('"\n\n[dependencies]\n'),
                     F.array_join("cargo", "\n"), F.lit("\n"))
    comp = F.concat(F.lit('{"require": {"php": ">=8.1", '), F.array_join("comp", ", "),
                    F.lit("}}"))
    out = None
    for path, col in [("go.mod", go), ("Gemfile", gem), ("Cargo.toml", cargo),
                      ("composer.json", comp)]:
        part = a.select("repo_id", F.lit(path).alias("path"), col.alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


def m_nested_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pom.xml, App.csproj with Directory.Packages.props, setup.cfg and build.gradle per repo from
    ``supplier``: k % 3 decides whether a version is written, a property, or managed elsewhere."""
    s = m_suppliers(spark, sf_dir)
    k = F.col("k")
    ver, third = F.concat(F.lit("1."), k, F.lit(".0")), k % 3
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    cells = {
        "pom_props": F.when(third == 1, put("<v", k, ">${base", k, "}</v", k, "><base", k, ">", ver, "</base", k, ">")),
        "pom": put("<dependency><groupId>org.x</groupId><artifactId>", F.col("name"), "</artifactId>",
                   F.when(third == 0, put("<version>", ver, "</version>"))
                   .when(third == 1, put("<version>${v", k, "}</version>")).otherwise(F.lit("")), "</dependency>"),
        "pom_managed": F.when(third == 2, put("<dependency><groupId>org.x</groupId><artifactId>", F.col("name"),
                                              "</artifactId><version>", ver, "</version></dependency>")),
        "net_props": F.when(third == 1, put("<V", k, ">", ver, "</V", k, ">")),
        "net": put('<PackageReference Include="', F.col("name"), '"',
                   F.when(third == 0, put(' Version="', ver, '"/>'))
                   .when(third == 1, put("><Version>$(V", k, ")</Version></PackageReference>")).otherwise(F.lit("/>"))),
        "net_central": F.when(third == 2, put('<PackageVersion Include="', F.col("name"), '" Version="', ver, '"/>')),
        "cfg": put("    ", F.col("name"), F.when(third == 0, put("==", ver)).otherwise(F.lit(">=1"))),
        "gradle_vars": F.when(third == 1, put("def v", k, " = '", ver, "'")),
        "gradle": put("    implementation ", F.when(third == 0, put("'org.x:", F.col("name"), ":", ver, "'"))
                      .when(third == 1, put('"org.x:', F.col("name"), ":${v", k, '}"'))
                      .otherwise(put("group: 'org.x', name: '", F.col("name"), "', version: '", ver, "'")))}
    a = s.groupBy("repo_id").agg(*[
        F.concat_ws("\n", _joined(F.collect_list(F.when(c.isNotNull(), F.struct(k.alias("o"), c.alias("v")))))).alias(n)
        for n, c in cells.items()])
    texts = {
        "pom.xml": put('<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0"><properties>', F.col("pom_props"),
                       "</properties><dependencyManagement><dependencies>", F.col("pom_managed"),
                       "</dependencies></dependencyManagement><dependencies>", F.col("pom"), "</dependencies></project>"),
        "App.csproj": put("<Project><PropertyGroup>", F.col("net_props"), "</PropertyGroup><ItemGroup>", F.col("net"),
                          "</ItemGroup></Project>"),
        "Directory.Packages.props": put("<Project><ItemGroup>", F.col("net_central"), "</ItemGroup></Project>"),
        "setup.cfg": put("[metadata]\nname = x\n\n[options]\npackages = find:\ninstall_requires =\n", F.col("cfg"),
                         "\npython_requires = >=3.9\n"),
        "build.gradle": put("plugins { id 'java' }\n", F.col("gradle_vars"), "\ndependencies {\n", F.col("gradle"), "\n}\n")}
    out = None
    for path, content in texts.items():
        part = a.select("repo_id", F.lit(path).alias("path"), content.alias("content"))
        out = part if out is None else out.unionByName(part)
    return out
