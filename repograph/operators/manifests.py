"""Declared dependencies and manifest entrypoints, from ROOT manifests only.

Input is the files table ``(repo_id, path, content)``; manifests are rows whose path is
exactly ``package.json``, ``pyproject.toml`` or ``requirements.txt``. Text is parsed with
Spark functions inside the manifest's row: JSON through ``try_parse_json``/``variant_get``,
TOML through ``functions.toml``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.operators.ids import positional_ids
from repograph.functions import text as T
from repograph.functions import toml as TM
from repograph.operators.imports import explode_lines
from repograph.operators.resolve import module_to_file
from repograph.session import store

MANIFESTS = ["package.json", "pyproject.toml", "requirements.txt"]
NODE_SCRIPT_SUFFIXES = (".js", ".mjs", ".cjs", ".ts")


def _place(*parts) -> F.Column:
    """Order of an item in its manifest: up to three numbers, compared one after another."""
    cols = [F.lit(p) if isinstance(p, int) else F.col(p) if isinstance(p, str) else p for p in parts]
    cols += [F.lit(0)] * (3 - len(cols))
    return F.struct(*[c.cast("bigint").alias(n) for c, n in zip(cols, "abc")]).alias("item_ord")


def manifest_rows(files: DataFrame) -> DataFrame:
    """Root manifests only (a nested package.json is not read)."""
    return files.where(F.col("path").isin(*MANIFESTS)).select("repo_id", "path", "content")


# ------------------------------------------------------------------ requirements.txt
def requirements_deps(files: DataFrame) -> DataFrame:
    """Trimmed lines, skipping blank, ``#`` and ``-`` lines; no dedupe."""
    req = manifest_rows(files).where(F.col("path") == "requirements.txt")
    lines = explode_lines(req, "content", ("repo_id",)).withColumn("s", T.py_strip("text"))
    lines = lines.where((F.col("s") != "") & ~F.col("s").startswith("#")
                        & ~F.col("s").startswith("-"))
    return (lines.select("repo_id", T.requirement_name("s").alias("name"),
                         T.requirement_version("s").alias("version"),
                         F.lit("pypi").alias("ecosystem"),
                         F.lit("requirements.txt").alias("manifest"),
                         F.lit(2).alias("src_rank"), _place("line_no"))
            .where(F.col("name") != ""))


# ------------------------------------------------------------------ package.json
def _package_json(files: DataFrame) -> DataFrame:
    pkg = manifest_rows(files).where(F.col("path") == "package.json")
    return pkg.select("repo_id", F.try_parse_json("content").alias("doc")).where(
        F.col("doc").isNotNull())


def npm_deps(files: DataFrame) -> DataFrame:
    """``dependencies`` then ``devDependencies``; a non-string or empty version is null;
    invalid JSON gives no rows."""
    doc = _package_json(files)
    parts = []
    for rank, section in enumerate(["dependencies", "devDependencies"]):
        m = F.try_variant_get("doc", f"$.{section}", "map<string,variant>")
        parts.append(doc.select("repo_id", F.lit(rank).alias("section"),
                                F.posexplode(m).alias("pos", "name", "val")))
    rows = parts[0].unionByName(parts[1])
    is_str = F.schema_of_variant("val") == "STRING"
    ver = F.variant_get("val", "$", "string")
    return rows.select("repo_id", "name",
                       F.when(is_str & (ver != ""), ver).alias("version"),
                       F.lit("npm").alias("ecosystem"), F.lit("package.json").alias("manifest"),
                       F.lit(0).alias("src_rank"), _place("section", "pos"))


def node_entrypoints(files: DataFrame, index: DataFrame) -> DataFrame:
    """scripts.start (else scripts.main): first whitespace token, leading '.'/'/' chars
    stripped, ending .js/.mjs/.cjs/.ts and present in the inventory; kind web when the
    command contains 'serv' (any case), else cli. ``main`` -> lib unless that file is
    already an entry of this manifest."""
    doc = _package_json(files)
    start = F.try_variant_get("doc", "$.scripts.start", "string")
    main_s = F.try_variant_get("doc", "$.scripts.main", "string")
    start_is_str = F.schema_of_variant(F.try_variant_get("doc", "$.scripts.start", "variant")) \
        == "STRING"
    cmd = F.when(start_is_str & (start != ""), start).otherwise(
        F.when(F.schema_of_variant(F.try_variant_get("doc", "$.scripts.main", "variant"))
               == "STRING", main_s))
    main = F.when(F.schema_of_variant(F.try_variant_get("doc", "$.main", "variant")) == "STRING",
                  F.try_variant_get("doc", "$.main", "string"))
    base = doc.select("repo_id", cmd.alias("cmd"), main.alias("main"))
    toks = (base.where(F.col("cmd").isNotNull())
            .select("repo_id", "cmd", F.posexplode(F.split(T.py_strip("cmd"), r"(?U)\s+"))
                    .alias("pos", "tok"))
            .withColumn("path", T.lstrip_chars(T.py_strip("tok"), "./"))
            .where(F.col("path").rlike(
                "(" + "|".join("\\" + x for x in NODE_SCRIPT_SUFFIXES) + ")$")))
    ix = index.select("repo_id", "path", "file_id")
    start_hit = (toks.join(ix, ["repo_id", "path"])
                 .groupBy("repo_id", "cmd").agg(F.min_by("file_id", "pos").alias("file_id"))
                 .select("repo_id", "file_id",
                         F.when(F.lower("cmd").contains("serv"), F.lit("web"))
                         .otherwise(F.lit("cli")).alias("kind"),
                         F.concat(F.lit("package.json scripts.start: "), "cmd").alias("evidence"),
                         F.lit(0).alias("ord")))
    main_hit = (base.where(F.col("main").isNotNull())
                .withColumn("path", T.lstrip_chars("main", "./"))
                .join(ix, ["repo_id", "path"])
                .join(start_hit.select("repo_id", "file_id"), ["repo_id", "file_id"], "left_anti")
                .select("repo_id", "file_id", F.lit("lib").alias("kind"),
                        F.concat(F.lit("package.json main: "), "main").alias("evidence"),
                        F.lit(1).alias("ord")))
    return start_hit.unionByName(main_hit).withColumn("manifest", F.lit("package.json"))


# ------------------------------------------------------------------ pyproject.toml
def toml_rows(files: DataFrame, manifest: str = "pyproject.toml") -> DataFrame:
    """(repo_id, doc, entries): every pair of a root TOML file with its full path, read inside the
    row; elements of arrays of tables are left out. ``doc`` tells files apart."""
    root = files.where(F.col("path") == manifest)
    return root.select("repo_id", F.xxhash64("repo_id", "content").alias("doc"),
                       F.filter(TM.toml_entries(F.col("content")), lambda e: ~e["in_array"]).alias("entries"))


def _at(*path: str):
    return lambda e: e["path"] == F.array(*[F.lit(p) for p in path])


def _below(*path: str):
    return lambda e: (F.slice(e["path"], 1, len(path)) == F.array(*[F.lit(p) for p in path])) & \
        (F.size(e["path"]) > len(path))


def _first_of_name(rows: DataFrame, ecosystem: str, manifest: str, src_rank: int) -> DataFrame:
    """One row for each name: the place of its first item, the version of that item."""
    one = rows.groupBy("repo_id", "name").agg(F.min(F.struct("item_ord", "version")).alias("first"))
    return one.select("repo_id", "name", F.col("first.version").alias("version"), F.lit(ecosystem).alias("ecosystem"),
                      F.lit(manifest).alias("manifest"), F.lit(src_rank).alias("src_rank"),
                      F.col("first.item_ord").alias("item_ord"))


def _pep621_items(rows: DataFrame) -> DataFrame:
    items = F.flatten(F.transform(F.filter("entries", _at("project", "dependencies")),
                                  lambda e: TM.array_strings(e["value"])))
    items = rows.select("repo_id", F.posexplode(items).alias("pos", "item")).select(
        "repo_id", T.requirement_name("item").alias("name"), T.requirement_version("item").alias("version"),
        _place(0, "pos"))
    return items.where(F.col("name") != "")


def pep621_deps(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``[project].dependencies`` strings; first occurrence of a name wins."""
    rows = rows if rows is not None else toml_rows(files)
    return _first_of_name(_pep621_items(rows), "pypi", "pyproject.toml", 1)


def poetry_deps(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``[tool.poetry.dependencies]``, ``dev-dependencies``, then every group's
    dependencies (in order of appearance); ``python`` and names already seen (PEP 621
    included) are skipped; version from a string, or from ``version`` of a table
    (inline, dotted or of its own)."""
    rows = rows if rows is not None else store(toml_rows(files), "toml")
    # pairs leave their file's row at once: nothing of the whole file is carried or read again for each
    found = (rows.select("repo_id", "doc", F.explode(F.filter("entries", _below("tool", "poetry"))).alias("e"))
             .select("repo_id", "doc", "e.ord", "e.path", "e.value")
             .withColumn("kind", F.try_element_at("path", F.lit(3))))
    in_group = F.col("kind") == "group"
    rank = (F.when(F.col("kind") == "dependencies", 0).when(F.col("kind") == "dev-dependencies", 1)
            .when(in_group & (F.try_element_at("path", F.lit(5)) == "dependencies"), 2))
    found = found.withColumn("rank", rank).where("rank is not null").withColumn(
        "at", F.when(in_group, F.slice("path", 6, F.size("path"))).otherwise(F.slice("path", 4, F.size("path"))))
    found = found.withColumn("group", F.when(in_group, F.col("path")[3]))
    groups = (found.where(in_group).groupBy("doc", "group").agg(F.min("ord").alias("first"))
              .groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "group"))).alias("groups"))
              .select("doc", F.posexplode("groups").alias("before", "g"))
              .select("doc", F.col("g.group").alias("group"), (F.col("before") + 1).alias("nth")))
    found = found.join(groups, ["doc", "group"], "left").withColumn("nth", F.coalesce("nth", F.lit(0)))
    version = F.when((F.size("at") == 1) | ((F.size("at") == 2) & (F.try_element_at("at", F.lit(2)) == "version")),
                     TM.string_value(F.col("value")))
    items = found.where(F.size("at") > 0).select(
        "repo_id", F.col("at")[0].alias("name"), F.when(version != "", version).alias("version"), "rank", "nth", "ord")
    # a dependency's table may have several pairs: its place is the first, its version any
    items = items.groupBy("repo_id", "rank", "nth", "name").agg(F.min("ord").alias("ord"), F.max("version").alias("version"))
    items = items.select("repo_id", "name", "version", _place(F.col("rank") + 1, "nth", "ord"))
    items = items.where(F.col("name") != "python").join(
        _pep621_items(rows).select("repo_id", "name"), ["repo_id", "name"], "left_anti")
    return _first_of_name(items, "pypi", "pyproject.toml", 1)


def script_values(rows: DataFrame) -> DataFrame:
    """(repo_id, ord3, poetry, val, module) of the strings in both script tables."""
    parts = []
    for poetry, path in ((False, ("project", "scripts")), (True, ("tool", "poetry", "scripts"))):
        own = F.filter("entries", lambda e: _below(*path)(e) & (F.size(e["path"]) == len(path) + 1))
        parts.append(rows.select("repo_id", F.explode(own).alias("e")).select(
            "repo_id", F.col("e.ord").alias("ord3"), TM.string_value(F.col("e.value")).alias("val"),
            F.lit(poetry).alias("poetry")))
    return parts[0].unionByName(parts[1]).where(F.col("val").isNotNull()).withColumn(
        "module", T.py_strip(F.split("val", ":", 2).getItem(0)))


def script_entrypoints(files: DataFrame, index: DataFrame, rows: DataFrame | None = None
                       ) -> DataFrame:
    """``[project.scripts]`` then ``[tool.poetry.scripts]`` values (module before ':')
    mapped to ``<m>.py`` / ``<m>/__init__.py`` at the root; kind cli; a poetry script is
    skipped when its file already has an entry."""
    rows = rows if rows is not None else toml_rows(files)
    hit = module_to_file(script_values(rows), index, "module", ["repo_id", "ord3"]).where(
        F.col("target_id").isNotNull())
    label = F.when(F.col("poetry"), F.lit("pyproject [tool.poetry.scripts]: ")).otherwise(
        F.lit("pyproject [project.scripts]: "))
    ent = hit.select("repo_id", F.col("target_id").alias("file_id"), F.concat(label, "val").alias("evidence"),
                     "poetry", "ord3")
    pep = ent.where(~F.col("poetry"))
    poe = ent.where(F.col("poetry")).join(pep.select("repo_id", "file_id"),
                                           ["repo_id", "file_id"], "left_anti")
    poe = poe.groupBy("repo_id", "file_id").agg(F.min(F.struct("ord3", "evidence")).alias("first")).select(
        "repo_id", "file_id", F.col("first.evidence").alias("evidence"), F.lit(True).alias("poetry"),
        F.col("first.ord3").alias("ord3"))
    return (pep.unionByName(poe)
            .select("repo_id", "file_id", F.lit("cli").alias("kind"), "evidence",
                    F.lit(2).alias("ord"), F.col("poetry").cast("int").alias("ord2"), "ord3")
            .withColumn("manifest", F.lit("pyproject.toml")))


# ------------------------------------------------------------------ merge
def merge_deps(files: DataFrame) -> DataFrame:
    """All manifests concatenated, with ``dep_ord`` = order by (name, ecosystem,
    manifest), ties in manifest order. The same name may come from two manifests."""
    rows = store(toml_rows(files), "toml")
    allv = (npm_deps(files).unionByName(pep621_deps(files, rows))
            .unionByName(poetry_deps(files, rows)).unionByName(requirements_deps(files)))
    return positional_ids(allv, ["repo_id"], ["name", "ecosystem", "manifest", "src_rank", "item_ord"],
                          "dep_ord")


def declared_entrypoints(files: DataFrame, index: DataFrame) -> DataFrame:
    """Manifest entries deduped on (file, kind), first wins."""
    e = node_entrypoints(files, index).unionByName(script_entrypoints(files, index),
                                                   allowMissingColumns=True)
    place = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("ord", "ord2", "ord3")]
    first = e.groupBy("repo_id", "file_id", "kind").agg(
        F.min(F.struct("manifest", *place, "evidence")).alias("first"))
    return first.select("repo_id", "file_id", "kind", F.col("first.evidence").alias("evidence"),
                        *[F.col(f"first.{c}").alias(c) for c in ("manifest", "ord", "ord2", "ord3")])
