"""Dependencies of further root manifests: go.mod, Cargo.toml, Gemfile, composer.json, pom.xml,
*.csproj (with Directory.Packages.props), setup.cfg and build.gradle.

Each file is parsed inside its row by JVM functions (``from_xml``, ``try_parse_json``, token-aware
regular expressions); only the small dependency and property rows are joined. Versions may name
properties, whose values may name further ones: ``resolved_properties`` substitutes them in
self-joins that double the resolved depth each round.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.functions import text as T
from repograph.functions import toml as TM
from repograph.operators.manifests import _place, toml_rows
from repograph.session import store

ROUNDS = 6                    # chains of up to 2^6 properties; cycles stay as they are written
DEP = ["repo_id", "name", "version", "ecosystem", "manifest", "item_ord"]


def _root(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("path").rlike(f"^{pattern}$")).select("repo_id", F.col("path").alias("manifest"), "content")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _matches(text: Column, regex: str, *groups: tuple[str, Column | int]) -> Column:
    """array<struct> of all matches of ``regex``: a group's text for each name."""
    return F.transform(F.regexp_extract_all(text, F.lit(regex), 0), lambda m: F.struct(
        *[F.regexp_extract(m, regex, g).alias(n) for n, g in groups]))


def _dep_rows(rows: DataFrame, items: Column, ecosystem: str) -> DataFrame:
    """Dependency rows of array<struct<name, version>>."""
    return rows.select("repo_id", "manifest", F.posexplode(items).alias("pos", "d")).select(
        "repo_id", F.col("d.name").alias("name"),
        F.when(F.col("d.version") != "", F.col("d.version")).alias("version"),
        F.lit(ecosystem).alias("ecosystem"), "manifest", _place("pos")).where(F.col("name") != "")


# ------------------------------------------------------------------ flat formats
def go_deps(files: DataFrame) -> DataFrame:
    """``require`` lines and the lines of ``require ( )`` blocks of go.mod."""
    line = r"(?m)^[ \t]*([^\s()/][^\s()]*)[ \t]+(v\S+)"
    single = r"(?m)^[ \t]*require[ \t]+([^\s()]+)[ \t]+(\S+)"
    part = r"(?m)^[ \t]*require[ \t]*\([ \t]*\r?$[^()]*+\)|" + single
    items = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(part), 0), lambda p: F.when(
        p.rlike(r"^[ \t]*require[ \t]*\("), _matches(p, line, ("name", 1), ("version", 2))).otherwise(
        _matches(p, single, ("name", 1), ("version", 2)))))
    return _dep_rows(_root(files, r"go\.mod"), items, "go")


def cargo_deps(files: DataFrame) -> DataFrame:
    """``[dependencies]`` and ``[dev-dependencies]`` of Cargo.toml, inline or as own tables."""
    at = F.col("e.path")
    kind = F.array_position(F.array(F.lit("dependencies"), F.lit("dev-dependencies")), at[0])
    found = toml_rows(files, "Cargo.toml").select("repo_id", F.explode("entries").alias("e")).where(
        (kind > 0) & (F.size(at) >= 2))
    version = F.when((F.size(at) == 2) | ((F.size(at) == 3) & (F.try_element_at(at, F.lit(3)) == "version")),
                     TM.string_value(F.col("e.value")))
    one = found.groupBy("repo_id", kind.alias("kind"), at[1].alias("name")).agg(
        F.min("e.ord").alias("ord"), F.max(F.when(version != "", version)).alias("version"))
    return one.select("repo_id", "name", "version", F.lit("cargo").alias("ecosystem"),
                      F.lit("Cargo.toml").alias("manifest"), _place("ord"))


def gem_deps(files: DataFrame) -> DataFrame:
    """``gem 'name', 'version'`` lines of a Gemfile."""
    gem = r"""(?m)^[ \t]*gem[ \t]+['"]([^'"]+)['"](?:[ \t]*,[ \t]*['"]([^'"]+)['"])?"""
    return _dep_rows(_root(files, "Gemfile"), _matches(F.col("content"), gem, ("name", 1), ("version", 2)), "rubygems")


def composer_deps(files: DataFrame) -> DataFrame:
    """``require`` and ``require-dev`` of composer.json, without ``php`` and ``ext-*``."""
    doc = _root(files, r"composer\.json").select("repo_id", "manifest", F.try_parse_json("content").alias("doc"))
    parts = [doc.select("repo_id", "manifest", F.lit(rank).alias("section"), F.posexplode(
        F.try_variant_get("doc", f"$.{section}", "map<string,variant>")).alias("pos", "name", "val"))
        for rank, section in enumerate(["require", "require-dev"])]
    version = F.variant_get("val", "$", "string")
    return _union(parts).where((F.col("name") != "php") & ~F.col("name").startswith("ext-")).select(
        "repo_id", "name", F.when(version != "", version).alias("version"), F.lit("packagist").alias("ecosystem"),
        "manifest", _place("section", "pos"))


def setup_cfg_deps(files: DataFrame) -> DataFrame:
    """``install_requires`` of ``[options]``, then every list of ``[options.extras_require]``: the
    key's own line and the indented ones below it."""
    section = r"(?m)^\[options(?:\.extras_require)?\][ \t]*\r?\n(?:(?!\[)[^\n]*+(?:\n|\z))*+"
    wanted = r"(?m)^(?!\s)([^=\[\n]+?)[ \t]*=[ \t]*([^\n]*+(?:\n(?:[ \t]+[^\n]*+|(?=\n|\z)))*+)"
    keys = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(section), 0), lambda s: F.filter(
        _matches(s, wanted, ("name", 1), ("version", 2)),
        lambda k: s.startswith("[options.extras_require]") | (k["name"] == "install_requires"))))
    lines = F.filter(F.flatten(F.transform(keys, lambda k: F.split(k["version"], "\n"))), lambda x: ~x.rlike(r"^\s*([#;]|$)"))
    items = F.transform(lines, lambda x: F.struct(T.requirement_name(x).alias("name"), T.requirement_version(x).alias("version")))
    return _dep_rows(_root(files, r"setup\.cfg"), items, "pypi")


# ------------------------------------------------------------------ properties
def resolved_properties(props: DataFrame, reference: str = r"\$\{([^{}$]+)\}", rounds: int = ROUNDS) -> DataFrame:
    """``props(repo_id, manifest, key, value)`` with the references in values replaced.

    A round replaces every reference by the present value of its property, which may still hold
    references: resolved chains double in length each round. References to unknown properties,
    and those of a property to itself, stay as they are written.
    """
    key = ["repo_id", "manifest", "key"]
    cur = store(props.groupBy(*key).agg(F.min("value").alias("value")), "properties")
    for _ in range(rounds):
        refs = F.array_distinct(F.regexp_extract_all("value", F.lit(reference), 1))
        if cur.where(F.size(refs) > 0).isEmpty():
            break
        cur = store(substituted(cur, cur, reference, "value", key), "properties")
    return cur


def substituted(rows: DataFrame, props: DataFrame, reference: str, column: str, key: list[str]) -> DataFrame:
    """``rows`` with the references in ``column`` replaced by the properties of the same file."""
    wanted = rows.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(reference), 1))).alias("ref"))
    values = props.select("repo_id", "manifest", F.col("key").alias("ref"), F.col("value").alias("found"))
    wanted = wanted.join(values, ["repo_id", "manifest", "ref"])
    if "key" in key:
        wanted = wanted.where(F.col("key") != F.col("ref"))
    found = wanted.groupBy(*key).agg(F.collect_list(F.struct("ref", "found")).alias("refs"))
    opened, closed = ("${", "}") if reference.startswith(r"\$\{") else ("$(", ")")
    filled = F.aggregate(F.coalesce("refs", F.array().cast("array<struct<ref:string,found:string>>")), F.col(column),
                         lambda text, r: F.replace(text, F.concat(F.lit(opened), r["ref"], F.lit(closed)), r["found"]))
    return rows.join(found, key, "left").withColumn(column, filled).drop("refs")


def _with_versions(deps: DataFrame, props: DataFrame, managed: DataFrame, reference: str) -> DataFrame:
    """Versions of dependencies: their own or the managed one, properties put in."""
    deps = deps.join(managed.groupBy("repo_id", "name").agg(F.min("version").alias("managed")), ["repo_id", "name"], "left")
    deps = deps.withColumn("version", F.coalesce("version", "managed")).drop("managed")
    return substituted(deps, resolved_properties(props, reference), reference, "version",
                       ["repo_id", "manifest", "item_ord"]).select(*DEP)


# ------------------------------------------------------------------ nested formats
_POM_DEP = "dependency array<struct<groupId:string,artifactId:string,version:string>>"
POM = (f"groupId string, version string, parent struct<groupId:string,version:string>, properties map<string,string>, "
       f"dependencies struct<{_POM_DEP.replace(' ', ':', 1)}>, "
       f"dependencyManagement struct<dependencies:struct<{_POM_DEP.replace(' ', ':', 1)}>>")
CSPROJ = ("PropertyGroup array<map<string,string>>, ItemGroup array<struct<PackageReference:array<struct<"
          "_Include:string,_Version:string,Version:string>>,PackageVersion:array<struct<_Include:string,_Version:string>>>>")
_XML = {"mode": "PERMISSIVE", "inferSchema": "false"}


def _entries(m: Column) -> Column:
    return F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))


def maven_deps(files: DataFrame) -> DataFrame:
    """``groupId:artifactId`` of pom.xml's dependencies. A version missing there is the managed
    one; ``${x}`` is a property of the file, of the project or of its parent's version."""
    doc = store(_root(files, r"pom\.xml").select("repo_id", "manifest", F.from_xml("content", POM, _XML).alias("d")), "poms")
    one = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    version = F.coalesce("d.version", "d.parent.version")
    group = F.coalesce("d.groupId", "d.parent.groupId")
    props = doc.select("repo_id", "manifest", F.explode(F.concat(_entries(F.col("d.properties")), F.array(
        one("project.version", version), one("version", version), one("project.groupId", group),
        one("project.parent.version", F.col("d.parent.version")),
        one("parent.version", F.col("d.parent.version"))))).alias("p")).where("p.value is not null")

    def deps(at: str) -> DataFrame:
        return _dep_rows(doc, F.transform(at, lambda d: F.struct(
            F.concat_ws(":", F.trim(d["groupId"]), F.trim(d["artifactId"])).alias("name"),
            F.trim(d["version"]).alias("version"))), "maven")
    props = props.select("repo_id", "manifest", "p.key", F.trim("p.value").alias("value"))
    # managed names may hold properties as well: both sides are filled in before they are compared
    own, managed = deps("d.dependencies.dependency"), deps("d.dependencyManagement.dependencies.dependency")
    reference, key = r"\$\{([^{}$]+)\}", ["repo_id", "manifest", "item_ord"]
    props = resolved_properties(props, reference)
    own, managed = (substituted(x, props, reference, "name", key) for x in (own, managed))
    return _with_versions(own, props, managed, reference)


def nuget_deps(files: DataFrame) -> DataFrame:
    """``PackageReference`` of root *.csproj files; a version missing there is the
    ``PackageVersion`` of Directory.Packages.props; ``$(X)`` is a property of the same file."""
    doc = store(_root(files, r"(?:[^/]+\.csproj|Directory\.Packages\.props)").select(
        "repo_id", "manifest", F.from_xml("content", CSPROJ, _XML).alias("d")), "projects")
    props = doc.select("repo_id", "manifest", F.explode("d.PropertyGroup").alias("g")).select(
        "repo_id", "manifest", F.explode("g").alias("key", "value")).where("value is not null")

    def deps(kind: str, version) -> DataFrame:
        items = F.flatten(F.filter(F.transform("d.ItemGroup", lambda g: g[kind]), lambda x: x.isNotNull()))
        return _dep_rows(doc, F.transform(items, lambda r: F.struct(
            F.coalesce(r["_Include"], F.lit("")).alias("name"), version(r).alias("version"))), "nuget")
    own = deps("PackageReference", lambda r: F.coalesce(r["_Version"], r["Version"]))
    central = deps("PackageVersion", lambda r: r["_Version"])
    reference, key = r"\$\(([^()$]+)\)", ["repo_id", "manifest", "item_ord"]
    props = resolved_properties(props, reference)
    return _with_versions(own, props, substituted(central, props, reference, "version", key), reference)


def gradle_deps(files: DataFrame) -> DataFrame:
    """``configuration 'group:name:version'`` and ``group: , name: , version:`` forms inside
    ``dependencies { }`` of build.gradle or build.gradle.kts; ``$x`` and ``${x}`` are variables
    and ``ext`` properties of the file or of gradle.properties."""
    quoted = r"""['"]([^'"\n]*)['"]"""
    short = rf"""(?m)^[ \t]*(\w+)[ \t]*\(?[ \t]*(?:(?:platform|enforcedPlatform)[ \t]*\([ \t]*)?['"]([^'":\n]+:[^'":\n]+)(?::([^'"@\n]+))?[^'"\n]*['"]"""
    long = rf"""(?m)^[ \t]*\w+[ \t]*\(?[ \t]*group[ \t]*[:=][ \t]*{quoted}[ \t]*,[ \t]*name[ \t]*[:=][ \t]*{quoted}(?:[ \t]*,[ \t]*version[ \t]*[:=][ \t]*{quoted})?"""
    inner = r"[^{}'\"/]++|'[^'\n]*+'|\"[^\"\n]*+\"|//[^\n]*+|/\*[\s\S]*?\*/|['\"/]"
    block = rf"(?m)^[ \t]*dependencies[ \t]*\{{(?:{inner}|\{{(?:{inner}|\{{(?:{inner})*+\}})*+\}})*+\}}"
    variable = r"""(?m)(?:^|[{;])[ \t]*(?:(?:def|val|var|final|String)[ \t]+|ext\.|set\([ \t]*['"])?([\w.]+)['"]?[ \t]*[=,][ \t]*['"]([^'"\n]*)['"]"""
    docs = _root(files, r"build\.gradle(?:\.kts)?")
    item = lambda m: F.when(m.rlike(long), F.struct(
        F.concat_ws(":", F.regexp_extract(m, long, 1), F.regexp_extract(m, long, 2)).alias("name"),
        F.regexp_extract(m, long, 3).alias("version"))).otherwise(F.struct(
            F.regexp_extract(m, short, 2).alias("name"), F.regexp_extract(m, short, 3).alias("version")))
    items = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(block), 0), lambda b: F.transform(
        F.regexp_extract_all(b, F.lit(rf"{short}|{long[4:]}"), 0), item)))
    deps = _dep_rows(docs, items, "maven").withColumn(
        "version", F.regexp_replace("version", r"\$(\w+(?:\.\w+)*)", r"\${$1}"))
    one = ("key", 1), ("value", 2)
    own = docs.select("repo_id", "manifest", F.explode(_matches(F.col("content"), variable, *one)).alias("p"))
    shared = _root(files, r"gradle\.properties").select("repo_id", F.explode(_matches(
        F.col("content"), r"(?m)^[ \t]*([\w.]+)[ \t]*[=:][ \t]*(\S*)", *one)).alias("p"))
    shared = docs.select("repo_id", "manifest").join(shared, "repo_id")
    props = own.withColumn("far", F.lit(0)).unionByName(shared.withColumn("far", F.lit(1))).groupBy(
        "repo_id", "manifest", "p.key").agg(F.min_by("p.value", "far").alias("value"))
    props = props.withColumn("value", F.regexp_replace("value", r"\$(\w+(?:\.\w+)*)", r"\${$1}"))
    none = deps.select("repo_id", "name", "version").limit(0)
    return _with_versions(deps, props, none, r"\$\{([^{}$]+)\}")


def line_manifest_deps(files: DataFrame) -> DataFrame:
    """go.mod, Cargo.toml, Gemfile and composer.json. Planned in the reference, not implemented
    there; root manifests only."""
    return _union([f(files).select(*DEP) for f in (go_deps, cargo_deps, gem_deps, composer_deps)])


def nested_manifest_deps(files: DataFrame) -> DataFrame:
    """setup.cfg, pom.xml, *.csproj and build.gradle; root manifests only."""
    return _union([f(files).select(*DEP) for f in (setup_cfg_deps, maven_deps, nuget_deps, gradle_deps)])
