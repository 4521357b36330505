from conftest import files_df, rows
from fixtures import JS_APP, PY_APP
from repograph.operators import build_files as BF
from repograph.operators import entrypoints as EP
from repograph.operators import manifests as MF
from repograph.plans.extract import Facts

PYPROJECT = '''[project]
name = "x"
dependencies = ["alpha==1.2", "beta>=2; python_version<'3.9'", "alpha>=3"]

[project.scripts]
tool = "pkg.cli:main"

[tool.poetry.dependencies]
python = "^3.9"
gamma = "^1.0"
delta = { version = "2.0", optional = true }
eps = { git = "https://example.invalid/eps.git" }
beta = "9"

[tool.poetry.dev-dependencies]
pytest = "^7"

[tool.poetry.group.docs.dependencies]
mkdocs = "*"
gamma = "0"

[tool.poetry.scripts]
tool2 = "pkg.cli:run"
other = "pkg.other:go"
'''


def test_requirements(spark):
    f = files_df(spark, {"r": {"requirements.txt": "# c\n\n-r base.txt\nflask==2.0\n  requests >= 2 \n"
                                                   "pkg[extra]~=1.0\n", "sub/requirements.txt": "x\n"}})
    assert rows(MF.requirements_deps(f), "name", "version") == [
        ("flask", "2.0"), ("pkg", None), ("requests", None)]


def test_pyproject_pep621_and_poetry(spark):
    f = files_df(spark, {"r": {"pyproject.toml": PYPROJECT, "pkg/cli.py": "", "pkg/other/__init__.py": ""}})
    assert rows(MF.pep621_deps(f), "name", "version") == [("alpha", "1.2"), ("beta", None)]
    assert rows(MF.poetry_deps(f), "name", "version") == [
        ("delta", "2.0"), ("eps", None), ("gamma", "^1.0"), ("mkdocs", "*"), ("pytest", "^7")]
    idx = Facts(f).files
    ents = rows(MF.script_entrypoints(f, idx), "kind", "evidence")
    assert ents == [("cli", "pyproject [project.scripts]: pkg.cli:main"),
                    ("cli", "pyproject [tool.poetry.scripts]: pkg.other:go")]


def test_package_json(spark):
    f = files_df(spark, {"r": JS_APP, "bad": {"package.json": "{not json"},
                         "odd": {"package.json": '{"dependencies": {"a": 1, "b": ""}, '
                                                 '"devDependencies": {"c": "^1"}, "main": "./lib.js", '
                                                 '"scripts": {"start": "", "main": "node ./srv.js --serve"}}',
                                 "lib.js": "", "srv.js": ""}})
    deps = rows(MF.npm_deps(f), "repo_id", "name", "version")
    assert deps == [("odd", "a", None), ("odd", "b", None), ("odd", "c", "^1"),
                    ("r", "lodash", "4.17.21"), ("r", "react", "18.2.0")]
    idx = Facts(f).files
    ents = rows(MF.node_entrypoints(f, idx).join(idx, ["repo_id", "file_id"]),
                "repo_id", "path", "kind")
    assert ents == [("odd", "lib.js", "lib"), ("odd", "srv.js", "web"), ("r", "src/index.js", "cli")]


def test_py_app_declared_entry(spark):
    f = files_df(spark, {"r": PY_APP})
    facts = Facts(f)
    e = rows(facts.entrypoints.join(facts.files, ["repo_id", "file_id"]), "path", "kind")
    assert e == [("pkg/__main__.py", "cli")]
    assert rows(facts.deps, "name", "version") == [("click", None), ("requests", None)]


WEB = {
    "direct.py": "from fastapi import FastAPI\napp = FastAPI()\n",
    "factory.py": "from flask import Flask\n\ndef create():\n    return Flask(__name__)\n\napplication = create()\n",
    "inner.py": "def make():\n    app = Flask(__name__)\n    return app\n",
    "none.py": "x = 1\n",
    "stub.pyi": "app = FastAPI()\n",
}


def test_web_entrypoints(spark):
    f = files_df(spark, {"r": WEB})
    got = rows(EP.web_entrypoints(f), "path", "evidence")
    assert got == [("direct.py", "module-level FastAPI() app object: app"),
                   ("factory.py", "module-level 'application' bound to a Flask() application "
                                  "(factory pattern)")]


def test_more_manifests(spark):
    f = files_df(spark, {"r": {
        "go.mod": "module x\n\ngo 1.21\n\nrequire github.com/a/b v1.2.3\nrequire (\n"
                  "\tgolang.org/x/text v0.14.0 // indirect\n\tgithub.com/c/d v2.0.0\n)\n",
        "Cargo.toml": '[package]\nname = "x"\n\n[dependencies]\nserde = "1.0"\n'
                      'tokio = { version = "1.35", features = ["full"] }\nlocal = { path = "../l" }\n'
                      '\n[dev-dependencies]\nproptest = "1"\n',
        "Gemfile": "source 'https://rubygems.org'\ngem 'rails', '7.1.0'\ngem \"puma\"\n",
        "composer.json": '{"require": {"php": ">=8.1", "ext-json": "*", "monolog/monolog": "^3.0"}, '
                         '"require-dev": {"phpunit/phpunit": "^10"}}',
        "sub/go.mod": "require z v1\n"}})
    got = rows(BF.line_manifest_deps(f), "ecosystem", "name", "version")
    assert got == [
        ("cargo", "local", None), ("cargo", "proptest", "1"), ("cargo", "serde", "1.0"),
        ("cargo", "tokio", "1.35"),
        ("go", "github.com/a/b", "v1.2.3"), ("go", "github.com/c/d", "v2.0.0"),
        ("go", "golang.org/x/text", "v0.14.0"),
        ("packagist", "monolog/monolog", "^3.0"), ("packagist", "phpunit/phpunit", "^10"),
        ("rubygems", "puma", None), ("rubygems", "rails", "7.1.0")]


def test_main_guard_entrypoints(spark):
    f = files_df(spark, {"r": {"a.py": 'def main():\n    pass\n\nif __name__ == "__main__":\n    main()\n',
                               "b.py": "@app.get('/x')\ndef h():\n    pass\n",
                               "c.py": "  if __name__ == '__main__': pass\n"}})
    assert rows(EP.main_guard_entrypoints(f), "path", "kind") == [("a.py", "cli"), ("b.py", "web")]


def test_dependency_usage_scoped_names(spark):
    from repograph.operators import report as RP
    files = {"package.json": '{"dependencies": {"@scope/pkg": "1", "left-pad": "1"}}',
             "requirements.txt": "requests\n",
             "a.js": "import x from '@scope/pkg/deep';\nconst y = require('left-pad');\n",
             "b.py": "import requests.adapters\nimport numpy\n"}
    f = Facts(files_df(spark, {"r": files}))
    used = RP.dependency_usage(f.edges, f.deps).join(f.files, ["repo_id", "file_id"])
    assert rows(used, "name", "path") == [("@scope/pkg", "a.js"), ("left-pad", "a.js"),
                                          ("requests", "b.py")]


FORMS = """# dependencies = ["comment"]
[project]
name = "x" # [tool.poetry.dependencies]
description = '''
[project.scripts]
fake = "no:no"'''
dependencies = [ # first "not this"
  "alpha==1.2", 'beta[extra]>=2', # "nor this"
  """ + '"""gamma"""' + """,
]
scripts = { "one" = "pkg.cli:main" }
[ tool . "poetry" . dependencies ]
"delta.x" = { git = "https://x/y, version = 9", version = '2' }
eps.version = "3"
beta = "no"
[tool.poetry.dependencies.zeta]
optional = true
version = "4"
[[tool.poetry.source]]
dependencies = "no"
[tool.poetry.group.b.dependencies]
mk = { extras = ["a", "]"], markers = "x" }
[tool.poetry.group.a.dependencies]
mk = "1"
last = "^2"
"""


def test_toml_forms(spark):
    """Strings of all kinds, arrays over lines, inline, dotted and own tables, quoted keys, comments."""
    f = files_df(spark, {"r": {"pyproject.toml": FORMS, "pkg/cli.py": ""}, "crlf": {
        "pyproject.toml": '[project]\r\ndependencies = [\r\n "a==1",\r\n]\r\n[tool.poetry.dependencies]\r\nb = "2"\r\n'},
        "bad": {"pyproject.toml": '[project\ndependencies = ["a", \n[tool.poetry.dependencies]\nc = "1"\n'},
        "empty": {"pyproject.toml": ""}})
    assert rows(MF.pep621_deps(f), "repo_id", "name", "version") == [
        ("crlf", "a", "1"), ("r", "alpha", "1.2"), ("r", "beta", None), ("r", "gamma", None)]
    assert rows(MF.poetry_deps(f), "repo_id", "name", "version") == [
        ("bad", "c", "1"), ("crlf", "b", "2"), ("r", "delta.x", "2"), ("r", "eps", "3"), ("r", "last", "^2"),
        ("r", "mk", None), ("r", "zeta", "4")]
    order = [r["name"] for r in MF.poetry_deps(f).where("repo_id = 'r'").orderBy("item_ord").collect()]
    assert order == ["delta.x", "eps", "zeta", "mk", "last"]
    assert rows(MF.script_entrypoints(f, Facts(f).files), "evidence") == [("pyproject [project.scripts]: pkg.cli:main",)]


def test_toml_equals_tomllib(spark):
    import tomllib
    from pyspark.sql import functions as F
    from repograph.functions.toml import array_strings, string_value, toml_entries
    text = FORMS + '''[t]
s = "a\\"b\\\\c\\nd # e"
l = 'C:\\n'
m = """
one \\
   two"""
n = [["x", "y"], ['z']]
'''
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(F.explode(toml_entries(F.col("t"))).alias("e")).where("not e.in_array").select(
        "e.path", string_value(F.col("e.value")).alias("s"), array_strings(F.col("e.value")).alias("a")).collect()

    def leaves(d, at=()):
        for k, v in d.items():
            if isinstance(v, dict):
                yield from leaves(v, (*at, k))
            elif not (isinstance(v, list) and v and isinstance(v[0], dict)):
                yield (*at, k), v

    def flat(v):
        return [y for x in v for y in flat(x)] if isinstance(v, list) else [v]
    expected = dict(leaves(tomllib.loads(text)))
    got = {tuple(r["path"]): (r["a"] if isinstance(expected.get(tuple(r["path"])), list) else r["s"]) for r in found}
    assert {k: v for k, v in got.items() if k in expected} == {
        k: flat(v) if isinstance(v, list) else v if isinstance(v, str) else None for k, v in expected.items()}


def test_large_pyproject_is_linear(spark):
    """Neither the file nor its list of groups is read again for each of its pairs."""
    import time
    n = 4000
    text = "[tool.poetry.dependencies]\n" + "".join(f'd{i} = "^{i}"\n' for i in range(n)) + "".join(
        f'[tool.poetry.group.g{i}.dependencies]\nx{i} = {{ version = "{i}" }}\nd{i} = "0"\n' for i in range(n, 0, -1))
    f = files_df(spark, {"r": {"pyproject.toml": text}, "s": {"pyproject.toml": text}})
    t = time.time()
    got = MF.poetry_deps(f).where("repo_id = 's'").orderBy("item_ord").collect()
    assert time.time() - t < 40
    assert [(r["name"], r["version"]) for r in got] == [(f"d{i}", f"^{i}") for i in range(n)] + [
        (f"x{n}", str(n)), (f"d{n}", "0")] + [(f"x{i}", str(i)) for i in range(n - 1, 0, -1)]


def test_manifest_plans_have_no_window(spark):
    f = files_df(spark, {"r": {"pyproject.toml": FORMS, "pkg/cli.py": ""}})
    index = Facts(f).files
    for plan in (MF.pep621_deps(f), MF.poetry_deps(f), MF.script_entrypoints(f, index), BF.line_manifest_deps(f)):
        assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()


POM = """<?xml version="1.0"?>
<!-- comment <dependency> --><project xmlns="http://maven.apache.org/POM/4.0.0">
  <parent><groupId>org.up</groupId><version>9.1</version></parent>
  <artifactId>app</artifactId>
  <properties><a.version>${b}</a.version><b>${c}</b><c>1.5</c><loop>${pool}</loop><pool>${loop}</pool></properties>
  <dependencyManagement><dependencies>
    <dependency><groupId>org.m</groupId><artifactId>managed</artifactId><version>${c}</version></dependency>
  </dependencies></dependencyManagement>
  <dependencies>
    <dependency><groupId>org.x</groupId><artifactId>plain</artifactId><version>1.0</version></dependency>
    <dependency><groupId>org.x</groupId><artifactId>chain</artifactId><version>${a.version}-x</version></dependency>
    <dependency><groupId>org.m</groupId><artifactId>managed</artifactId><scope>test</scope></dependency>
    <dependency><groupId>${project.groupId}</groupId><artifactId>own</artifactId><version>${project.version}</version></dependency>
    <dependency><groupId>org.x</groupId><artifactId>none</artifactId></dependency>
    <dependency><groupId>org.x</groupId><artifactId>unknown</artifactId><version>${nope}</version></dependency>
    <dependency><groupId>org.x</groupId><artifactId>cycle</artifactId><version>${loop}</version></dependency>
  </dependencies>
</project>"""
CSPROJ = """<Project Sdk="Microsoft.NET.Sdk">
  <PropertyGroup><TargetFramework>net8.0</TargetFramework><JsonVersion>13.0.3</JsonVersion></PropertyGroup>
  <PropertyGroup><Other>1</Other></PropertyGroup>
  <ItemGroup><PackageReference Include="Newtonsoft.Json" Version="$(JsonVersion)" />
    <PackageReference Include="Serilog"><Version>3.1.1</Version></PackageReference></ItemGroup>
  <ItemGroup><PackageReference Include="Central" /><Compile Include="x.cs" /></ItemGroup>
</Project>"""
SETUP = """[metadata]
name = x
install_requires = not-this
[options]
packages = find:
install_requires =
    requests>=2
    # comment
    flask[async]==3.0 ; python_version > "3.8"

    click
python_requires = >=3.8
[options.extras_require]
test = pytest==8.0
docs =
    sphinx
[tool:pytest]
addopts = -q
"""
GRADLE = """plugins { id 'org.plugin:x' version '1' }
def netty = '4.1'
ext { jackson = "$base"
      base = '2.15' }
// implementation 'commented:out:1'
dependencies {
    implementation 'org.a:plain:1.0'
    api("org.a:paren:2.0@aar")
    testImplementation "io.netty:netty-all:${netty}"
    runtimeOnly "com.j:core:$jackson"
    implementation group: 'org.g', name: 'map', version: '3.0'
    implementation platform('org.p:bom:5.0')
    implementation("org.t:closure:1.1") { exclude group: 'x' }
    implementation 'org.n:noversion'
    compileOnly "org.s:shared:$sharedVersion"
}
task x { doLast { println 'a:b:c' } }
"""


def test_nested_manifests(spark):
    f = files_df(spark, {"r": {"pom.xml": POM, "App.csproj": CSPROJ, "setup.cfg": SETUP, "build.gradle": GRADLE,
                               "gradle.properties": "sharedVersion=7.7\n", "sub/pom.xml": POM,
                               "Directory.Packages.props": '<Project><ItemGroup><PackageVersion Include="Central" '
                                                           'Version="5.5" /></ItemGroup></Project>'},
                         "bad": {"pom.xml": "<project><dependencies>", "App.csproj": "", "setup.cfg": "[options]",
                                 "build.gradle": "dependencies {"}})
    assert rows(BF.maven_deps(f), "name", "version") == [
        ("org.m:managed", "1.5"), ("org.up:own", "9.1"), ("org.x:chain", "1.5-x"), ("org.x:cycle", "${loop}"),
        ("org.x:none", None), ("org.x:plain", "1.0"), ("org.x:unknown", "${nope}")]
    assert rows(BF.nuget_deps(f), "name", "version") == [
        ("Central", "5.5"), ("Newtonsoft.Json", "13.0.3"), ("Serilog", "3.1.1")]
    assert rows(BF.setup_cfg_deps(f), "name", "version") == [
        ("click", None), ("flask", "3.0"), ("pytest", "8.0"), ("requests", None), ("sphinx", None)]
    assert rows(BF.gradle_deps(f), "name", "version") == [
        ("com.j:core", "2.15"), ("io.netty:netty-all", "4.1"), ("org.a:paren", "2.0"), ("org.a:plain", "1.0"),
        ("org.g:map", "3.0"), ("org.n:noversion", None), ("org.p:bom", "5.0"), ("org.s:shared", "7.7"),
        ("org.t:closure", "1.1")]


def test_properties_of_long_chains(spark):
    chain = [("r", "m", f"p{i}", "x${p%d}" % (i + 1)) for i in range(40)] + [("r", "m", "p40", "end")]
    got = BF.resolved_properties(spark.createDataFrame(chain, "repo_id string, manifest string, key string, value string"))
    assert {r["key"]: r["value"] for r in got.collect()}["p0"] == "x" * 40 + "end"
