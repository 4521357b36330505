from pyspark.sql import functions as F

from conftest import files_df, rows
from fixtures import JS_APP, PY_APP, PY_SRC_APP
from repograph.operators import imports as M
from repograph.operators import resolve as R
from repograph.plans.extract import Facts


def _edges(spark, files):
    f = Facts(files_df(spark, {"r": files}))
    idx = {r.file_id: r.path for r in f.files.collect()}
    out = [(r.file, r.line, idx.get(r.to_id), r.resolution, r.extractor) for r in f.edges.collect()]
    return sorted(out, key=lambda x: (x[0], x[1], str(x[2]))), f


def test_py_app_edges(spark):
    edges, _ = _edges(spark, PY_APP)
    assert edges == [
        ("pkg/__main__.py", 2, "pkg/core.py", "resolved", "treesitter"),
        ("pkg/core.py", 2, "pkg/util.py", "resolved", "treesitter"),
        ("pkg/core.py", 3, "pkg/models.py", "resolved", "treesitter"),
        ("pkg/models.py", 2, "pkg/core.py", "resolved", "treesitter"),
        ("pkg/sub/helper.py", 2, "pkg/util.py", "resolved", "treesitter"),
        ("pkg/util.py", 2, None, "unresolved", "treesitter")]


def test_src_layout_and_roots(spark):
    edges, f = _edges(spark, PY_SRC_APP)
    assert ("cli/main.py", 3, "src/app/config.py", "resolved", "treesitter") in edges
    assert ("cli/main.py", 4, "src/app/core.py", "resolved", "treesitter") in edges
    assert ("cli/main.py", 1, None, "unresolved", "treesitter") in edges
    assert ("src/app/core.py", 1, "src/app/config.py", "resolved", "treesitter") in edges
    roots = {r.name: r.prefixes for r in f.roots.collect()}
    assert roots == {"app": ["src"], "cli": [""]}


def test_js_app_edges(spark):
    edges, _ = _edges(spark, JS_APP)
    assert edges == [
        ("src/app.js", 2, "src/lib/util.js", "resolved", "treesitter"),
        ("src/app.js", 3, None, "unresolved", "treesitter"),
        ("src/index.js", 2, "src/app.js", "resolved", "treesitter"),
        ("src/lib/util.js", 1, None, "unresolved", "treesitter")]


STMT_PY = '''"""Doc mentioning
import fake_module
"""
from __future__ import annotations
import os, sys as system, json
from . import sibling
from .. import (
    a,
    b,
)
x = "import notreal"  # import also_not
def f():
    import inner.mod
y = 1; import after_semicolon
'''


def test_python_statement_scan(spark):
    c = files_df(spark, {"r": {"p/q/m.py": STMT_PY}}).withColumnRenamed("repo_id", "repo_id")
    c = c.selectExpr("repo_id", "path", "content", "'f1' as file_id")
    got = rows(M.python_imports_stmt(c), "line", "level", "module")
    assert got == [(5, 0, "json"), (5, 0, "os"), (5, 0, "sys"), (6, 1, ""), (7, 2, ""),
                   (13, 0, "inner.mod"), (14, 0, "after_semicolon")]
    line = rows(M.python_imports_line(c), "line", "module")
    # the line scan reads the docstring line and stops an import list at "as"
    assert (2, "fake_module") in line and (5, "os") in line and (5, "json") not in line


STMT_JS = """// import x from 'commented'
/* require('blocked') */
import {
  a,
  b,
} from './multi';
export { c } from "./reexport";
const s = `import t from 'tpl'`;
const z = require('./req'), w = require("pkg");
const msg = "require('instring')";
import('./dynamic');
import './side-effect';
"""


def test_js_statement_scan(spark):
    c = files_df(spark, {"r": {"src/m.js": STMT_JS}}).selectExpr(
        "repo_id", "path", "content", "'f1' as file_id")
    got = rows(M.js_imports_stmt(c), "line", "module")
    assert got == [(6, "./multi"), (7, "./reexport"), (9, "./req"), (9, "pkg"),
                   (12, "./side-effect")]


def test_merge_keeps_statement_edges_and_dedupes_line_edges(spark):
    c = files_df(spark, {"r": {"a.py": "import x, x\n", "b.py": "# nothing\n"}}).selectExpr(
        "repo_id", "path", "content", "concat('f', path) as file_id")
    scanned = M.scanned_files(c)
    assert M.merge_edges(scanned).count() == 2  # both items of one line kept
    only_line = M.merge_edges(scanned.withColumn("s", F.filter("s", lambda _: F.lit(False))))
    assert only_line.count() == 1  # same (file, line, raw) signature deduped


def test_one_line_block_statements(spark):
    c = files_df(spark, {"r": {"a.py": "try: import json\nexcept ImportError: import simplejson\n"
                                       "if True: from os import path; import sys\nx = {'a': 1}\n"}})
    got = rows(M.python_imports_stmt(c), "line", "module")
    assert got == [(1, "json"), (2, "simplejson"), (3, "os"), (3, "sys")]


def test_very_long_import_lists_keep_their_order(spark):
    names = ", ".join(f"m{i}" for i in range(1005))
    files = {"a.py": f"import {names}; import zz\n", "zz.py": "", "m1000.py": "", "m3.py": ""}
    edges, ids = _edges(spark, files)
    assert [e[2] for e in edges if e[0] == "a.py" and e[2]] == ["m1000.py", "m3.py", "zz.py"]
    assert len([e for e in edges if e[0] == "a.py"]) == 1006


def test_js_regex_literals_do_not_hide_later_imports(spark):
    src = ("const r = /[`'\"/*]+/g;\nimport a from './a';\nx.replace(/\\//g, '/');\n"
           "const h = y / 2 / z;\nexport { b } from './b';\nif (/`/.test(q)) { require('./c'); }\n")
    c = files_df(spark, {"r": {"m.js": src}})
    assert rows(M.js_imports_stmt(c), "line", "module") == [(2, "./a"), (5, "./b"), (6, "./c")]


def test_line_feed_alone_starts_a_line(spark):
    c = files_df(spark, {"r": {"a.py": "x = 1\u2028import no\nimport yes\n"}})
    assert rows(M.python_imports_stmt(c), "line", "module") == [(2, "yes")]


def test_js_candidates_order(spark):
    files = files_df(spark, {"r": {"src/a.js": "", "src/b/index.ts": "", "src/b.jsx": "",
                                   "src/c.md": ""}}).selectExpr("repo_id", "path",
                                                                "concat('id:', path) as file_id")
    imp = spark.createDataFrame(
        [("r", "x", "src/main.js", 1, 0, "heuristic", "./a"), ("r", "x", "src/main.js", 2, 0,
         "heuristic", "./b"), ("r", "x", "src/main.js", 3, 0, "heuristic", "./c.md"),
         ("r", "x", "src/main.js", 4, 0, "heuristic", "lodash"),
         ("r", "x", "src/main.js", 5, 0, "heuristic", "../../../src/a")],
        "repo_id string, file_id string, path string, line int, rank_in_file int, extractor string, "
        "module string")
    hit = R.first_hit(R.js_candidates(imp), files, ["repo_id", "path", "line"])
    assert rows(hit, "line", "to_id") == [(1, "id:src/a.js"), (2, "id:src/b.jsx"),
                                          (3, "id:src/c.md"), (5, "id:src/a.js")]


def test_relative_imports_clamp_and_package_target(spark):
    files = {
        "a/__init__.py": "", "a/b/__init__.py": "", "a/b/c.py": "from . import x\nfrom ... import y\n",
        "top.py": "from .... import z\nfrom .sib import s\n", "sib.py": "", "sib.js": "",
        "w/x.js": "import q from '../../../sib.js';\nimport r from '@scope/pkg/sub';\n",
    }
    edges, _ = _edges(spark, files)
    # "from . import x" targets the package itself; "..." climbs two levels from a/b to
    # the root, which has no __init__.py; past-the-root dots clamp at the root; a JS
    # "../" past the root clamps too (no w/../../sib.js), and scoped packages stay bare.
    assert ("a/b/c.py", 1, "a/b/__init__.py", "resolved", "treesitter") in edges
    assert ("a/b/c.py", 2, None, "unresolved", "treesitter") in edges
    assert ("top.py", 1, None, "unresolved", "treesitter") in edges
    assert ("top.py", 2, "sib.py", "resolved", "treesitter") in edges
    js = [e for e in edges if e[0] == "w/x.js"]
    assert js == [("w/x.js", 1, "sib.js", "resolved", "treesitter"),
                  ("w/x.js", 2, None, "unresolved", "treesitter")]


def test_future_import_falls_back_to_line_scan(spark):
    edges, _ = _edges(spark, {"m.py": "from __future__ import annotations\nx = 1\n",
                              "n.py": "from __future__ import annotations\nimport os\n"})
    assert ("m.py", 1, None, "unresolved", "heuristic") in edges
    assert [e for e in edges if e[0] == "n.py"] == [("n.py", 2, None, "unresolved", "treesitter")]


def test_focus_shrinks_the_index(spark):
    f = Facts(files_df(spark, {"r": {"src/a.py": "import lib.b\n", "lib/__init__.py": "",
                                     "lib/b.py": "", "src/c.py": "from . import a\n"}}),
              focus="src")
    got = sorted((r.file, r.resolution) for r in f.edges.collect())
    assert got == [("src/a.py", "unresolved"), ("src/c.py", "unresolved")]
    assert sorted(r.path for r in f.files.collect()) == ["src/a.py", "src/c.py"]


def test_lines_are_scanned_only_where_no_statement_is_found(spark):
    c = files_df(spark, {"r": {"a.py": "import os\n", "b.py": 's = """\nimport sys\n"""\n', "c.js": "import x from './y';\n",
                               "d.js": "`\nimport './z'\n`\n"}})
    lazy, whole = M.scanned_files(c, fallback=True), M.scanned_files(c)
    assert {r["path"] for r in lazy.where("l IS NOT NULL").collect()} == {"b.py", "d.js"}
    cols = M.merge_edges(whole).columns
    assert rows(M.merge_edges(lazy), *cols) == rows(M.merge_edges(whole), *cols)
    assert rows(M.file_imports(c), *cols) == rows(M.merge_edges(whole), *cols)


def test_text_is_scanned_once(spark):
    """The optimizer tests before an explode whether there are items; for that it would scan the
    text, find the candidates and check the rules once more."""
    from repograph.functions.scan import PY_TOKENS
    from repograph.operators.constraints import check_rules
    df = files_df(spark, {"r": PY_APP})

    def plan(out):
        return out._jdf.queryExecution().optimizedPlan().toString()
    assert plan(M.file_imports(df)).count(PY_TOKENS) == 2          # the pieces between, and the tokens
    assert plan(M.python_imports_stmt(df)).count(PY_TOKENS) == 2
    f = Facts(df)
    assert plan(R.first_hit(R.js_candidates(f.merged), f.files)).count("/index.mjs") == 1
    rule = check_rules(f.files, "files", ["path"], {"odd": F.col("loc") % 971 == 1})
    assert plan(rule).count("971") == 1
    assert sorted(r["key"] for r in rule.collect()) == sorted(r.path for r in f.files.collect() if r.loc != 1)
