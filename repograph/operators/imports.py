"""Import extraction: text -> raw import rows -> resolved, merged, numbered edges.

Each file is scanned once, in its row: the statement scan and the line scan both give an
array of items (line, raw, match_no, item_pos, level, module). ``match_no`` and ``item_pos``
order the items of one line. The registered scans, the merged imports and the edges all come
from these arrays; content is never joined or shuffled. The arrays are exploded as outer ones: for
others the optimizer tests beforehand that they have items, by scanning the text again.
``module``/``level`` for Python (dotted text, leading-dot count), ``module`` is the
specifier for JS/TS.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repograph.functions import scan as S
from repograph.functions import text as T
from repograph.functions.text import format_id
from repograph.operators.ids import running_offsets
from repograph.operators.inventory import scan_eligible

# Fixed patterns (Python syntax of the line scan, written for Java with (?U)).
PY_FROM_LINE = r"(?U)^\s*from\s+(\.*)([\w.]*)\s+import\s+"
PY_IMPORT_LINE = r"(?U)^\s*import\s+([\w.]+(?:\s*,\s*[\w.]+)*)"
JS_FROM = r"""(?U)\bfrom\s+['"]([^'"]+)['"]"""
JS_BARE_IMPORT = r"""(?U)^\s*import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""(?U)\brequire\(\s*['"]([^'"]+)['"]\s*\)"""

# Statement patterns over masked text (strings and comments already blanked). A statement
# starts a line (after a line feed only) or follows ``;`` or a block's colon.
PY_STMT = (r"(?dmU)(?:^|[;:])[ \t]*(?:from[ \t]+(?!__future__\b)(\.*)[ \t]*([\w.]*)[ \t]+import\b"
           r"|import[ \t]+([^\n;\\]*(?:\\\n?[^\n;\\]*)*))")
JS_STMT_FROM = r"""(?U)(?:^|[;}\n])[ \t]*(?:import|export)\b[^;'"`]*?\bfrom[ \t\n]*(['"])([^'"\n]*)\1"""
JS_STMT_BARE = r"""(?dmU)^[ \t]*import[ \t]*(['"])([^'"\n]*)\1"""
JS_STMT_REQUIRE = r"""(?U)\brequire[ \t]*\([ \t\n]*(['"])([^'"\n]*)\1[ \t\n]*\)"""

ITEM = "struct<line:int,raw:string,match_no:int,item_pos:int,level:int,module:string>"
RAW_COLS = ["repo_id", "path", "line", "raw", "match_no", "item_pos", "lang", "level", "module",
            "extractor"]


def explode_lines(files: DataFrame, text_col: str = "content",
                  key_cols: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """Numbered source lines (1-based, universal newlines, no phantom last line)."""
    return files.select(*key_cols, F.posexplode(T.split_lines(text_col)).alias("pos", "text")
                        ).select(*key_cols, (F.col("pos") + 1).cast("int").alias("line_no"),
                                 "text")


def _item(line, raw, match_no, pos, level, module) -> Column:
    return F.struct(line.cast("int").alias("line"), raw.alias("raw"),
                    match_no.cast("int").alias("match_no"), pos.cast("int").alias("item_pos"),
                    level.cast("int").alias("level"), module.alias("module"))


def _evidence(lines: Column, line: Column) -> Column:
    """Text of that one line, '' when out of range."""
    return F.when((line >= 1) & (line <= F.size(lines)), F.try_element_at(lines, line)).otherwise(
        F.lit(""))


def _py_line_mods(x: Column) -> Column:
    """array<struct<level, module>> of one line: the ``from`` form gives one (dots, module);
    else ``import a, b`` gives one per item (an ``as`` alias ends the list)."""
    items = F.filter(F.transform(F.split(F.regexp_extract(x, PY_IMPORT_LINE, 1), ","),
                                 lambda s: T.py_strip(s)), lambda s: s != "")
    none = F.array().cast("array<struct<level:int,module:string>>")
    return F.when(~x.contains("import"), none).when(x.rlike(PY_FROM_LINE), F.array(F.struct(
        F.length(F.regexp_extract(x, PY_FROM_LINE, 1)).alias("level"),
        F.regexp_extract(x, PY_FROM_LINE, 2).alias("module")))).otherwise(
        F.transform(items, lambda m: F.struct(F.lit(0).alias("level"), m.alias("module"))))


def _py_stmt_mods(m: Column) -> Column:
    """The same of one statement: one for ``from``, one for each item of ``import``."""
    is_from = m.rlike(r"(?U)^[;:\s]*from[ \t]")
    body = F.regexp_replace(F.regexp_extract(m, PY_STMT, 3), r"\\\n|[()\\]", " ")
    names = F.filter(F.transform(F.split(body, ","),
                                 lambda s: F.regexp_extract(s, r"(?U)^\s*([\w.]+)", 1)),
                     lambda s: s != "")
    return F.when(is_from, F.array(F.struct(
        F.length(F.regexp_extract(m, PY_STMT, 1)).alias("level"),
        F.regexp_extract(m, PY_STMT, 2).alias("module")))).otherwise(
        F.transform(names, lambda n: F.struct(F.lit(0).alias("level"), n.alias("module"))))


def _js_line_specs(x: Column) -> Column:
    """Specifiers of one line: for lines starting with import/export the first ``from '...'``,
    else a bare ``import '...'``; plus every ``require('...')``."""
    stripped = T.py_lstrip(x)
    stmt = stripped.startswith("import") | stripped.startswith("export")
    from_spec = F.regexp_extract(x, JS_FROM, 1)
    bare = F.regexp_extract(x, JS_BARE_IMPORT, 1)
    none = F.array().cast("array<string>")
    first = F.when(stmt & (from_spec != ""), from_spec).when(stmt & (bare != ""), bare)
    required = F.when(x.contains("require"), F.regexp_extract_all(x, F.lit(JS_REQUIRE), 1)).otherwise(none)
    return F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(none), required)


def scanned_files(contents: DataFrame, fallback: bool = False) -> DataFrame:
    """(repo_id, path, lang, s, l): the statement items and the line items of every eligible
    file, from one read of its text. With ``fallback``, lines are scanned only in files without
    a statement item (``l`` is null elsewhere).

    Statement scan: strings, comments and regex literals are masked first, so text inside
    them is ignored. Python: ``;``-separated and one-line block statements and imports inside
    functions count; ``from __future__`` is not an import edge; the evidence line is the
    statement's first line. JS/TS: the specifier of import/export ... from (line of the
    specifier; the statement may span lines), bare ``import '...'``, and ``require(<string>)``
    calls (line of the call); dynamic ``import()`` is not captured.
    """
    src = scan_eligible(contents)
    python, lines = F.col("family") == "python", T.split_lines("content")

    def py_stmt(b: Column) -> Column:
        return F.flatten(F.transform(S.match_lines(b["masked"], PY_STMT), lambda m, i: F.transform(
            _py_stmt_mods(m["match"]), lambda d, k: _item(m["line"], _evidence(b["lines"], m["line"]), i, k,
                                                          d["level"], d["module"]))))

    def specs(masked: Column, regex: str, at_end: bool) -> Column:
        def one(m):
            below = F.length(m["match"]) - F.length(F.replace(m["match"], F.lit("\n"), F.lit("")))
            return F.struct((m["line"] + below if at_end else m["line"]).alias("line"),
                            F.regexp_extract(m["match"], regex, 2).alias("spec"))
        return F.transform(S.match_lines(masked, regex), one)

    def js_stmt(b: Column) -> Column:
        found = F.concat(specs(b["masked"], JS_STMT_FROM, True), specs(b["masked"], JS_STMT_BARE, False),
                         specs(b["masked"], JS_STMT_REQUIRE, False))
        return F.filter(F.transform(found, lambda m, i: _item(
            m["line"], _evidence(b["lines"], m["line"]), i, F.lit(0), F.lit(0), m["spec"])),
            lambda r: r["module"] != "")

    def read_once(masked: Column, use) -> Column:
        return S.bind(F.struct(lines.alias("lines"), masked.alias("masked")), use)

    stmt = F.when(python, read_once(S.mask_tokens(F.col("content"), S.PY_TOKENS), py_stmt)).otherwise(
        read_once(S.mask_tokens(F.col("content"), S.JS_TOKENS, S.JS_SPEC_CONTEXT), js_stmt))
    py_line = F.flatten(F.transform(lines, lambda x, i: F.transform(
        _py_line_mods(x), lambda d, k: _item(i + 1, x, F.lit(0), k, d["level"], d["module"]))))
    js_line = F.flatten(F.transform(lines, lambda x, i: F.transform(
        _js_line_specs(x), lambda sp, k: _item(i + 1, x, F.lit(0), k, F.lit(0), sp))))
    items = F.when(python, py_line).otherwise(js_line)
    scanned = src.withColumns({"s": stmt, "lang": F.when(python, F.lit("python")).otherwise(F.lit("js"))})
    return scanned.select("repo_id", "path", "lang", "s",
                          (F.when(F.size("s") == 0, items) if fallback else items).alias("l"))


def _item_rows(scanned: DataFrame, items: str, lang: str, extractor: str) -> DataFrame:
    return (scanned.where(F.col("lang") == lang)
            .select("repo_id", "path", "lang", F.explode_outer(items).alias("e")).where(F.col("e").isNotNull())
            .select("repo_id", "path", "e.line", "e.raw", "e.match_no", "e.item_pos", "lang", "e.level",
                    "e.module", F.lit(extractor).alias("extractor")))


def python_imports_line(contents: DataFrame) -> DataFrame:
    return _item_rows(scanned_files(contents), "l", "python", "heuristic")


def js_imports_line(contents: DataFrame) -> DataFrame:
    return _item_rows(scanned_files(contents), "l", "js", "heuristic")


def python_imports_stmt(contents: DataFrame) -> DataFrame:
    return _item_rows(scanned_files(contents), "s", "python", "treesitter")


def js_imports_stmt(contents: DataFrame) -> DataFrame:
    return _item_rows(scanned_files(contents), "s", "js", "treesitter")


# ------------------------------------------------------------------ merge, ids
def merge_edges(scanned: DataFrame) -> DataFrame:
    """Import rows of scanned files: a file with at least one statement item keeps exactly
    those, any other file the first line item of each line (the (file, line, raw) dedupe).

    Decided and sorted in the row, so ``rank_in_file`` is an edge's place in its file and
    ``n_in_file`` their number; no join, no shuffle.
    """
    use_stmt = F.size("s") > 0
    chosen = F.array_sort(F.when(use_stmt, F.col("s")).otherwise(
        F.filter("l", lambda e: e["item_pos"] == 0)))
    return (scanned.select("repo_id", "path", "lang", chosen.alias("chosen"),
                           F.when(use_stmt, F.lit("treesitter")).otherwise(F.lit("heuristic"))
                           .alias("extractor"))
            .select("repo_id", "path", "lang", "extractor", F.size("chosen").alias("n_in_file"),
                    F.posexplode_outer("chosen").alias("rank_in_file", "e")).where(F.col("e").isNotNull())
            .select("repo_id", "path", "e.line", "e.raw", "lang", "e.level", "e.module", "extractor",
                    "rank_in_file", "n_in_file"))


def file_imports(contents: DataFrame) -> DataFrame:
    """Merged import rows of all eligible files, from one read of their text."""
    return merge_edges(scanned_files(contents, fallback=True))


def edge_ids_by_file(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``e%04d`` ids for edges carrying ``rank_in_file`` (their order inside the file by
    (line, raw, position)): per-file edge counts are prefix-summed over the files of each
    repo in path order, so only one narrow row per file is sorted, never the edges.
    Also attaches the importing file's id (``file_id``)."""
    counts = edges.where(F.col("rank_in_file") == 0).select("repo_id", "path", "n_in_file")
    offs = running_offsets(counts.withColumnRenamed("n_in_file", "_n"), ["repo_id"], ["path"], "_n",
                           "_offset")
    per_file = offs.join(files.select("repo_id", "path", "file_id"), ["repo_id", "path"])
    return (edges.join(per_file.select("repo_id", "path", "file_id", "_offset"),
                       ["repo_id", "path"])
            .withColumn("edge_id", format_id("e", 4, F.col("_offset") + F.col("rank_in_file") + 1))
            .drop("_offset"))
