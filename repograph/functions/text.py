"""Column expressions (JVM-side, codegen-friendly) shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``; nothing runs
Python per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Extension -> language table (30 extensions, 21 languages), in natural order.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".pyi": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".rb": "ruby",
    ".php": "php",
    ".cs": "csharp",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".hpp": "cpp",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".sh": "shell",
    ".md": "markdown",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".html": "html",
    ".css": "css",
}
# Path segments that are always skipped by the inventory.
ALWAYS_SKIP = [".git", ".venv", "node_modules", "__pycache__", ".pytest_cache", "dist",
               "build"]
# Extensions covered by the import scans.
PY_EXTENSIONS = [".py", ".pyi"]
JS_EXTENSIONS = [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"]
# Extensions tried, in order, when resolving a relative JS/TS specifier.
JS_RESOLVE_EXTENSIONS = [".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs"]
# End-of-line characters of Python's str.splitlines (after universal-newline reading).
LINE_BREAK_REGEX = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Whitespace of Python's str.strip(): Unicode White_Space plus the four separators.
_PY_SPACE = "[\\s\\x1c-\\x1f]"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()`` (Spark ``trim`` removes spaces only)."""
    return F.regexp_replace(_c(col), f"(?U)^{_PY_SPACE}+|{_PY_SPACE}+$", "")


def py_lstrip(col) -> Column:
    return F.regexp_replace(_c(col), f"(?U)^{_PY_SPACE}+", "")


def lstrip_chars(col, chars: str) -> Column:
    """``str.lstrip(chars)``: strip a leading run of any of ``chars`` (a set, not a prefix)."""
    cls = "".join("\\" + ch for ch in chars)
    return F.regexp_replace(_c(col), f"^[{cls}]+", "")


def line_count(col) -> Column:
    """Number of '\\n' characters (bytes): unterminated last line not counted, empty -> 0."""
    c = _c(col)
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("bigint")


def byte_size(col) -> Column:
    return F.octet_length(_c(col)).cast("bigint")


def split_lines(col) -> Column:
    """Python ``splitlines()`` of universally-decoded text: no phantom trailing line."""
    parts = F.split(_c(col), LINE_BREAK_REGEX, -1)
    return F.when(F.try_element_at(parts, F.lit(-1)) == "",
                  F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
                  ).otherwise(parts)


def extension(path) -> Column:
    """Lower-cased text from the LAST dot of the whole path ('' when there is none)."""
    return F.regexp_extract(F.lower(_c(path)), r"(\.[^.]*)$", 1)


def suffix(path) -> Column:
    """``PurePath.suffix`` lower-cased: from the last dot of the basename, a leading dot
    alone (".py" as a whole name) is no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1))


def detect_language(path) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.coalesce(F.try_element_at(mapping, extension(path)), F.lit("unknown"))


def basename(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def parent_dir(path) -> Column:
    """Direct parent directory, '.' for files at the root."""
    c = _c(path)
    return F.when(F.instr(c, "/") > 0, F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise(
        F.lit("."))


def dirname(path) -> Column:
    """Parent directory, '' at the root."""
    c = _c(path)
    return F.when(F.instr(c, "/") > 0, F.regexp_extract(c, r"^(.*)/[^/]*$", 1)).otherwise(
        F.lit(""))


def normalize_path(col) -> Column:
    """Drop '' and '.' segments, '..' pops one segment, clamped at the root."""
    return F.expr(
        "array_join(aggregate(split({c}, '/'), cast(array() as array<string>), "
        "(acc, s) -> CASE WHEN s = '' OR s = '.' THEN acc "
        "WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) "
        "ELSE concat(acc, array(s)) END), '/')".format(c=_sql(col)))


def _sql(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("SQL-expression helpers take column names")


def format_id(prefix: str, width: int, n) -> Column:
    """Positional id: prefix + zero padding, never truncated past the width."""
    return F.format_string(f"{prefix}%0{width}d", _c(n))


def requirement_name(col) -> Column:
    """Text before the first of < > = ! ~ ; [ or whitespace."""
    stripped = py_strip(col)
    return py_strip(F.regexp_extract(stripped, f"(?U)^([^<>=!~;\\[\\s\\x1c-\\x1f]*)", 1))


def requirement_version(col) -> Column:
    """Version only from '=='; null otherwise."""
    v = F.regexp_extract(_c(col), r"(?U)==[\s\x1c-\x1f]*([^\s\x1c-\x1f;,]+)", 1)
    return F.when(v != "", v)


def utf8_truncate(col, cap: int) -> Column:
    """Cut the UTF-8 bytes at ``cap`` on a character boundary (a partial trailing
    character is dropped)."""
    b = F.encode(_c(col), "UTF-8")
    cands = [F.try_validate_utf8(F.substring(b, 1, n).cast("string")) for n in
             range(cap, max(cap - 4, -1), -1)]
    return F.coalesce(*cands, F.lit(""))
