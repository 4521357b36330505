"""Whole-text scanning helpers: masking strings/comments and locating regex matches by
line number, all with JVM regex functions (no Python per row).

Technique: ``split(text, R)`` returns the code between the matches of ``R`` and
``regexp_extract_all(text, R, 0)`` returns the matches themselves; both walk the text
with the same left-to-right search, so segment ``i`` is followed by match ``i``.
Re-assembling them with a per-token replacement masks tokens; counting newlines in
the pieces gives each match's line.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed token patterns (Java regex). Lazy single-class loops avoid deep recursion on
# very long strings.
PY_TOKENS = (
    r'(?:[rRbBuUfF]{0,2})"""[\s\S]*?(?:"""|\z)'
    r"|(?:[rRbBuUfF]{0,2})'''[\s\S]*?(?:'''|\z)"
    r'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"?'
    r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?"
    r"|#[^\n]*"
)
# A slash starts a regex literal where an operand is expected: after an operator, an opening
# bracket or a separator, after ``return``, or at the start of a line.
JS_TOKENS = (
    r"//[^\n]*"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r"|/(?<=[(,=:\[!&|?{};+*%~^<>\n-][ \t]{0,8}/|\breturn[ \t]{1,8}/)"
    r"(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*"
    r"|`[^`\\]*(?:\\[\s\S][^`\\]*)*`?"
    r'|"[^"\\\n]*(?:\\.[^"\\\n]*)*"?'
    r"|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?"
)
# A JS string token is kept (it is a module specifier) when the code right before it
# ends with one of these.
JS_SPEC_CONTEXT = r"(?:\bfrom|\bimport|\brequire\s*\(\s*)\s*$"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once. A plain column that is read inside a lambda
    may be merged into it by the optimizer and is then computed again for every element."""
    return F.transform(F.array(value), use)[0]


def mask_tokens(text: Column, token_regex: str, keep_after: str | None = None) -> Column:
    """Replace every token (string, comment) by just its newlines, so that line numbers
    survive and nothing inside a token can look like code. With ``keep_after``, a token
    whose preceding code matches that regex is kept verbatim."""
    segs = F.split(text, token_regex, -1)
    toks = F.regexp_extract_all(text, F.lit(token_regex), 0)

    def piece(seg, tok):
        masked = F.regexp_replace(tok, "[^\n]", "")
        if keep_after is not None:
            masked = F.when(seg.rlike(keep_after), tok).otherwise(masked)
        return F.concat(seg, F.coalesce(masked, F.lit("")))

    return F.array_join(F.zip_with(segs, toks, piece), "")


def match_lines(text: Column, regex: str) -> Column:
    """array<struct<line:int, match:string>>: every match of ``regex`` in ``text`` with
    the 1-based line where it starts. One pass of ``regex`` puts marks around its matches;
    a line's number is then its place among the marked text's lines, once for each opening
    mark on it. Linear in the text, computed inside the row (no shuffle)."""
    opened, closed = "\u0001", "\u0002"
    clean = F.translate(text, opened + closed, "")
    marked = F.regexp_replace(clean, regex, f"{opened}$0{closed}")
    count = lambda line: F.length(line) - F.length(F.replace(line, F.lit(opened), F.lit("")))

    def found(text: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(f"{opened}([^{closed}]*){closed}"), 1)
        lines = F.flatten(F.transform(F.split(text, "\n", -1),
                                      lambda line, i: F.array_repeat(i + 1, count(line))))
        return F.zip_with(lines, hits, lambda at, hit: F.struct(at.cast("int").alias("line"), hit.alias("match")))
    return bind(marked, found)
