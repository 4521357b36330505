"""TOML read inside the row: no explode of lines, no window, no Python.

A text is cut into tables by one regular expression and a table into ``key = value`` pairs by
another. Both step over whole values (strings of all four kinds, arrays and inline tables over
several lines, comments), so nothing inside a value can look like a header or a key. Loops are
possessive, which Java runs without recursion, so the length of a value does not matter.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repograph.functions.scan import bind

_STRING = (r'"""(?>[^\\]|\\[\s\S])*?"""' r"|'''[\s\S]*?'''" r'|"(?>[^"\\\n]|\\.)*+"' r"|'[^'\n]*+'")
_REST = r"""#[^\n]*+|[^\[\]{}"'#]++|["']"""
NESTING = 4                   # arrays and inline tables inside one another
INLINE_LEVELS = 2             # inline tables whose own pairs are entries too


def _balanced(depth: int) -> str:
    inner = f"{_balanced(depth - 1)}|" if depth > 1 else ""
    return rf"[\[{{](?:{_STRING}|{inner}{_REST})*+[\]}}]"


_GROUP = _balanced(NESTING)
_KEY_PART = r"""(?:"(?>[^"\\\n]|\\.)*+"|'[^'\n]*+'|[\w-]++)"""
_KEY = rf"{_KEY_PART}(?:[ \t]*\.[ \t]*{_KEY_PART})*+"
_VALUE = rf"""(?:{_STRING}|{_GROUP}|[^\[\]{{}}"'#\n]++)*+"""
PAIR = rf"(?m)^[ \t]*({_KEY})[ \t]*=[ \t]*({_VALUE})"
_HEADER = rf"(?m)^[ \t]*\[\[?[ \t]*{_KEY}[ \t]*\]\]?[ \t]*\r?(?:#[^\n]*+)?$"
# a header with all up to the next one, or what stands before the first
TABLE = rf"(?m)(?:{_HEADER}|\A)(?:{PAIR[4:]}|(?!{_HEADER[4:]})(?:^|(?<=[^\n]))[^\n]*+(?:\n|\z)|\n)*+".replace(
    f"({_KEY})", _KEY).replace(f"({_VALUE})", _VALUE)
INLINE_PAIR = rf"""({_KEY})[ \t]*=[ \t\n]*((?:{_STRING}|{_GROUP}|[^\[\]{{}}"'#,\n]++)*+)"""
ENTRY = "struct<ord:int,table:int,path:array<string>,value:string,in_array:boolean>"


def _unquoted(part: Column) -> Column:
    return F.when(part.rlike("""^["']"""), F.substr(part, F.lit(2), F.length(part) - 2)).otherwise(part)


def key_path(key: Column) -> Column:
    """The parts of a dotted key, quotes taken off."""
    return F.transform(F.regexp_extract_all(key, F.lit(_KEY_PART), 0), _unquoted)


def string_value(value: Column) -> Column:
    """The text of a TOML string, null for any other value."""
    v = F.btrim(value, F.lit(" \t\r\n"))
    long, basic = v.rlike(r"""^(?:\"{3}|'{3})"""), v.startswith('"')
    body = F.when(long, F.regexp_replace(F.substr(v, F.lit(4), F.length(v) - 6), r"^\r?\n", "")).otherwise(
        F.substr(v, F.lit(2), F.length(v) - 2))
    joined = F.regexp_replace(body, r"(?<!\\)((?:\\\\)*)\\[ \t]*\r?\n\s*", "$1")
    for escape, char in ((r"\\n", "\n"), (r"\\t", "\t"), (r"""\\(["\\])""", "$1")):
        joined = F.regexp_replace(joined, rf"(?<!\\)((?:\\\\)*){escape}" if char != "$1" else escape,
                                  char if char == "$1" else f"$1{char}")
    return F.when(v.rlike(rf"^(?:{_STRING})\z"), F.when(basic, joined).otherwise(body))


def array_strings(value: Column) -> Column:
    """The strings of an array value in order; empty for any other value."""
    tokens = F.regexp_extract_all(value, F.lit(rf"{_STRING}|#[^\n]*+"), 0)
    return F.when(F.ltrim(value).startswith("["),
                  F.transform(F.filter(tokens, lambda t: ~t.startswith("#")), string_value)
                  ).otherwise(F.array().cast("array<string>"))


def _pairs(text: Column, regex: str) -> Column:
    """array<struct<path, value>> of the pairs of a table or of an inline table."""
    whole = regex.replace("(?m)^", r"\A")
    return F.transform(F.regexp_extract_all(text, F.lit(regex), 0), lambda p: F.struct(
        key_path(F.regexp_extract(p, whole, 1)).alias("path"),
        F.regexp_extract(p, whole, 2).alias("value")))


def _with_inner(pairs: Column, levels: int) -> Column:
    """Each pair, followed by those of its value if that is an inline table."""
    def one(p: Column) -> Column:
        alone = F.array(F.struct(p["path"].alias("path"), p["value"].alias("value")))
        if not levels:
            return alone
        inner = F.transform(_pairs(F.substr(p["value"], F.lit(2), F.length(p["value"]) - 2), INLINE_PAIR),
                            lambda q: F.struct(F.concat(p["path"], q["path"]).alias("path"),
                                               q["value"].alias("value")))
        return F.when(p["value"].startswith("{"), F.concat(alone, _with_inner(inner, levels - 1))).otherwise(alone)
    return F.flatten(F.transform(pairs, one))


def toml_entries(text: Column) -> Column:
    """array<struct<ord, table, path, value, in_array>>: every pair of a text in order, with its
    full path (table, dotted key, and keys of inline tables down to two levels below it). ``value``
    is the raw value; ``in_array`` marks tables that are elements of an array (``[[x]]``)."""
    tables = F.regexp_extract_all(F.regexp_replace(text, "\r\n", "\n"), F.lit(TABLE), 0)

    def of_table(t: Column, i: Column) -> Column:
        header = F.regexp_extract(t, rf"\A[ \t]*(\[\[?[ \t]*{_KEY}[ \t]*\])", 1)
        at = F.when(header != "", key_path(F.regexp_extract(header, rf"\[[ \t]*({_KEY})", 1))).otherwise(
            F.array().cast("array<string>"))
        # read once for a table: read for each of its pairs, the work is the square of its length
        table = F.struct(at.alias("at"), header.startswith("[[").alias("in_array"),
                         _with_inner(_pairs(t, PAIR), INLINE_LEVELS).alias("pairs"))
        return bind(table, lambda b: F.transform(b["pairs"], lambda p: F.struct(
            i.cast("int").alias("table"), F.concat(b["at"], p["path"]).alias("path"), F.rtrim(p["value"]).alias("value"),
            b["in_array"].alias("in_array"))))

    entries = F.flatten(F.transform(tables, of_table))
    return F.transform(entries, lambda e, i: F.struct(
        i.cast("int").alias("ord"), e["table"].alias("table"), e["path"].alias("path"),
        e["value"].alias("value"), e["in_array"].alias("in_array")))
