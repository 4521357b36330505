"""Inventory: kept files, languages, line counts, positional ids, directory modules."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.functions import text as T
from repograph.operators.ids import positional_ids
from repograph.session import store


def skip_set(extra: list[str] | None = None) -> list[str]:
    """Fixed skip set united with the caller's extras, sorted."""
    return sorted(set(T.ALWAYS_SKIP) | set(extra or []))


def skip_segments(files: DataFrame, extra: list[str] | None = None,
                  path_col: str = "path") -> DataFrame:
    """Drop a path when ANY of its segments (directory or file name) is in the skip set."""
    skip = F.array(*[F.lit(s) for s in skip_set(extra)])
    return files.where(~F.arrays_overlap(F.split(F.col(path_col), "/"), skip))


def gitignore_rules(files: DataFrame) -> DataFrame:
    """Rules of each repo's ROOT ignore file: (repo_id, rule_no, negated, regex).

    ``*``, ``**``, ``?``, classes (``[a-z]``, ``[!a]``), escapes (``\\#``), a leading ``/`` or
    an inner ``/`` anchors the rule at the root, a trailing ``/`` matches directories only,
    ``!`` re-includes, ``#`` comments and blank lines are skipped, trailing blanks go unless
    escaped. A rule matching a directory matches everything beneath it.
    """
    lines = (files.where(F.col("path") == ".gitignore")
             .select("repo_id", F.posexplode(T.split_lines("content")).alias("pos", "raw"))
             .select("repo_id", (F.col("pos") + 1).alias("rule_no"),
                     F.regexp_replace("raw", r"(?<!\\)[ \t]+$", "").alias("raw"))
             .where((F.col("raw") != "") & ~F.col("raw").startswith("#")))
    negated = F.col("raw").startswith("!")
    pat = F.when(negated, F.expr("substring(raw, 2)")).otherwise(F.col("raw"))
    dir_only = pat.endswith("/")
    pat = F.regexp_replace(pat, "/+$", "")
    anchored = pat.startswith("/") | pat.contains("/")
    pat = F.regexp_replace(pat, "^/", "")
    # The glob's tokens (escape, class, stars with their slashes, any other character) are
    # translated one by one.
    tokens = F.regexp_extract_all(pat, F.lit(r"(?s)\\.|\[!?\]?(?:\\.|[^\]\\])*\]|\*\*/|/\*\*$|\*+|."), 0)
    one = lambda t: (
        F.when(t.rlike(r"(?s)^\\.$"), F.concat(F.lit("\\Q"), F.substring(t, 2, 1), F.lit("\\E")))
        .when(t.rlike(r"(?s)^\[.+\]$"), F.concat(
            F.lit("(?!/)["), F.when(t.startswith("[!"), F.lit("^")).otherwise(F.lit("")),
            F.regexp_replace(F.regexp_replace(t, r"(?s)^\[!?(.*)\]$", "$1"), r"([\[\]&^])", r"\\$1"),
            F.lit("]")))
        .when(t == "**/", F.lit("(?:.*/)?")).when(t == "/**", F.lit("/.*"))
        .when(t == "**", F.lit(".*")).when(t.startswith("*"), F.lit("[^/]*")).when(t == "?", F.lit("[^/]"))
        .otherwise(F.regexp_replace(t, r"([.+^${}()|\[\]\\])", r"\\$1")))
    body = F.array_join(F.transform(tokens, one), "")
    regex = F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), body,
                     F.when(dir_only, F.lit("/.+$")).otherwise(F.lit("(?:/.*)?$")))
    return lines.select("repo_id", "rule_no", negated.alias("negated"), regex.alias("regex"))


def ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop paths whose LAST matching rule is not a negation.

    The rules of a repo (one ignore file) become one array and are evaluated in the file's
    row. They are a small stored table, so the planner knows their size and file rows, which
    may carry content, are shuffled only where the rules are too large to send around.
    """
    per_repo = store(rules.groupBy("repo_id").agg(F.array_sort(F.collect_list(
        F.struct("rule_no", "negated", "regex"))).alias("_rules")), "ignore-rules")
    hit = F.filter("_rules", lambda r: F.regexp_like(F.col("path"), r["regex"]))
    kept = F.col("_rules").isNull() | (F.size(hit) == 0) | F.try_element_at(hit, F.lit(-1))["negated"]
    return files.join(per_repo, "repo_id", "left").where(kept).drop("_rules")


def kept_files(raw: DataFrame, extra_skip: list[str] | None = None,
               use_ignore_file: bool = True) -> DataFrame:
    """Files (with content) that neither the skip set nor the ignore file drops."""
    kept = skip_segments(raw, extra_skip)
    return ignore_rules(kept, gitignore_rules(raw)) if use_ignore_file else kept


def measured(kept: DataFrame) -> DataFrame:
    """One row per kept file: repo_id, path, lang, loc, size_bytes (no content). A source
    that already measured the raw bytes (``loc``/``size_bytes`` columns) is trusted."""
    loc = F.col("loc") if "loc" in kept.columns else T.line_count("content")
    size = F.col("size_bytes") if "size_bytes" in kept.columns else T.byte_size("content")
    return kept.select("repo_id", "path", T.detect_language("path").alias("lang"),
                       loc.cast("bigint").alias("loc"), size.cast("bigint").alias("size_bytes"))


def file_inventory(raw: DataFrame, extra_skip: list[str] | None = None,
                   use_ignore_file: bool = True) -> DataFrame:
    """The inventory of raw files: what is kept, measured."""
    return measured(kept_files(raw, extra_skip, use_ignore_file))


def file_ids(inventory: DataFrame) -> DataFrame:
    """Positional ``f%04d`` id by path order inside each repo."""
    return positional_ids(inventory, ["repo_id"], ["path"], "file_id", "f", 4)


def module_files(files: DataFrame) -> DataFrame:
    """(repo_id, module_id, module_path, file_id): files grouped by DIRECT parent dir."""
    with_dir = files.select("repo_id", "file_id", T.parent_dir("path").alias("module_path"))
    mods = with_dir.select("repo_id", "module_path").distinct()
    mods = positional_ids(mods, ["repo_id"], ["module_path"], "module_id", "m", 3)
    return with_dir.join(mods, ["repo_id", "module_path"])


def modules(mod_files: DataFrame) -> DataFrame:
    """(repo_id, module_id, path, file_ids sorted, n_files) - the document's array form."""
    return (mod_files.groupBy("repo_id", "module_id", "module_path")
            .agg(F.array_sort(F.collect_list("file_id")).alias("file_ids"),
                 F.count(F.lit(1)).alias("n_files"))
            .withColumnRenamed("module_path", "path"))


def module_summary(mod_files: DataFrame) -> DataFrame:
    """(repo_id, module_id, path, n_files, first_file_id, last_file_id) by partial
    aggregation - no per-directory id list is gathered."""
    return (mod_files.groupBy("repo_id", "module_id", F.col("module_path").alias("path"))
            .agg(F.count(F.lit(1)).alias("n_files"), F.min("file_id").alias("first_file_id"),
                 F.max("file_id").alias("last_file_id")))


def repo_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"),
                                        F.sum("loc").cast("bigint").alias("total_loc"))


def languages_detected(files: DataFrame) -> DataFrame:
    return (files.where(F.col("lang") != "unknown").groupBy("repo_id")
            .agg(F.array_sort(F.collect_set("lang")).alias("languages")))


def focus_subtree(files: DataFrame, mod_files: DataFrame, sub: str
                  ) -> tuple[DataFrame, DataFrame]:
    """Keep files equal to or under ``sub``; ids are not renumbered. Module memberships
    are pruned to kept files, so empty modules (and an emptied root '.') disappear."""
    s = sub.strip("/")
    kept = files.where((F.col("path") == s) | F.col("path").startswith(s + "/"))
    mp = F.col("module_path")
    mf = (mod_files.where((mp == s) | mp.startswith(s + "/") | (mp == "."))
          .join(kept.select("repo_id", "file_id"), ["repo_id", "file_id"], "left_semi"))
    return kept, mf


def scan_eligible(files: DataFrame) -> DataFrame:
    """Files covered by the import scans: 8 extensions by true filename suffix."""
    sfx = T.suffix("path")
    return (files.withColumn("suffix", sfx)
            .where(F.col("suffix").isin(*T.PY_EXTENSIONS, *T.JS_EXTENSIONS))
            .withColumn("family", F.when(F.col("suffix").isin(*T.PY_EXTENSIONS),
                                         F.lit("python")).otherwise(F.lit("js"))))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]
                  ) -> DataFrame:
    """Rows added, removed or changed between two snapshots, compared on natural keys
    (positional ids are NOT stable across snapshots); values compare null-safely."""
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values]).withColumn("_o", F.lit(1))
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values]).withColumn("_n", F.lit(1))
    j = o.join(n, keys, "full_outer")
    same = None
    for v in values:
        eq = F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
        same = eq if same is None else (same & eq)
    status = (F.when(F.col("_o").isNull(), F.lit("added")).when(F.col("_n").isNull(), F.lit("removed"))
              .when(~same, F.lit("changed")).otherwise(F.lit("same")))
    return j.withColumn("status", status).drop("_o", "_n")
