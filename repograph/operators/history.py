"""Git history signals: churn, last touch, co-change coupling.

Input: ``commits(repo_id, commit_id, seq, committed_at, path)`` where ``seq`` is the
position in log order (1 = newest). All outputs are keyed by ``repo_id``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.session import store

GROUP_PAIRS = 1 << 22         # pairs that one group of a repository counts


def indexed_only(commits: DataFrame, files: DataFrame) -> DataFrame:
    """History rows for paths present in the inventory, with their file id."""
    return commits.join(files.select("repo_id", "path", "file_id"), ["repo_id", "path"])


def touches(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct (repo_id, commit_id, seq, committed_at, file_id)."""
    return indexed_only(commits, files).select(
        "repo_id", "commit_id", "seq", "committed_at", "file_id").distinct()


def churn(touch: DataFrame) -> DataFrame:
    """Commits touching each file."""
    return touch.groupBy("repo_id", "file_id").agg(F.count(F.lit(1)).alias("churn"))


def last_modified(touch: DataFrame) -> DataFrame:
    """Date of the first commit in log order (not the max date)."""
    return touch.groupBy("repo_id", "file_id").agg(
        F.min_by("committed_at", "seq").alias("last_modified"))


def git_signals(touch: DataFrame) -> DataFrame:
    """Churn and last touch of each file in one aggregate."""
    return touch.groupBy("repo_id", "file_id").agg(
        F.count(F.lit(1)).alias("churn"), F.min_by("committed_at", "seq").alias("last_modified"))


def apply_git_signals(files: DataFrame, signals: DataFrame) -> DataFrame:
    """Attach churn (default 0) and last_modified (null when never touched)."""
    return files.join(signals, ["repo_id", "file_id"], "left").withColumn(
        "churn", F.coalesce(F.col("churn"), F.lit(0)).cast("bigint"))


def cochange_pairs(touch: DataFrame, item_col: str = "file_id", min_count: int = 2,
                   group_pairs: int = GROUP_PAIRS, recurring: bool = False) -> DataFrame:
    """Unordered pairs (a < b) of distinct items changed in the same commit, counted over
    commits, kept at ``count >= min_count``.

    Almost all pairs occur once, so pairs are never shuffled: they are counted where they are
    made. A repository's items are hashed into as many blocks as keep each pair of blocks at
    about ``group_pairs`` pairs (one block for most repositories); a commit is a row for each
    pair of its blocks with the items as arrays, and these rows are dealt by (repository, block
    pair). All occurrences of a pair meet in that one group, whose aggregate needs no further
    exchange. A large commit or repository is spread over its block pairs.

    With ``recurring``, items are few and the same pairs occur in many commits: pairs are counted
    in the tasks that read the commits, and only the counts meet.
    """
    t = store(touch.select("repo_id", "commit_id", F.col(item_col).alias("item")).distinct(),
              "touches")
    size = t.groupBy("repo_id", "commit_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = store(size.groupBy("repo_id").agg(
        F.ceil(F.sqrt(F.sum(F.col("n") * (F.col("n") - 1.0)) / group_pairs)).alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("item"), F.greatest("blocks", F.lit(1)))
    parts = store(t.join(blocks, "repo_id").groupBy("repo_id", "commit_id", "blocks", own.alias("own"))
                  .agg(F.array_sort(F.collect_list("item")).alias("items")), "commit-blocks")
    whole = parts.where(F.col("blocks") <= 1).select(
        "repo_id", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"),
        F.col("items").alias("x"), F.col("items").alias("y"))
    split = parts.where(F.col("blocks") > 1)
    a, b = split.alias("a"), split.alias("b")
    met = a.join(b, ["repo_id", "commit_id"]).where(F.col("a.own") <= F.col("b.own")).select(
        "repo_id", F.col("a.own").alias("lo"), F.col("b.own").alias("hi"),
        F.col("a.items").alias("x"), F.col("b.items").alias("y"))
    key = ["repo_id", "lo", "hi"]
    dealt = whole.where(F.size("x") > 1).union(met)
    if recurring:
        key = ["repo_id"]
    else:
        dealt = dealt.repartition(*key)
    inside = F.col("lo") == F.col("hi")              # both arrays are the same: each pair once
    pairs = (dealt.select("repo_id", "lo", "hi", "y", F.posexplode("x").alias("at", "v"))
             .select(*key, "v", F.explode(F.when(inside, F.slice("y", F.col("at") + 2, F.size("y")))
                                          .otherwise(F.col("y"))).alias("w"))
             .select(*key, F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")))
    return (pairs.groupBy(*key, "a", "b").agg(F.count(F.lit(1)).cast("bigint").alias("co_change_count"))
            .where(F.col("co_change_count") >= min_count)
            .select("repo_id", "a", "b", "co_change_count"))


def module_coupling(touch: DataFrame, mod_files: DataFrame, min_count: int = 2
                    ) -> DataFrame:
    """Co-change at module level: a commit touches a module when it touches a file in it."""
    t = touch.join(mod_files.select("repo_id", "file_id", "module_id"), ["repo_id", "file_id"])
    return cochange_pairs(t, "module_id", min_count, recurring=True)
