"""Dense positional ids (``f0001``, ``m001``, ``e0001``) without a one-task sort per repo.

A ``row_number()`` window partitioned by ``repo_id`` sorts each whole repository in one
task; a repository holding a third of all files would then sit on one executor. Here the
rows are range-partitioned and sorted globally (many tasks), tagged with
``monotonically_increasing_id`` (partition index in the high bits, position in the low
bits), and stored so that the tags are fixed even if tasks are re-run. A small
table of per-(task, group) counts then gives every group its offset in each task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repograph.functions.text import format_id
from repograph.session import store


def positional_ids(df: DataFrame, group_cols: list[str], order_cols: list,
                   id_col: str, prefix: str | None = None, width: int = 4,
                   number_col: str | None = None) -> DataFrame:
    """Add ``id_col``: the 1-based rank of each row inside ``group_cols`` by ``order_cols``.

    ``order_cols`` must make rows unique inside a group (add a tiebreak otherwise).
    With ``prefix`` the rank is formatted ``prefix%0{width}d``; ``number_col`` keeps the
    raw rank as a BIGINT as well.
    """
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c
                                             for c in order_cols]
    tagged = df.orderBy(*keys).withColumn("_mono", F.monotonically_increasing_id())
    tagged = store(tagged, "tagged")
    tagged = tagged.withColumn("_pid", F.shiftright(F.col("_mono"), 33))
    stats = tagged.groupBy("_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = stats.select(
        "_pid", *group_cols, "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    offsets = store(offsets, "offsets")
    out = tagged.join(offsets, ["_pid", *group_cols])
    n = (F.col("_offset") + F.col("_mono") - F.col("_first") + 1).cast("bigint")
    out = out.withColumn(id_col, format_id(prefix, width, n) if prefix else n)
    if number_col:
        out = out.withColumn(number_col, n)
    return out.drop("_mono", "_pid", "_first", "_offset")


def running_offsets(df: DataFrame, group_cols: list[str], order_cols: list,
                    weight_col: str, out_col: str) -> DataFrame:
    """Add ``out_col``: the sum of ``weight_col`` over the rows BEFORE each row inside
    ``group_cols`` by ``order_cols`` (an exclusive prefix sum), with the same
    range-partition + stored-tags scheme as ``positional_ids``: the prefix inside one task
    range is a window over that bounded range, the prefix of earlier ranges comes from a
    small per-(task, group) table."""
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c
                                             for c in order_cols]
    tagged = store(df.orderBy(*keys).withColumn("_mono", F.monotonically_increasing_id()), "tagged")
    tagged = tagged.withColumn("_pid", F.shiftright(F.col("_mono"), 33))
    inside = Window.partitionBy("_pid", *group_cols).orderBy("_mono").rowsBetween(
        Window.unboundedPreceding, -1)
    local = tagged.withColumn("_local", F.coalesce(F.sum(weight_col).over(inside), F.lit(0)))
    stats = tagged.groupBy("_pid", *group_cols).agg(F.sum(weight_col).alias("_s"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = store(stats.select("_pid", *group_cols,
                                 F.coalesce(F.sum("_s").over(before), F.lit(0))
                                 .alias("_base")), "offsets")
    return (local.join(offsets, ["_pid", *group_cols])
            .withColumn(out_col, (F.col("_base") + F.col("_local")).cast("bigint"))
            .drop("_mono", "_pid", "_local", "_base"))
