"""Commit history from exported log text (``git log --no-renames --name-only`` with a
record separator before each commit and a field separator between hash and date).

The export arrives as files of any size (``read_log_exports``: Spark's text source splits at the
record separator, so one file is read by many tasks), or as chunks ``(repo_id, chunk_no, text)``
in log order (chunk 0 holds the newest commits) of whole records (``commit_log_rows``). ``seq``
(1 = newest) is a positional id over the records' places, computed without a per-repo sort in
one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repograph.functions import text as T
from repograph.operators.ids import positional_ids
from repograph.session import store

# Fixed separators of the export format.
RECORD_SEP = "\u001e"
FIELD_SEP = "\u001f"


def _records(records: DataFrame, *place: str) -> DataFrame:
    """(repo_id, *place, commit_hash, committed_at, body) of ``records(repo_id, block, *place)``."""
    records = records.withColumn("block", F.btrim("block", F.lit("\n"))).where(F.col("block") != "")
    header = F.substring_index("block", "\n", 1)
    body = F.when(F.instr("block", "\n") > 0,
                  F.expr("substring(block, instr(block, '\n') + 1)")).otherwise(F.lit(""))
    return (records.select("repo_id", *place, header.alias("header"), body.alias("body"))
            .where(F.instr("header", FIELD_SEP) > 0)
            .select("repo_id", *place,
                    F.substring_index("header", FIELD_SEP, 1).alias("commit_hash"),
                    F.expr(f"substring(header, instr(header, '{FIELD_SEP}') + 1)")
                    .alias("committed_at"), "body"))


def _path_rows(recs: DataFrame) -> DataFrame:
    """(repo_id, commit_hash, seq, committed_at, path) of numbered records."""
    rows = recs.select("repo_id", "commit_hash", "seq", "committed_at",
                       F.explode(T.split_lines("body")).alias("raw"))
    return (rows.withColumn("path", T.py_strip("raw")).where(F.col("path") != "")
            .drop("raw"))


def commit_log_rows(chunks: DataFrame) -> DataFrame:
    """One row per (commit, path) of export chunks. Blank lines are dropped; a record whose
    header lacks the field separator is dropped."""
    recs = _records(chunks.select("repo_id", "chunk_no", F.posexplode(F.split("text", RECORD_SEP, -1))
                                  .alias("pos", "block")), "chunk_no", "pos")
    return _path_rows(positional_ids(recs, ["repo_id"], ["chunk_no", "pos"], "seq"))


def read_log_exports(spark: SparkSession, root: str) -> DataFrame:
    """The same rows from exported files ``<root>/<repo_id>/<file>`` (or ``repo_id=<id>``); the
    files of a repository follow one another in the order of their names.

    A file is split at record separators between tasks of ``spark.sql.files.maxPartitionBytes``.
    A record's place is its file, the start of its split, and its number inside the task that
    reads the split. Only the splits are counted and numbered, by a first pass over the text; the
    records get their numbers as they are read again, and are neither sorted nor stored.
    """
    read = spark.read.option("lineSep", RECORD_SEP).option("recursiveFileLookup", "true").text(root)
    folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    records = read.select(F.try_url_decode(F.regexp_replace(folder, "^repo_id=", "")).alias("repo_id"),
                          F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                          F.col("value").alias("block"))
    # consecutive inside a split, whatever the number of the task that reads it
    recs = _records(records, "file", "split").withColumn("nth", F.monotonically_increasing_id())
    place = ["repo_id", "file", "split"]
    before = Window.partitionBy("repo_id").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    splits = recs.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    splits = store(splits.select(*place, (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first"))
                                 .alias("shift")), "splits")
    numbered = recs.join(splits, place).withColumn("seq", (F.col("nth") + F.col("shift")).cast("bigint"))
    return _path_rows(numbered)


def write_log_exports(chunks: DataFrame, root: str) -> None:
    """Write chunks as export files that ``read_log_exports`` reads, in log order."""
    (chunks.repartitionByRange("repo_id", "chunk_no").sortWithinPartitions("repo_id", "chunk_no")
     .select("repo_id", F.col("text").alias("value")).write.partitionBy("repo_id").option("lineSep", RECORD_SEP).text(root))


def log_chunks_from_commits(commits: DataFrame, chunk_commits: int = 500) -> DataFrame:
    """Render commits(repo_id, commit_hash, committed_at, sort_ts, tiebreak, path) as
    export chunks of ``chunk_commits`` commits each, newest first (sort_ts then tiebreak
    descending): a test-data and round-trip helper. The number of chunks grows with a
    repository's history, their size does not."""
    per_commit = (commits.groupBy("repo_id", "commit_hash", "committed_at", "sort_ts", "tiebreak")
                  .agg(F.array_sort(F.collect_list("path")).alias("paths")))
    per_commit = positional_ids(per_commit, ["repo_id"], [F.col("sort_ts").desc(), F.col("tiebreak").desc()], "n")
    rec = F.concat(F.lit(RECORD_SEP), "commit_hash", F.lit(FIELD_SEP), "committed_at",
                   F.lit("\n"), F.array_join("paths", "\n"), F.lit("\n\n"))
    return (per_commit.groupBy("repo_id", F.floor((F.col("n") - 1) / chunk_commits).alias("chunk_no"))
            .agg(F.array_sort(F.collect_list(F.struct("n", rec.alias("rec")))).alias("recs"))
            .select("repo_id", "chunk_no",
                    F.array_join(F.transform("recs", lambda r: r["rec"]), "").alias("text")))
