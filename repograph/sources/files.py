"""Files tables: from stored parquet, or from checkouts on shared storage.

``read_checkouts`` scans ``<root>/<repo_id>/...`` with the ``binaryFile`` source
(recursive), so each file is one row read by the executors - never by the driver.
Content is decoded as UTF-8; files that are not valid UTF-8 are flagged
(``decodable = false``) and their content is null, as text scans skip them; ``replaced``
holds their text with replacement characters, for readers (the code payload). Symbolic links are not distinguishable in this source.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.functions.text import line_count


def read_files_table(spark: SparkSession, path: str) -> DataFrame:
    """A stored ``files(repo_id, path, content)`` table (parquet)."""
    return spark.read.parquet(path).select("repo_id", "path", "content")


def read_checkouts(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """files(repo_id, path, content, replaced, size_bytes, loc, decodable) for every regular file
    under ``root/<repo_id>/``; size and newline count come from the raw bytes, so they are
    right for undecodable files too."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), r"^file:", "")
    rel = F.regexp_replace(rel, "^" + _quote(base) + "/", "")
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    # Latin-1 maps every byte to one character: newline count = '\n' byte count.
    byte_view = F.decode(F.col("content"), "ISO-8859-1")
    return raw.select(
        F.regexp_extract(rel, r"^([^/]+)/", 1).alias("repo_id"),
        F.regexp_extract(rel, r"^[^/]+/(.*)$", 1).alias("path"),
        F.when(ok, text).alias("content"),
        F.when(~ok, F.make_valid_utf8(text)).alias("replaced"),
        F.col("length").alias("size_bytes"), line_count(byte_view).alias("loc"),
        ok.alias("decodable"))


def _quote(s: str) -> str:
    import re
    return re.escape(s)
