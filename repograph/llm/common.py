"""Helpers shared by the corpus operators: stored tables, text keys, components, batches."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repograph.operators.components import connected_components  # noqa: F401
from repograph.session import ensure_checkpoint_dir

#: The six ASCII white-space characters, and the ASCII letter cases.
ASCII_SPACE = "\t\n\x0b\f\r "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``: a lost executor costs only re-reads of the
    table. Columnar and compressed, so later steps read just the columns they need.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure-ASCII strings take the plain (fast) ``lower``."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, LOWER))


def ascii_strip(c: Column) -> Column:
    """Strip the six ASCII white-space characters at both ends."""
    return F.btrim(c, F.lit(ASCII_SPACE))


def arrow_batches(batches: Iterator, max_bytes: int = 8 << 20) -> Iterator:
    """Cut Arrow batches so that a piece holds about ``max_bytes`` or a single row.

    Bounds what a task decodes at once; rows are never dropped or shortened.
    """
    for b in batches:
        n = b.num_rows
        step = max(1, min(n, int(n * max_bytes / max(1, b.nbytes))))
        for i in range(0, n, step):
            yield b.slice(i, step)


def open_fs(path: str):
    """(filesystem, path) for a Hadoop-style path: local, or any store pyarrow can open.

    Tasks use it for files in the shared folder that Spark's own writers cannot make.
    """
    import pyarrow.fs as fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)
