"""Structured Streaming forms of the history signals (no reference counterpart).

Touches arrive as a stream ``(event_id, ts, file_id)``; these operators keep state in
Spark's state store and survive restarts through their checkpoint location:

* ``stream_churn`` - touches per file per tumbling event-time window in append mode: the
  watermark closes a window, which is emitted once and leaves the state; later rows of it are
  dropped, and ``late_touches`` accounts for them;
* ``stream_last_touch`` - latest touch per file (ties: the largest event) in a keyed value state
  with a time to live; only changes are emitted;
* ``stream_orphan_refs`` - references checked against a static facts table
  (stream-static anti join), append mode;
* ``stream_orphan_refs_changing`` - references checked against a stream of file sightings
  (stream-stream outer join bounded in time on both sides), append mode.

``end_marks`` is the end of a finite input: a row beyond all others, which closes what a
watermark still holds open.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END = "9999-01-01 00:00:00"
COMPACT_EVERY = 16            # batches after which an update table is merged into a new base


def parquet_stream(spark: SparkSession, folder: str, file_glob: str,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over the parquet files of ``folder`` matching ``file_glob``."""
    schema = spark.read.parquet(f"{folder}/{file_glob}").schema
    r = spark.readStream.option("pathGlobFilter", file_glob).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


def end_marks(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream of end marks with the columns of ``like``, to be united with it. It is empty
    until ``write_end_mark`` puts one into ``folder``. Each side of a join needs a stream of its
    own, from a call of its own: a source that stands twice in a query is read once."""
    spark.createDataFrame([], like.schema).write.mode("append").parquet(folder)
    return spark.readStream.schema(like.schema).parquet(folder)


def write_end_mark(spark: SparkSession, folder: str, like: DataFrame, ts_col: str = "ts") -> None:
    """Say that the input has ended: a row whose time is after all others. Its other columns are
    zero or empty and not null, or the planner's null filters would take it out too early; its
    own window or join bound never closes, so it is never emitted."""
    def value(f):
        if f.name == ts_col:
            return F.lit(END).cast("timestamp")
        return F.lit("0" if isinstance(f.dataType, Ty.NumericType) else "").cast(f.dataType)
    spark.range(1).select(*[value(f).alias(f.name) for f in like.schema]).write.mode("append").parquet(folder)


def ntz_as_utc(spark: SparkSession, col: str):
    """A zone-less timestamp read as UTC wall-clock time (independent of the session
    time zone, which a plain cast would apply)."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.from_utc_timestamp(F.col(col).cast("timestamp"), tz)


def utc_text(spark: SparkSession, col: str, fmt: str):
    """Render an instant as its UTC wall-clock text."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    return F.date_format(F.to_utc_timestamp(F.col(col), tz), fmt)


def stream_churn(touches: DataFrame, window: str = "1 hour", watermark: str = "1 hour"
                 ) -> DataFrame:
    """(file_id, window_start, window_end, touches); in append mode each window appears once,
    when the watermark has passed its end."""
    return (touches.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "file_id")
            .agg(F.count(F.lit(1)).alias("touches"))
            .select("file_id", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "touches"))


def late_touches(touches: DataFrame, closed: DataFrame, window: str = "1 hour") -> DataFrame:
    """(file_id, window_start, late): rows of an ended stream that came after their window had
    been closed, from its whole input as a table and the windows that were emitted."""
    arrived = touches.where(F.col("file_id").isNotNull()).groupBy(
        F.window("ts", window)["start"].alias("window_start"), "file_id").agg(F.count(F.lit(1)).alias("n"))
    counted = closed.select("window_start", "file_id", "touches")
    late = F.col("n") - F.coalesce("touches", F.lit(0))
    return arrived.join(counted, ["window_start", "file_id"], "left").select(
        "file_id", "window_start", late.alias("late")).where(F.col("late") > 0)


class _LastTouch(StatefulProcessor):
    """Value state (ts, event_id) of a file; a row leaves only when it replaces the state."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp, event_id long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get() if self.last.exists() else None
        best = (pd.Timestamp(before[0]), int(before[1])) if before else None
        new = best
        for batch in rows:
            i = batch.sort_values(["ts", "event_id"]).iloc[-1]
            here = (pd.Timestamp(i["ts"]), int(i["event_id"]))
            if new is None or here > new:
                new = here
        if new != best:
            self.last.update((new[0].to_pydatetime(), new[1]))
            yield pd.DataFrame({"file_id": [key[0]], "last_ts": [new[0]], "last_event_id": [new[1]]})

    def close(self) -> None:
        pass


def stream_last_touch(touches: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(file_id, last_ts, last_event_id) whenever a file's last touch changes (update mode).

    State lives in RocksDB (see ``run_update``), so it is not bounded by memory. With ``ttl_ms`` a
    file that was not touched for that long leaves the state; its next touch is emitted again
    even if it is an older one, so readers take the largest (``latest_per_key``). Rows without
    time or event are ignored; rows without file are one file.
    """
    file_type = touches.schema["file_id"].dataType
    out = Ty.StructType([Ty.StructField("file_id", file_type), Ty.StructField("last_ts", Ty.TimestampType()),
                         Ty.StructField("last_event_id", Ty.LongType())])
    rows = touches.where(F.col("ts").isNotNull() & F.col("event_id").isNotNull()).select("file_id", "ts", "event_id")
    return rows.groupBy("file_id").transformWithStateInPandas(
        _LastTouch(ttl_ms), outputStructType=out, outputMode="Update",
        timeMode="None" if ttl_ms is None else "ProcessingTime")


def stream_orphan_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Stream rows whose ``file_id`` is unknown to the static ``files`` table."""
    return refs.join(files.select("file_id").distinct(), "file_id", "left_anti")


def stream_orphan_refs_changing(refs: DataFrame, sightings: DataFrame, keep: str = "24 hours",
                                wait: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """References ``(event_id, ts, file_id)`` to a file that was not sighted (``(ts, file_id)``)
    between ``keep`` before and ``wait`` after them.

    A reference that comes before its file is no orphan until ``wait`` has passed, and a file's
    sighting leaves the state after ``keep``: both sides of the join are bounded by the
    watermark. Each orphan is emitted once; a reference without file is one.
    """
    r = refs.select("event_id", "ts", "file_id").withWatermark("ts", watermark)
    s = sightings.select(F.col("ts").alias("seen_ts"), F.col("file_id").alias("seen_id")).withWatermark(
        "seen_ts", watermark)
    met = ((F.col("file_id") == F.col("seen_id"))
           & (F.col("seen_ts") >= F.col("ts") - F.expr(f"INTERVAL {keep}"))
           & (F.col("seen_ts") <= F.col("ts") + F.expr(f"INTERVAL {wait}")))
    return r.join(s, met, "left_outer").where(F.col("seen_ts").isNull()).select("event_id", "ts", "file_id")


def run_append(sdf: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Drive a stream over all available input into a parquet table (append mode); returns the
    progress of its batches."""
    q = (sdf.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q.recentProgress


def run_update(sdf: DataFrame, out: str, checkpoint: str, key: list[str], order: list[str],
               compact_every: int = COMPACT_EVERY) -> None:
    """Drive an update-mode stream into a table of changes, read by ``latest_per_key``.

    A batch overwrites its own folder, so a replayed batch changes nothing. Every
    ``compact_every`` batches the changes are merged into a new base; readers then take the
    newest base and the few batches after it.
    """
    spark = sdf.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/{batch_id:09d}")
        if (batch_id + 1) % compact_every == 0:
            latest_per_key(spark, out, key, order, batch_id).write.mode("overwrite").parquet(
                f"{out}/base/{batch_id:09d}")

    # without batches that only look at the clock: with a time to live they would never end
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        q = (sdf.writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    q.awaitTermination()


def _written(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished tables in a folder of any store that Spark can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def latest_per_key(spark: SparkSession, out: str, key: list[str], order: list[str],
                   upto: int | None = None) -> DataFrame:
    """The row with the largest ``order`` columns of each key, from the newest base and the
    changes after it."""
    bases = [b for b in _written(spark, f"{out}/base") if upto is None or b < upto]
    changes = [c for c in _written(spark, f"{out}/changes")
               if c > max(bases, default=-1) and (upto is None or c <= upto)]
    paths = [f"{out}/base/{b:09d}" for b in bases[-1:]] + [f"{out}/changes/{c:09d}" for c in changes]
    df = spark.read.parquet(*paths)
    values = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("v")
    return df.groupBy(*key).agg(best).select(*key, *[F.col(f"v.{c}").alias(c) for c in values])
