import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import rows
from repograph.streaming import signals as ST

TOUCH = "event_id long, ts timestamp, file_id long"


class Source:
    """A folder that gets one file a batch."""

    def __init__(self, spark):
        self.spark, self.base, self.n = spark, tempfile.mkdtemp(prefix="repograph-stream-", dir="/tmp"), 0
        self.add([])

    def add(self, events):
        df = self.spark.createDataFrame([(i, ts, f) for i, ts, f in events], "event_id long, ts string, file_id long")
        df.select("event_id", F.to_timestamp("ts").alias("ts"), "file_id").coalesce(1).write.mode("append").parquet(
            f"{self.base}/src")
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(TOUCH).parquet(f"{self.base}/src")

    def table(self):
        return self.spark.read.schema(TOUCH).parquet(f"{self.base}/src")


def at(hour, minute=0):
    return f"2024-01-01 {hour:02d}:{minute:02d}:00"


def test_churn_emits_each_window_once_and_counts_late_rows(spark):
    src = Source(spark)
    marks = f"{src.base}/marks"
    ended = ST.end_marks(spark, marks, src.table())

    def run():
        ST.run_append(ST.stream_churn(src.stream().union(ended)), f"{src.base}/out", f"{src.base}/state")
        return rows(spark.read.parquet(f"{src.base}/out").select(
            "file_id", F.date_format("window_start", "HH").alias("h"), "touches"), "h", "file_id", "touches")

    src.add([(1, at(0), 7), (2, at(0, 10), 7), (3, at(0, 50), 8)])
    assert run() == []                                            # nothing is closed yet
    src.add([(4, at(0, 59), 7), (5, at(3), 7)])                   # in time: the watermark is 23:50
    assert run() == [("00", 7, 3), ("00", 8, 1)]                  # 03:00 less one hour closes the first window
    src.add([(6, at(0, 30), 7), (7, at(0, 31), 9), (8, at(2, 30), 8)])   # two late rows, one in time
    assert run() == [("00", 7, 3), ("00", 8, 1)]
    ST.write_end_mark(spark, marks, src.table())
    expected = [("00", 7, 3), ("00", 8, 1), ("02", 8, 1), ("03", 7, 1)]
    assert run() == expected and run() == expected                # a restart emits nothing again
    late = ST.late_touches(src.table(), spark.read.parquet(f"{src.base}/out"))
    assert rows(late, "file_id", "late") == [(7, 1), (9, 1)]


@pytest.mark.parametrize("compact_every", [1, 2, 16])
def test_last_touch_of_batches_out_of_order_over_restarts(spark, compact_every):
    src = Source(spark)
    out, key, order = f"{src.base}/out", ["file_id"], ["last_ts", "last_event_id"]

    def run():
        ST.run_update(ST.stream_last_touch(src.stream()), out, f"{src.base}/state", key, order, compact_every)
        return {r.file_id: r.last_event_id for r in ST.latest_per_key(spark, out, key, order).collect()}

    src.add([(1, at(0), 7), (2, at(0, 10), 7), (3, at(0, 20), 8), (9, None, 8)])
    assert run() == {7: 2, 8: 3}
    src.add([(4, at(0, 5), 7), (5, at(0, 20), 8), (6, at(1), None)])      # older for 7, a tie for 8
    assert run() == {7: 2, 8: 5, None: 6}
    src.add([(1, at(0), 7)])
    assert run() == {7: 2, 8: 5, None: 6}
    changes = [spark.read.parquet(f"{out}/changes/{n:09d}").count() for n in ST._written(spark, f"{out}/changes")]
    assert sum(changes) == 4                                      # (7, 8), (8, null), none


def test_last_touch_leaves_the_state_after_its_time_to_live(spark):
    src = Source(spark)
    out, key, order = f"{src.base}/out", ["file_id"], ["last_ts", "last_event_id"]

    def run():
        ST.run_update(ST.stream_last_touch(src.stream(), ttl_ms=3000), out, f"{src.base}/state", key, order)
        last = ST._written(spark, f"{out}/changes")[-1]
        return rows(spark.read.parquet(f"{out}/changes/{last:09d}"), "file_id", "last_event_id")

    src.add([(1, at(5), 7)])
    assert run() == [(7, 1)]
    time.sleep(4)
    src.add([(2, at(4), 7)])
    assert run() == [(7, 2)]                                      # forgotten, so the older touch is news
    assert rows(ST.latest_per_key(spark, out, key, order), "file_id", "last_event_id") == [(7, 1)]


def test_orphans_of_a_static_table(spark):
    src = Source(spark)
    src.add([(1, at(0), 7), (2, at(0, 10), 7), (3, at(0, 20), 8)])
    files = spark.createDataFrame([(7,)], "file_id long")
    ST.run_append(ST.stream_orphan_refs(src.stream(), files), f"{src.base}/out", f"{src.base}/state")
    assert [r.event_id for r in spark.read.parquet(f"{src.base}/out").collect()] == [3]


def test_orphans_of_a_stream_of_files(spark):
    """A file that comes within the bound after its reference saves it, in any order of arrival."""
    refs, files = Source(spark), Source(spark)
    marks = f"{refs.base}/marks"
    ended, files_ended = (ST.end_marks(spark, marks, refs.table()) for _ in range(2))

    def run():
        found = ST.stream_orphan_refs_changing(refs.stream().union(ended), files.stream().union(files_ended),
                                               keep="2 hours", wait="1 hour")
        ST.run_append(found, f"{refs.base}/out", f"{refs.base}/state")
        return rows(spark.read.parquet(f"{refs.base}/out"), "event_id")

    refs.add([(1, at(5), 7), (2, at(5), 8), (3, at(5), 9), (4, at(5), None)])
    files.add([(0, at(4), 7)])                                    # before its reference, within ``keep``
    assert run() == []
    files.add([(0, at(5, 30), 8), (0, at(2), 9)])                 # after it, within ``wait``; too long before
    refs.add([(5, at(5, 40), 10)])
    assert run() == []
    refs.add([(6, at(8), 8)])
    files.add([(0, at(8), 1)])                                    # both watermarks pass 06:40
    assert run() == [(3,), (4,), (5,)]
    ST.write_end_mark(spark, marks, refs.table())
    assert run() == [(3,), (4,), (5,), (6,)]                      # 8 was sighted 2.5 hours before
