import random

from pyspark.sql import functions as F

from conftest import rows
from repograph.operators import history as H
from repograph.sources import gitlog as GL


def _touches(spark, commits):
    data = [("r", c, seq, date, f) for seq, (c, date, fs) in enumerate(commits, start=1) for f in fs]
    return spark.createDataFrame(data, "repo_id string, commit_id string, seq long, "
                                       "committed_at string, file_id string")


def test_churn_last_touch_and_pair_threshold(spark):
    t = _touches(spark, [("c4", "2020-06-15", ["a"]), ("c3", "2020-03-01", ["a", "c"]),
                         ("c2", "2020-01-02", ["a", "b"]), ("c1", "2020-01-01", ["a", "b"])])
    assert rows(H.churn(t), "file_id", "churn") == [("a", 4), ("b", 2), ("c", 1)]
    assert rows(H.last_modified(t), "file_id", "last_modified") == [
        ("a", "2020-06-15"), ("b", "2020-01-02"), ("c", "2020-03-01")]
    assert rows(H.cochange_pairs(t), "a", "b", "co_change_count") == [("a", "b", 2)]


def test_last_modified_follows_log_order_not_max_date(spark):
    t = _touches(spark, [("c2", "2019-01-01", ["a"]), ("c1", "2021-01-01", ["a"])])
    assert rows(H.last_modified(t), "last_modified") == [("2019-01-01",)]


def _brute(commits, min_count=2):
    from collections import Counter
    from itertools import combinations
    cnt = Counter()
    for _, _, fs in commits:
        for a, b in combinations(sorted(set(fs)), 2):
            cnt[(a, b)] += 1
    return sorted((a, b, n) for (a, b), n in cnt.items() if n >= min_count)


def test_block_pairs_are_exact(spark):
    rnd = random.Random(7)
    files = [f"f{i:03d}" for i in range(40)]
    commits = []
    for i in range(60):
        size = rnd.choice([1, 2, 3, 3, 4, 12, 25])
        commits.append((f"c{i}", "2020-01-01", rnd.sample(files, size)))
    t = _touches(spark, commits)
    for group in (3, 300, 1 << 22):
        got = rows(H.cochange_pairs(t, group_pairs=group), "a", "b", "co_change_count")
        assert got == _brute(commits), group
    got = rows(H.cochange_pairs(t, min_count=1, group_pairs=40), "a", "b", "co_change_count")
    assert got == _brute(commits, 1)
    assert H.cochange_pairs(t.where("false")).count() == 0


def test_pairs_are_counted_without_a_shuffle_of_pairs(spark):
    t = _touches(spark, [(f"c{i}", "2020-01-01", ["a", "b", f"d{i}"]) for i in range(5)])
    plan = H.cochange_pairs(t, group_pairs=2)._jdf.queryExecution().optimizedPlan().toString()
    counted, dealt = plan.index("Aggregate [repo_id"), plan.index("RepartitionByExpression [repo_id")
    assert counted < plan.index("Generate explode") < dealt
    physical = H.cochange_pairs(t, group_pairs=2)._jdf.queryExecution().sparkPlan().toString()
    top = physical[:physical.index("Generate explode")]
    assert top.count("HashAggregate") == 2 and "Exchange" not in top


def test_commit_log_rows(spark):
    rs, fs = GL.RECORD_SEP, GL.FIELD_SEP
    text0 = f"{rs}h3{fs}2020-03-01\n\na.py\n  b.py  \n\n{rs}junk header\nx.py\n"
    text1 = f"{rs}h1{fs}2020-01-01\na.py\n"
    chunks = spark.createDataFrame([("r", 0, text0), ("r", 1, text1)],
                                   "repo_id string, chunk_no int, text string")
    out = GL.commit_log_rows(chunks)
    assert rows(out, "commit_hash", "seq", "committed_at", "path") == [
        ("h1", 2, "2020-01-01", "a.py"), ("h3", 1, "2020-03-01", "a.py"),
        ("h3", 1, "2020-03-01", "b.py")]


def test_one_large_export_is_read_by_many_tasks(spark):
    """Rows, numbers and order equal those of the same text in chunks, wherever files are cut."""
    import os
    import tempfile
    rs, fs = GL.RECORD_SEP, GL.FIELD_SEP
    text = "".join(f"{rs}h{i}{fs}2020-01-{i % 28 + 1:02d}\n\n" + "".join(f"dir é/f{i % 7 + k}.py\n" for k in range(i % 4))
                   + "\n" for i in range(3000)) + f"{rs}junk header\nx.py\n"
    root = tempfile.mkdtemp(prefix="repograph-log-", dir="/tmp")
    cut = text.index(rs, len(text) // 3)
    for repo, name, part in (("big repo", "a.log", text[:cut]), ("big repo", "b.log", text[cut:]), ("s", "x", f"{rs}h{fs}d\np\n")):
        os.makedirs(f"{root}/{repo}", exist_ok=True)
        with open(f"{root}/{repo}/{name}", "w", encoding="utf-8") as f:
            f.write(part)
    chunks = spark.createDataFrame([("big repo", 0, text), ("s", 0, f"{rs}h{fs}d\np\n")], "repo_id string, chunk_no int, text string")
    cols = ["repo_id", "commit_hash", "seq", "committed_at", "path"]
    expected = rows(GL.commit_log_rows(chunks), *cols)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        assert spark.read.option("lineSep", rs).option("recursiveFileLookup", "true").text(root).rdd.getNumPartitions() > 20
        assert rows(GL.read_log_exports(spark, root), *cols) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_positional_ids_stable_across_partitioning(spark):
    from repograph.operators.ids import positional_ids
    df = spark.range(5000).select(F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("g"),
                                  F.col("id").cast("string").alias("k"))
    outs = []
    for n in (1, 7, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        outs.append(rows(positional_ids(df.repartition(n), ["g"], ["k"], "pos"), "g", "k", "pos"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert outs[0] == outs[1] == outs[2]
    by_g = {}
    for g, k, p in outs[0]:
        by_g.setdefault(g, []).append((k, p))
    for g, kp in by_g.items():
        assert [p for _, p in sorted(kp)] == list(range(1, len(kp) + 1))


def test_facts_without_history(spark):
    from conftest import files_df
    from repograph.plans.extract import Facts
    f = Facts(files_df(spark, {"r": {"a.py": "import b\n", "b.py": ""}}))
    assert rows(f.files_with_signals, "path", "churn", "last_modified") == [
        ("a.py", 0, None), ("b.py", 0, None)]
    assert f.coupling.count() == 0


def test_log_records_are_trimmed_in_linear_time(spark):
    """Line feeds inside a record are passed once; those at its ends are no part of it."""
    import time
    from repograph.sources import gitlog as GL
    gap = "\n" * 300_000
    text = f"{GL.RECORD_SEP}\n\nc2{GL.FIELD_SEP}d2\n\na.py{gap}b.py\n\n{GL.RECORD_SEP}c1{GL.FIELD_SEP}d1\nc.py\n"
    chunks = spark.createDataFrame([("r", 0, text)], "repo_id string, chunk_no long, text string")
    t = time.time()
    got = [tuple(r) for r in GL.commit_log_rows(chunks).select("commit_hash", "seq", "committed_at", "path").collect()]
    assert sorted(got) == [("c1", 2, "d1", "c.py"), ("c2", 1, "d2", "a.py"), ("c2", 1, "d2", "b.py")]
    assert time.time() - t < 30


def test_recurring_pairs_are_counted_where_commits_are_read(spark):
    rnd = random.Random(3)
    commits = [(f"c{i}", "2020-01-01", rnd.sample([f"m{k}" for k in range(9)], rnd.choice([1, 2, 3, 7]))) for i in range(80)]
    t = _touches(spark, commits)
    for group in (3, 1 << 22):
        got = H.cochange_pairs(t, group_pairs=group, recurring=True)
        assert rows(got, "a", "b", "co_change_count") == _brute(commits), group
    mods = spark.createDataFrame([("r", f"m{k}", f"m{k}") for k in range(9)], "repo_id string, file_id string, module_id string")
    plan = H.module_coupling(t, mods)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan


def test_export_records_are_neither_shuffled_nor_stored(spark, monkeypatch, tmp_path):
    """Only the places of splits are; files in one task, cut files and files without a record are numbered in order."""
    from pyspark.sql.readwriter import DataFrameWriter
    rs, fs = GL.RECORD_SEP, GL.FIELD_SEP
    expected, seq = [], {"r": 0, "s": 0}
    for i in range(40):
        repo = "r" if i % 3 else "s"
        text = "" if i % 5 == 0 else "junk\n"
        for k in range(0 if i % 7 == 0 else i):
            seq[repo] += 1
            text += f"{rs}h{i}-{k}{fs}d{i}\n\na{k}.py\nb.py\n{rs}no header\nx\n"
            expected += [(repo, f"h{i}-{k}", seq[repo], f"d{i}", p) for p in (f"a{k}.py", "b.py")]
        (tmp_path / f"repo_id={repo}").mkdir(exist_ok=True)
        (tmp_path / f"repo_id={repo}" / f"part-{i:02d}.txt").write_text(text)
    written, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, **kw: written.append(self._df.columns) or write(self, path, **kw))
    cols = ["repo_id", "commit_hash", "seq", "committed_at", "path"]
    for size in ("200", "3000", "100000000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            out = GL.read_log_exports(spark, str(tmp_path))
            assert rows(out, *cols) == sorted(expected)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange rangepartitioning") == 0
    assert written == [["repo_id", "file", "split", "shift"]] * 3
