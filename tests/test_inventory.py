from pyspark.sql import functions as F

from conftest import files_df, rows
from repograph.functions import text as T
from repograph.operators import inventory as I


def test_language_and_line_count(spark):
    df = spark.createDataFrame(
        [("a/B.PY", ""), ("x.tar.gz", "a\nb"), ("Makefile", "a\nb\n"), ("s.tsx", "\n\n\n")],
        "path string, content string")
    out = df.select("path", T.detect_language("path").alias("lang"),
                    T.line_count("content").alias("loc"), T.byte_size("content").alias("n"))
    assert rows(out, "path", "lang", "loc", "n") == [
        ("Makefile", "unknown", 2, 4), ("a/B.PY", "python", 0, 0), ("s.tsx", "typescript", 3, 3),
        ("x.tar.gz", "unknown", 1, 3)]


def test_skip_segments_drops_any_segment(spark):
    df = files_df(spark, {"r": {"keep.py": "", "build/x.py": "", "a/node_modules/y.js": "",
                                "a/dist": "", "own/z.py": "", "builder/ok.py": ""}})
    kept = I.skip_segments(df, extra=["own"])
    assert [r.path for r in kept.orderBy("path").collect()] == ["builder/ok.py", "keep.py"]


def test_ignore_rules_last_match_wins(spark):
    df = files_df(spark, {"r": {
        ".gitignore": "# c\n*.log\n!keep.log\nsecret/\n/rootonly.txt\n",
        "a.log": "", "keep.log": "", "sub/b.log": "", "secret/x.py": "", "secret.py": "",
        "rootonly.txt": "", "sub/rootonly.txt": "", "main.py": ""}})
    kept = I.ignore_rules(df, I.gitignore_rules(df))
    assert sorted(r.path for r in kept.collect()) == [
        ".gitignore", "keep.log", "main.py", "secret.py", "sub/rootonly.txt"]


def test_ignore_classes_and_escapes(spark):
    rules = "*.py[cod]\n\\#x\n\\!bang\nlog[!0-9].txt\nv[1-3]/\nkept\\ \na**b\ndoc/**/tmp\n"
    df = files_df(spark, {"r": {".gitignore": rules, "a.pyc": "", "s/b.pyo": "", "a.py": "", "#x": "",
                                "!bang": "", "loga.txt": "", "log1.txt": "", "v2/f": "", "v4/f": "",
                                "kept ": "", "kept": "", "doc/tmp": "", "doc/a/b/tmp/z": "", "axyb": ""},
                          "other": {"a.pyc": ""}})
    kept = I.ignore_rules(df, I.gitignore_rules(df))
    assert sorted((r.repo_id, r.path) for r in kept.collect()) == [
        ("other", "a.pyc"), ("r", ".gitignore"), ("r", "a.py"), ("r", "kept"), ("r", "log1.txt"), ("r", "v4/f")]


def test_ids_past_pad_width_and_modules(spark):
    paths = {f"d{i % 3}/f{i:05d}.py": "" for i in range(10_050)}
    paths["top.md"] = "x\n"
    inv = I.file_inventory(files_df(spark, {"big": paths}), use_ignore_file=False)
    ids = I.file_ids(inv)
    got = {r.path: r.file_id for r in ids.collect()}
    assert got["d0/f00000.py"] == "f0001"
    assert got["top.md"] == "f10051"
    assert len(set(got.values())) == len(got)
    mf = I.module_files(ids)
    mods = {r.module_path: r.module_id for r in mf.select("module_path", "module_id").distinct().collect()}
    assert mods == {".": "m001", "d0": "m002", "d1": "m003", "d2": "m004"}


def test_focus_prunes_modules_keeps_ids(spark):
    df = files_df(spark, {"r": {"a.py": "", "src/x.py": "", "src/y/z.py": "", "srcx/q.py": ""}})
    files = I.file_ids(I.file_inventory(df, use_ignore_file=False))
    kept, mf = I.focus_subtree(files, I.module_files(files), "src/")
    assert rows(kept, "path", "file_id") == [("src/x.py", "f0002"), ("src/y/z.py", "f0003")]
    assert sorted(r.module_path for r in mf.collect()) == ["src", "src/y"]


def test_normalize_path_and_suffix(spark):
    df = spark.createDataFrame([("a/./b/../c",), ("../../x",), ("a//b/",), ("dir/.py",)], "p string")
    out = df.select("p", T.normalize_path("p").alias("n"), T.suffix("p").alias("s"))
    assert rows(out, "p", "n", "s") == [("../../x", "x", ""), ("a/./b/../c", "a/c", ""),
                                        ("a//b/", "a/b", ""), ("dir/.py", "dir/.py", "")]


def test_split_lines_python_semantics(spark):
    df = spark.createDataFrame([("a\r\nb\rc\x0cd\n",), ("",), ("x",)], "t string")
    out = [r.l for r in df.select(T.split_lines("t").alias("l")).collect()]
    assert out == [["a", "b", "c", "d"], [], ["x"]]


def test_utf8_truncate_character_boundary(spark):
    df = spark.createDataFrame([("aé" * 3,)], "t string")
    cut = df.select(T.utf8_truncate("t", 5).alias("c"), T.utf8_truncate("t", 6).alias("d")).first()
    assert cut.c == "aéa" and cut.d == "aéaé"[:4] and len(cut.d.encode()) <= 6
    assert df.select(F.octet_length(T.utf8_truncate("t", 2)).alias("n")).first().n == 1
