import random

from repograph.llm.line_dedup import deduped_documents, line_dedup
from .helpers import edge_docs, empty_docs

SPACE = "\t\n\x0b\f\r "
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    first = {}
    def key(line):
        return line.strip(SPACE).translate(LOW)
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first.setdefault(k, set()).add(float("inf") if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        me = float("inf") if d is None else d
        kept = [x for x in lines if len(key(x)) < 10 or me == min(first[key(x)])]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def run(df):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in line_dedup(df).collect()), key=str)


def test_matches_brute_force(spark):
    r = random.Random(5)
    pool = [f"Line number {i} with text" for i in range(12)] + ["short", "", "  Line NUMBER 3 with text\t",
                                                                "Élan vital toujours", "ÉLAN vital toujours"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(8)))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)


def test_edge_rows(spark):
    df, rows, names = edge_docs(spark)
    assert run(df) == brute([r[:2] for r in rows])
    assert set(names) <= set(line_dedup(df).columns)
    assert run(empty_docs(spark)) == []


def test_stage_keeps_rows_columns_and_null_text(spark):
    df, rows, _ = edge_docs(spark)
    out = deduped_documents(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert out.where("doc_id = 2").first().text is None


def test_hot_line(spark):
    rows = [(i, f"the very same line\nown line of document {i}") for i in range(3000)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.selectExpr("sum(n_dropped) s").first().s == 2999
