"""Two runs of the same query at different shuffle partition counts give equal results."""
from conftest import SF, rows
from repograph.plans.queries import QUERIES


def _run(spark, key, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = QUERIES[key](spark, SF)
        return rows(df, *df.columns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges_and_coupling_are_deterministic(spark):
    for key in ("edge_ids", "cochange_pairs", "merge_deps"):
        assert _run(spark, key, 3) == _run(spark, key, 17), key


def test_queries_run_under_ansi_mode(spark):
    """PySpark 4 sessions default to ANSI mode: casts of non-numeric text and missing
    map keys must not raise."""
    spark.conf.set("spark.sql.ansi.enabled", "true")
    try:
        for key in ("skip_segments", "detect_language", "merge_edges", "code_payload",
                    "snapshot_diff", "main_guard_entry", "poetry_deps"):
            QUERIES[key](spark, SF).count()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
