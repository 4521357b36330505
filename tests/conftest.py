import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from repograph.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # PySpark 4 default: ANSI mode on (casts and lookups must not raise on real data).
    s = build_session("local[4]", 4, app_name="repograph-tests",
                      extra={"spark.sql.ansi.enabled": "true"})
    yield s
    s.stop()


def files_df(spark, repo_files: dict[str, dict[str, str]]):
    rows = [(repo, path, content) for repo, fs in repo_files.items() for path, content in fs.items()]
    return spark.createDataFrame(rows, "repo_id string, path string, content string")


def rows(df, *cols):
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((x is None, x if x is None else (type(x).__name__, x))
                                           for x in t))
