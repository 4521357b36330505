"""Entrypoints: web-app objects found in Python text, merged with manifest entries."""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ASGI/WSGI application constructors and conventional binding names.
FRAMEWORKS = ["FastAPI", "Flask", "Starlette", "Sanic", "Quart", "Litestar", "Bottle"]
APP_NAMES = ["app", "application", "api", "asgi_app", "wsgi_app", "server"]

_FW = "|".join(FRAMEWORKS)
FW_CALL = rf"(?U)\b({_FW})\s*\("
APP_ASSIGN = rf"(?mU)^(\w+)\s*=\s*({_FW})\s*\("
APP_BIND = rf"(?mU)^({'|'.join(APP_NAMES)})\s*=\s*\w"


def web_entrypoints(contents: DataFrame) -> DataFrame:
    """``.py`` files calling one of the frameworks AND binding an app at module level:
    a direct ``name = Framework(`` wins, else a conventional name bound to anything
    (factory pattern). Kind web; evidence names framework and variable. The cheap
    constructor test runs first, after a plain search for the names (they prune most files)."""
    named = reduce(or_, [F.col("content").contains(name) for name in FRAMEWORKS])
    py = contents.where(F.col("path").endswith(".py") & named & F.col("content").rlike(FW_CALL))
    direct_var = F.regexp_extract("content", APP_ASSIGN, 1)
    direct_fw = F.regexp_extract("content", APP_ASSIGN, 2)
    bind_var = F.regexp_extract("content", APP_BIND, 1)
    first_fw = F.regexp_extract("content", FW_CALL, 1)
    evidence = F.when(direct_var != "", F.concat(
        F.lit("module-level "), direct_fw, F.lit("() app object: "), direct_var)).when(
        bind_var != "", F.concat(F.lit("module-level '"), bind_var, F.lit("' bound to a "),
                                 first_fw, F.lit("() application (factory pattern)")))
    return (py.select("repo_id", "path", F.lit("web").alias("kind"), evidence.alias("evidence"))
            .where(F.col("evidence").isNotNull()))


def merge_entrypoints(declared: DataFrame, web: DataFrame) -> DataFrame:
    """Manifest entries, plus web entries only for files without any declared entry."""
    w = web.join(declared.select("repo_id", "file_id").distinct(), ["repo_id", "file_id"],
                 "left_anti")
    return (declared.select("repo_id", "file_id", "kind", "evidence",
                            F.lit("manifest").alias("source"))
            .unionByName(w.select("repo_id", "file_id", "kind", "evidence",
                                  F.lit("web").alias("source"))))


def main_guard_entrypoints(contents: DataFrame) -> DataFrame:
    """Planned in the reference, not implemented there: a Python file with an
    ``if __name__ == "__main__":`` guard is a cli entry; a route decorator
    (``@app.get(...)``, ``@router.post(...)``, ``@app.route(...)``) marks a web entry."""
    guard = r"""(?m)^if\s+__name__\s*==\s*['"]__main__['"]\s*:"""
    route = r"(?m)^\s*@\w+\.(route|get|post|put|delete|patch)\s*\("
    py = contents.where(F.col("path").endswith(".py"))
    g = py.where(F.col("content").rlike(guard)).select(
        "repo_id", "path", F.lit("cli").alias("kind"),
        F.lit("__main__ guard").alias("evidence"))
    r = py.where(F.col("content").rlike(route)).select(
        "repo_id", "path", F.lit("web").alias("kind"),
        F.concat(F.lit("route decorator ."), F.regexp_extract("content", route, 1)).alias(
            "evidence"))
    return g.unionByName(r)
