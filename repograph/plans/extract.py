"""Extraction plans: the fact tables of many repositories at once.

``Facts`` builds each table lazily from ``files(repo_id, path, content)`` and
``commits(...)``; tables are memoised per instance so one plan reuses them.
Content is never carried through a join: edges and entrypoints are extracted
from content first, then joined on small rows.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repograph.operators import history as H
from repograph.operators import imports as M
from repograph.operators import inventory as I
from repograph.operators import resolve as R
from repograph.session import store


class Facts:
    def __init__(self, raw_files: DataFrame,
                 commits: DataFrame | Callable[[], DataFrame] | None = None,
                 extra_skip: list[str] | None = None, focus: str | None = None):
        self.raw_files = raw_files
        if commits is None:
            # No history: like a checkout without git - churn 0, no last touch, no pairs.
            commits = raw_files.sparkSession.createDataFrame(
                [], "repo_id string, commit_id string, seq long, committed_at string, path string")
        self._commits = commits
        self.extra_skip = extra_skip
        self.focus = focus

    # ------------------------------------------------------------ inventory
    @cached_property
    def kept(self) -> DataFrame:
        """Kept raw files (with content), before ids."""
        return I.kept_files(self.raw_files, self.extra_skip)

    @cached_property
    def inventory(self) -> DataFrame:
        return I.measured(self.kept)

    @cached_property
    def files_all(self) -> DataFrame:
        """Inventory with positional ids (before any focus), stored once."""
        return store(I.file_ids(self.inventory), "files")

    @cached_property
    def module_files_all(self) -> DataFrame:
        return store(I.module_files(self.files_all), "module-files")

    @cached_property
    def _focused(self):
        if not self.focus:
            return self.files_all, self.module_files_all
        return I.focus_subtree(self.files_all, self.module_files_all, self.focus)

    @cached_property
    def files(self) -> DataFrame:
        return self._focused[0]

    @cached_property
    def module_files(self) -> DataFrame:
        return self._focused[1]

    @cached_property
    def modules(self) -> DataFrame:
        return I.modules(self.module_files)

    @cached_property
    def contents(self) -> DataFrame:
        """(repo_id, path, content) of indexed files - for the text scans. Not joined to
        the ids: scans emit small rows keyed by path, which are joined to ids after."""
        c = self.kept.select("repo_id", "path", "content")
        if self.focus:
            s = self.focus.strip("/")
            c = c.where((F.col("path") == s) | F.col("path").startswith(s + "/"))
        return c

    # ------------------------------------------------------------ history
    @cached_property
    def commits_raw(self) -> DataFrame:
        """The commits; a function that gives them is called when they are first read."""
        return self._commits() if callable(self._commits) else self._commits

    @cached_property
    def touches(self) -> DataFrame:
        return H.touches(self.commits_raw, self.files)

    @cached_property
    def churn(self) -> DataFrame:
        return H.churn(self.touches)

    @cached_property
    def last_modified(self) -> DataFrame:
        return H.last_modified(self.touches)

    @cached_property
    def coupling(self) -> DataFrame:
        return H.cochange_pairs(self.touches)

    @cached_property
    def files_with_signals(self) -> DataFrame:
        return H.apply_git_signals(self.files, H.git_signals(self.touches))

    # ------------------------------------------------------------ imports
    @cached_property
    def roots(self) -> DataFrame:
        return R.package_roots(self.files)

    @cached_property
    def merged(self) -> DataFrame:
        """Import rows of both scans, merged inside each file's row; stored once, so the text
        is read a single time whatever is derived from them."""
        return store(M.file_imports(self.contents), "imports")

    @cached_property
    def resolved(self) -> DataFrame:
        return R.resolve(self.merged, self.files, self.roots)

    @cached_property
    def edges(self) -> DataFrame:
        """edges(repo_id, edge_id, type, from_id, to_id, file, line, raw, resolution,
        extractor) plus the parsed module/level/lang; stored once."""
        return store(M.edge_ids_by_file(self.resolved, self.files).select(
            "repo_id", "edge_id", F.lit("import").alias("type"),
            F.col("file_id").alias("from_id"), "to_id", F.col("path").alias("file"),
            F.col("line").cast("bigint").alias("line"), "raw", "resolution", "extractor",
            "module", "level", "lang", "hit_priority"), "edges")

    # ------------------------------------------------------------ manifests, entrypoints
    @cached_property
    def deps(self) -> DataFrame:
        from repograph.operators import manifests as MF
        return store(MF.merge_deps(self.raw_files), "deps")

    @cached_property
    def entrypoints(self) -> DataFrame:
        from repograph.operators import entrypoints as EP
        from repograph.operators import manifests as MF
        declared = MF.declared_entrypoints(self.raw_files, self.files)
        web = EP.web_entrypoints(self.contents).join(
            self.files.select("repo_id", "path", "file_id"), ["repo_id", "path"])
        return store(EP.merge_entrypoints(declared, web), "entrypoints")

    @cached_property
    def totals(self) -> DataFrame:
        return I.repo_totals(self.files)

    @cached_property
    def languages(self) -> DataFrame:
        return I.languages_detected(self.files)


def repo_ids(files: DataFrame) -> DataFrame:
    return files.select("repo_id").distinct()


def lit_array(values: list[str]):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
