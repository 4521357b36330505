"""Oracle SQL (DuckDB) for every registered query that SQL can express."""
from __future__ import annotations

from repograph.functions.text import ALWAYS_SKIP, EXTENSION_LANGUAGE
from repograph.plans.oracle_d import D_WITH

ORACLES: dict[str, str] = {}


def lang_sql(path: str) -> str:
    whens = " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in EXTENSION_LANGUAGE.items())
    return f"CASE regexp_extract(lower({path}), '(\\.[^.]*)$', 1) {whens} ELSE 'unknown' END"


LOC = "CAST(length(content) - length(replace(content, chr(10), '')) AS BIGINT)"

# module membership of D files and module ids
D_MODS = D_WITH + r""",
d_mod AS (
  SELECT repo_id, file_id, path,
         CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END
           AS module_path
  FROM d_ids),
d_mids AS (
  SELECT repo_id, module_path,
         printf('m%03d', row_number() OVER (PARTITION BY repo_id ORDER BY module_path)) AS module_id
  FROM (SELECT DISTINCT repo_id, module_path FROM d_mod)),
d_modfiles AS (SELECT * FROM d_mod JOIN d_mids USING (repo_id, module_path))
"""

ORACLES["cochange_pairs"] = D_WITH + """
SELECT a.repo_id, a.file_id AS a, b.file_id AS b, count(*) AS co_change_count
FROM d_touch a JOIN d_touch b
  ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id AND a.file_id < b.file_id
GROUP BY 1, 2, 3 HAVING count(*) >= 2
"""

ORACLES["churn"] = D_WITH + """
SELECT repo_id, file_id, count(*) AS churn FROM d_touch GROUP BY 1, 2
"""

ORACLES["last_modified"] = D_WITH + """
SELECT repo_id, file_id, arg_min(committed_at, seq) AS last_modified FROM d_touch GROUP BY 1, 2
"""

ORACLES["apply_git_signals"] = D_WITH + """,
g AS (SELECT repo_id, file_id, count(*) AS churn, arg_min(committed_at, seq) AS last_modified
      FROM d_touch GROUP BY 1, 2)
SELECT i.repo_id, i.file_id, i.path, coalesce(g.churn, 0) AS churn, g.last_modified
FROM d_ids i LEFT JOIN g USING (repo_id, file_id)
"""

ORACLES["indexed_only"] = D_WITH + """
SELECT repo_id, commit_id, seq, committed_at, file_id FROM d_touch WHERE path LIKE '%.py'
"""

ORACLES["module_coupling"] = D_MODS + """,
tm AS (SELECT DISTINCT t.repo_id, t.commit_id, m.module_id
       FROM d_touch t JOIN d_modfiles m USING (repo_id, file_id))
SELECT a.repo_id, a.module_id AS a, b.module_id AS b, count(*) AS co_change_count
FROM tm a JOIN tm b ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id
  AND a.module_id < b.module_id
GROUP BY 1, 2, 3 HAVING count(*) >= 2
"""

ORACLES["file_inventory"] = D_WITH + f"""
SELECT repo_id, path, {lang_sql('path')} AS lang, {LOC} AS loc,
       CAST(strlen(content) AS BIGINT) AS size_bytes
FROM d_files
"""

ORACLES["line_count"] = """
SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS loc,
       CAST(strlen(text) AS BIGINT) AS size_bytes
FROM documents
"""

ORACLES["skip_segments"] = D_WITH + """
SELECT repo_id, path FROM d_files
"""

ORACLES["ignore_rules"] = D_WITH + """
SELECT repo_id, path FROM d_files
WHERE NOT (path LIKE '%.md' AND path NOT LIKE 'pkg_promo/%')
  AND path NOT LIKE 'src/pkg_small/%'
UNION ALL
SELECT DISTINCT repo_id, '.gitignore' AS path FROM d_files
"""

ORACLES["detect_language"] = D_WITH + f"""
SELECT repo_id, path, {lang_sql('path')} AS lang FROM d_files
"""

ORACLES["file_ids"] = D_WITH + """
SELECT repo_id, file_id, path FROM d_ids
"""

ORACLES["module_rollup"] = D_MODS + """
SELECT repo_id, module_id, module_path, file_id FROM d_modfiles
"""

ORACLES["module_ids"] = D_MODS + """
SELECT repo_id, module_id, module_path AS path, count(*) AS n_files,
       min(file_id) AS first_file_id, max(file_id) AS last_file_id
FROM d_modfiles GROUP BY 1, 2, 3
"""

ORACLES["repo_totals"] = D_WITH + f"""
SELECT repo_id, count(*) AS total_files, CAST(sum({LOC}) AS BIGINT) AS total_loc
FROM d_files GROUP BY 1
"""

ORACLES["languages_detected"] = D_WITH + f"""
SELECT repo_id, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages
FROM (SELECT repo_id, {lang_sql('path')} AS lang FROM d_files)
WHERE lang <> 'unknown' GROUP BY 1
"""

ORACLES["focus_subtree"] = D_MODS + """
SELECT repo_id, file_id, path, module_id FROM d_modfiles WHERE path LIKE 'src/%'
"""

ORACLES["scan_eligible"] = D_WITH + r"""
SELECT repo_id, path,
       CASE WHEN sfx IN ('.py', '.pyi') THEN 'python' ELSE 'js' END AS family
FROM (SELECT repo_id, path,
             lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+?(\.[^.]*)$', 1)) AS sfx
      FROM d_files)
WHERE sfx IN ('.py', '.pyi', '.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx')
"""

# ------------------------------------------------------------------ imports
from repograph.plans.oracle_d import D_IMP, D_IMP_CTES  # noqa: E402

ORACLES["explode_lines"] = r"""
WITH s AS (
  SELECT doc_id, string_split_regex(replace(text, chr(13) || chr(10), chr(10)),
                                    '[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS p
  FROM documents),
t AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM s)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, p[i] AS text
FROM t, range(1, len(p) + 1) r(i)
"""

_RAW = "SELECT repo_id, from_id AS file_id, CAST(line AS BIGINT) AS line, raw, " \
       "CAST(level AS BIGINT) AS level, module FROM d_edges"


def _scan_sql(lang: str, exts: str, forms: list[tuple[int, str, str]]) -> str:
    """Plain import lines, and what a scan finds in the appended forms: (line, raw, module)."""
    values = ", ".join("({}, '{}', '{}')".format(n, raw.replace("'", "''"), module) for n, raw, module in forms)
    return D_IMP + "\n" + _RAW + f""" WHERE lang = '{lang}'
UNION ALL
SELECT p.repo_id, i.file_id, {LOC.replace('content', 'p.content')} + v.n, v.raw, 0, v.module
FROM d_pfiles p JOIN d_ids i ON i.repo_id = p.repo_id AND i.path = p.path
CROSS JOIN (VALUES {values}) AS v(n, raw, module)
WHERE p.partkey % 23 = 0 AND p.ext IN ({exts})"""


_JS = "'.js', '.ts'"
ORACLES["python_imports_line"] = _scan_sql("python", "'.py'", [
    (2, "import fake_doc", "fake_doc"), (6, "from os import (", "os")])
ORACLES["python_imports_stmt"] = _scan_sql("python", "'.py'", [
    (4, "try: import ext_one", "ext_one"), (5, "except ImportError: import ext_two", "ext_two"),
    (6, "from os import (", "os")])
ORACLES["js_imports_line"] = _scan_sql("js", _JS, [(3, "import no from 'no';", "no")])
ORACLES["js_imports_stmt"] = _scan_sql("js", _JS, [(7, "} from 'multi';", "multi")])

ORACLES["merge_edges"] = D_IMP + """
SELECT repo_id, from_id AS file_id, CAST(line AS BIGINT) AS line, raw, module,
       CASE WHEN f % 2 = 0 THEN 'treesitter' ELSE 'heuristic' END AS extractor
FROM d_edges
"""

ORACLES["package_roots"] = D_WITH + """
SELECT DISTINCT repo_id, pkg AS name, CASE WHEN root = 'src/' THEN 'src' ELSE '' END AS prefixes
FROM d_parts
"""

_EDGE = "SELECT repo_id, from_id, CAST(line AS BIGINT) AS line, module, to_id, resolution FROM d_edges"
ORACLES["resolve_python_absolute"] = D_IMP + "\n" + _EDGE + " WHERE lang = 'python' AND level = 0"
ORACLES["resolve_python_srclayout"] = D_IMP + "\n" + _EDGE + \
    " WHERE lang = 'python' AND level = 0 AND to_id IS NOT NULL AND t_root = 'src/'"
ORACLES["resolve_python_relative"] = D_IMP + "\n" + _EDGE + " WHERE lang = 'python' AND level > 0"
ORACLES["resolve_js"] = D_IMP + "\n" + _EDGE + " WHERE lang = 'js'"

ORACLES["normalize_path"] = r"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) || '/../x/./y/../../z//w'
         AS raw_path FROM pages)
SELECT page_id, raw_path,
       list_reduce(list_prepend('', string_split(raw_path, '/')),
         lambda acc, s: CASE WHEN s = '' OR s = '.' THEN acc
                             WHEN s = '..' THEN regexp_replace(acc, '/?[^/]*$', '')
                             WHEN acc = '' THEN s ELSE acc || '/' || s END) AS norm_path
FROM p
"""

ORACLES["edge_ids"] = D_IMP + """
SELECT repo_id, edge_id, 'import' AS type, from_id, to_id, path AS file, CAST(line AS BIGINT) AS line,
       raw, resolution, 'treesitter' AS extractor
FROM d_edges
"""

ORACLES["resolution_counts"] = D_IMP + """
SELECT repo_id, CAST(count(*) FILTER (WHERE resolution = 'resolved') AS BIGINT) AS edges_resolved,
       CAST(count(*) FILTER (WHERE resolution = 'unresolved') AS BIGINT) AS edges_unresolved
FROM d_edges GROUP BY 1
"""

ORACLES["extraction_report"] = D_IMP + f""",
lg AS (SELECT repo_id, array_to_string(list_sort(list_distinct(list(lang))), ',') AS languages
       FROM (SELECT repo_id, {lang_sql('path')} AS lang FROM d_files) WHERE lang <> 'unknown'
       GROUP BY 1),
rc AS (SELECT repo_id, count(*) FILTER (WHERE resolution = 'resolved') AS r,
              count(*) FILTER (WHERE resolution = 'unresolved') AS u FROM d_edges GROUP BY 1)
SELECT lg.repo_id, languages, CAST(coalesce(r, 0) AS BIGINT) AS edges_resolved,
       CAST(coalesce(u, 0) AS BIGINT) AS edges_unresolved, '' AS tools,
       '{",".join(sorted(ALWAYS_SKIP))}' AS skipped,
       '' AS warnings
FROM lg LEFT JOIN rc USING (repo_id)
"""

ORACLES["mutual_imports"] = D_IMP + """,
p AS (SELECT DISTINCT repo_id, from_id AS src, to_id AS dst FROM d_edges WHERE to_id IS NOT NULL)
SELECT p.repo_id, p.src AS a, p.dst AS b FROM p JOIN p q
  ON q.repo_id = p.repo_id AND q.src = p.dst AND q.dst = p.src
WHERE p.src < p.dst
"""

ORACLES["fan_in_out"] = D_IMP + """,
r AS (SELECT * FROM d_edges WHERE to_id IS NOT NULL),
i AS (SELECT repo_id, to_id AS file_id, count(*) AS n FROM r GROUP BY 1, 2),
o AS (SELECT repo_id, from_id AS file_id, count(*) AS n FROM r GROUP BY 1, 2)
SELECT d.repo_id, d.file_id, CAST(coalesce(i.n, 0) AS BIGINT) AS fan_in,
       CAST(coalesce(o.n, 0) AS BIGINT) AS fan_out
FROM d_ids d LEFT JOIN i USING (repo_id, file_id) LEFT JOIN o USING (repo_id, file_id)
"""

D_ALL = D_MODS.rstrip() + "," + D_IMP_CTES.rstrip()

ORACLES["module_dependencies"] = D_ALL + """
SELECT e.repo_id, a.module_id AS from_module, b.module_id AS to_module, count(*) AS n_edges
FROM d_edges e
JOIN d_modfiles a ON a.repo_id = e.repo_id AND a.file_id = e.from_id
JOIN d_modfiles b ON b.repo_id = e.repo_id AND b.file_id = e.to_id
GROUP BY 1, 2, 3
"""

# ------------------------------------------------------------------ manifests (M on top of D)
M_CTES = r"""
m_s AS (SELECT s_suppkey AS k, s_name, s_nationkey, 'repo' || (s_suppkey % 4) AS repo_id,
               'lib-' || s_suppkey AS name FROM supplier),
m_repos AS (SELECT DISTINCT repo_id FROM m_s),
dm_ids AS (
  SELECT repo_id, path, printf('f%04d', row_number() OVER (PARTITION BY repo_id ORDER BY path)) AS file_id
  FROM (SELECT repo_id, path FROM d_files
        UNION ALL SELECT repo_id, unnest(['package.json', 'pyproject.toml', 'requirements.txt']) FROM m_repos)),
m_picks AS (
  SELECT repo_id,
         arg_min(path, partkey) FILTER (WHERE ext = '.js') AS start_path,
         arg_min(path, partkey) FILTER (WHERE ext = '.ts') AS main_path,
         arg_min(modname, partkey) FILTER (WHERE ext = '.py' AND root = '') AS mod1,
         arg_max(modname, partkey) FILTER (WHERE ext = '.py' AND root = '') AS mod2
  FROM d_parts GROUP BY 1),
m_deps AS (
  SELECT repo_id, 'react' AS name, '18.2.0' AS version, 'npm' AS ecosystem, 'package.json' AS manifest FROM m_repos
  UNION ALL SELECT repo_id, name, CASE WHEN k % 7 = 0 OR k % 11 = 0 THEN NULL WHEN k % 2 = 1 THEN '^1.' || k
                                       ELSE '~2.' || k END, 'npm', 'package.json' FROM m_s
  UNION ALL SELECT repo_id, name, CASE WHEN k % 10 = 0 THEN '1.0' END, 'pypi', 'pyproject.toml' FROM m_s WHERE k % 5 = 0
  UNION ALL SELECT repo_id, name, CASE WHEN k % 2 = 1 THEN '^' || k || '.0' ELSE '^' || k || '.1' END,
                   'pypi', 'pyproject.toml' FROM m_s WHERE k % 5 <> 0
  UNION ALL SELECT repo_id, 'pytest', '^8.0', 'pypi', 'pyproject.toml' FROM m_repos
  UNION ALL SELECT repo_id, name, CASE WHEN k % 3 = 0 THEN '1.' || k END, 'pypi', 'requirements.txt' FROM m_s
  UNION ALL SELECT repo_id, 'ext_lib_' || i, NULL, 'pypi', 'requirements.txt' FROM m_repos, range(5) t(i)),
m_entries AS (
  SELECT p.repo_id, i.file_id, CASE WHEN p.repo_id IN ('repo0', 'repo2') THEN 'web' ELSE 'cli' END AS kind,
         'package.json scripts.start: node ' || p.start_path
           || CASE WHEN p.repo_id IN ('repo0', 'repo2') THEN ' --serve' ELSE '' END AS evidence,
         'start' AS src
  FROM m_picks p JOIN dm_ids i ON i.repo_id = p.repo_id AND i.path = p.start_path
  UNION ALL
  SELECT p.repo_id, i.file_id, 'lib', 'package.json main: ./' || p.main_path, 'main'
  FROM m_picks p JOIN dm_ids i ON i.repo_id = p.repo_id AND i.path = p.main_path
  UNION ALL
  SELECT p.repo_id, i.file_id, 'cli', 'pyproject [project.scripts]: ' || p.mod1 || ':main', 'pep'
  FROM m_picks p JOIN dm_ids i ON i.repo_id = p.repo_id AND i.path = replace(p.mod1, '.', '/') || '.py'
  UNION ALL
  SELECT p.repo_id, i.file_id, 'cli', 'pyproject [tool.poetry.scripts]: ' || p.mod2 || ':run', 'poetry'
  FROM m_picks p JOIN dm_ids i ON i.repo_id = p.repo_id AND i.path = replace(p.mod2, '.', '/') || '.py'
  WHERE p.repo_id IN ('repo1', 'repo3') AND p.mod2 <> p.mod1),
m_web AS (
  SELECT i.repo_id, i.file_id, 'web' AS kind,
         CASE WHEN p.partkey % 97 = 0 THEN 'module-level FastAPI() app object: app'
              ELSE 'module-level ''application'' bound to a Flask() application (factory pattern)' END AS evidence
  FROM d_parts p JOIN dm_ids i ON i.repo_id = p.repo_id AND i.path = p.path
  WHERE p.ext = '.py' AND (p.partkey % 97 = 0 OR p.partkey % 89 = 0)),
m_tech AS (
  SELECT repo_id, k AS ord, s_name AS tech_name, 'role-' || (s_nationkey % 4) AS role,
         CASE WHEN k % 9 = 0 THEN 'nolib-' || k ELSE name END AS fact_ref FROM m_s)
"""
DM = D_WITH + "," + M_CTES.rstrip()
DM_IMP = DM + "," + D_IMP_CTES.replace("d_ids", "dm_ids").rstrip()

_DEP = "SELECT repo_id, name, version, ecosystem, manifest FROM m_deps"
ORACLES["manifest_rows"] = DM + """
SELECT repo_id, unnest(['package.json', 'pyproject.toml', 'requirements.txt']) AS path FROM m_repos
"""
ORACLES["requirement_token"] = DM + "\nSELECT repo_id, name, version FROM m_deps WHERE manifest = 'requirements.txt'"
ORACLES["requirements_deps"] = DM + "\n" + _DEP + " WHERE manifest = 'requirements.txt'"
ORACLES["npm_deps"] = DM + "\n" + _DEP + " WHERE manifest = 'package.json'"
ORACLES["pep621_deps"] = DM + "\nSELECT repo_id, name, CASE WHEN k % 10 = 0 THEN '1.0' END AS version, " \
    "'pypi' AS ecosystem, 'pyproject.toml' AS manifest FROM m_s WHERE k % 5 = 0"
ORACLES["poetry_deps"] = DM + """
SELECT repo_id, name, CASE WHEN k % 2 = 1 THEN '^' || k || '.0' ELSE '^' || k || '.1' END AS version,
       'pypi' AS ecosystem, 'pyproject.toml' AS manifest FROM m_s WHERE k % 5 <> 0
UNION ALL SELECT repo_id, 'pytest', '^8.0', 'pypi', 'pyproject.toml' FROM m_repos
"""
ORACLES["merge_deps"] = DM + """
SELECT repo_id, name, version, ecosystem, manifest,
       row_number() OVER (PARTITION BY repo_id ORDER BY name, ecosystem, manifest) AS dep_ord
FROM m_deps
"""
_ENT = "SELECT repo_id, file_id, kind, evidence FROM m_entries"
ORACLES["node_start_entry"] = DM + "\n" + _ENT + " WHERE src = 'start'"
ORACLES["node_main_entry"] = DM + "\n" + _ENT + " WHERE src = 'main'"
ORACLES["pyproject_script_entry"] = DM + "\n" + _ENT + " WHERE src = 'pep'"
ORACLES["poetry_script_entry"] = DM + "\n" + _ENT + " WHERE src = 'poetry'"
ORACLES["script_entry_join"] = DM + """
SELECT p.repo_id, p.mod1 AS module, i.file_id AS target_id
FROM m_picks p LEFT JOIN dm_ids i ON i.repo_id = p.repo_id AND i.path = replace(p.mod1, '.', '/') || '.py'
UNION ALL
SELECT p.repo_id, CASE WHEN p.repo_id IN ('repo1', 'repo3') THEN p.mod2 ELSE p.mod1 END,
       i.file_id
FROM m_picks p LEFT JOIN dm_ids i ON i.repo_id = p.repo_id
  AND i.path = replace(CASE WHEN p.repo_id IN ('repo1', 'repo3') THEN p.mod2 ELSE p.mod1 END, '.', '/') || '.py'
"""
ORACLES["web_entrypoints"] = D_WITH + """
SELECT i.repo_id, i.file_id, 'web' AS kind,
       CASE WHEN p.partkey % 97 = 0 THEN 'module-level FastAPI() app object: app'
            ELSE 'module-level ''application'' bound to a Flask() application (factory pattern)' END AS evidence
FROM d_parts p JOIN d_ids i ON i.repo_id = p.repo_id AND i.path = p.path
WHERE p.ext = '.py' AND (p.partkey % 97 = 0 OR p.partkey % 89 = 0)
"""
ORACLES["merge_entrypoints"] = DM + """
SELECT repo_id, file_id, kind, evidence FROM m_entries
UNION ALL
SELECT w.repo_id, w.file_id, w.kind, w.evidence FROM m_web w
WHERE NOT EXISTS (SELECT 1 FROM m_entries e WHERE e.repo_id = w.repo_id AND e.file_id = w.file_id)
"""
ORACLES["dependency_usage"] = DM_IMP + """
SELECT DISTINCT e.repo_id, n.name, e.from_id AS file_id
FROM d_edges e
JOIN (SELECT DISTINCT repo_id, name FROM m_deps) n
  ON n.repo_id = e.repo_id
 AND n.name = CASE WHEN e.lang = 'python' THEN split_part(e.module, '.', 1) ELSE e.module END
WHERE e.to_id IS NULL
"""
ORACLES["dep_lookup"] = DM + """,
fd AS (SELECT repo_id, name, version FROM (
         SELECT *, row_number() OVER (PARTITION BY repo_id, name ORDER BY ecosystem, manifest) AS r
         FROM m_deps) WHERE r = 1)
SELECT t.repo_id, t.ord, t.tech_name, t.role, t.fact_ref, fd.version
FROM m_tech t LEFT JOIN fd ON fd.repo_id = t.repo_id AND fd.name = t.fact_ref
"""
ORACLES["tech_by_role"] = DM + """
SELECT repo_id, role, min(ord) AS role_ord, count(*) AS n_items,
       string_agg(tech_name, '|' ORDER BY ord) AS items
FROM m_tech GROUP BY 1, 2
"""
ORACLES["stat_tiles"] = DM + f""",
ms AS (SELECT repo_id, count(*) AS n, count(*) FILTER (WHERE k % 5 = 0) AS n_pep,
              count(*) FILTER (WHERE k % 5 <> 0) AS n_poe FROM m_s GROUP BY 1),
mloc AS (SELECT repo_id, (8 + n) + 1
                + (CASE WHEN n_pep = 0 THEN 19 ELSE 20 END - 1 + greatest(n_pep - 1, 0)
                   + greatest(n_poe - 1, 0) - CASE WHEN n_pep = 0 THEN 1 ELSE 0 END) AS loc
         FROM ms),
dl AS (SELECT repo_id, count(*) AS n_files, sum({LOC}) AS loc,
              count(DISTINCT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END) AS n_dirs,
              count(DISTINCT {lang_sql('path')}) FILTER (WHERE {lang_sql('path')} <> 'unknown') AS n_lang
       FROM d_files GROUP BY 1),
ent AS (SELECT repo_id, count(*) AS n FROM (
          SELECT repo_id, file_id FROM m_entries
          UNION ALL SELECT w.repo_id, w.file_id FROM m_web w
          WHERE NOT EXISTS (SELECT 1 FROM m_entries e WHERE e.repo_id = w.repo_id AND e.file_id = w.file_id))
        GROUP BY 1),
dep AS (SELECT repo_id, count(*) AS n FROM m_deps GROUP BY 1)
SELECT dl.repo_id, dl.n_files + 3 AS n_files, CAST(dl.loc + mloc.loc AS BIGINT) AS total_loc,
       dl.n_dirs + 1 AS n_modules, dl.n_lang + 2 AS n_languages, ent.n AS n_entrypoints,
       dep.n AS n_dependencies
FROM dl JOIN mloc USING (repo_id) JOIN ent USING (repo_id) JOIN dep USING (repo_id)
"""

# ------------------------------------------------------------------ narrative N
N_CTES = r"""
n_files AS (SELECT 'repo0' AS repo_id, printf('f%04d', partkey) AS file_id, path FROM d_parts WHERE p_size > 3),
n_modfiles AS (SELECT 'repo0' AS repo_id, pkg AS module_id, printf('f%04d', partkey) AS file_id
               FROM d_parts WHERE p_size > 3 AND ptype <> 'promo'),
n_modules AS (SELECT DISTINCT repo_id, module_id FROM n_modfiles),
n_edges AS (SELECT 'repo0' AS repo_id, 'e' || o_orderkey AS edge_id,
                   CASE WHEN o_orderkey % 3 = 0 THEN 'unresolved' ELSE 'resolved' END AS resolution
            FROM orders WHERE o_orderkey % 2 = 0),
n_present AS (SELECT 'repo0' AS repo_id, path FROM d_parts WHERE partkey % 3 <> 0),
n_nodes AS (
  SELECT 'repo0' AS repo_id, o_orderpriority AS perspective_id, o_orderkey AS ord, 'n' || o_custkey AS node_id,
         CAST(o_custkey % 3 AS INTEGER) AS tier,
         CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Customer ' || o_custkey || '/' || (o_orderkey % 3) END AS label,
         CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'Order ' || o_orderkey END AS description,
         CASE o_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
         o_custkey % 2 = 0 AS interpretation, o_custkey AS c
  FROM orders),
n_refs AS (
  SELECT 'repo0' AS repo_id, o.o_orderpriority AS perspective_id, o.o_orderkey AS ord, 'n' || o.o_custkey AS node_id,
         'file' AS ref_kind, printf('f%04d', l.l_partkey) AS ref_id, l.l_linenumber AS lno, l.l_partkey AS lpk
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
  UNION ALL
  SELECT DISTINCT 'repo0', o.o_orderpriority, o.o_orderkey, 'n' || o.o_custkey, 'module', p.pkg,
         CAST(NULL AS INTEGER), CAST(NULL AS BIGINT)
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN d_parts p ON p.partkey = l.l_partkey
  WHERE o.o_orderkey % 10 = 0),
n_rels AS (SELECT 'repo0' AS repo_id, o_orderpriority AS perspective_id, 2 * o_orderkey + 1 AS ord,
                  'n' || o_custkey AS from_id, 'n' || (o_custkey + 1) AS to_id, o_custkey AS c,
                  CASE o_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence
           FROM orders),
n_relrefs AS (SELECT 'repo0' AS repo_id, o_orderpriority AS perspective_id, 2 * o_orderkey + 1 AS ord,
                     'e' || o_orderkey AS edge_id FROM orders WHERE o_orderkey % 17 <> 0),
n_heads AS (SELECT DISTINCT 'repo0' AS repo_id, o_orderpriority AS perspective_id, o_custkey AS c
            FROM orders WHERE o_custkey % 5 <> 0),
n_children AS (
  SELECT repo_id, perspective_id, 'n' || c AS node_id, 0 AS pos, 'n' || (c + 1) AS child_id FROM n_heads
  UNION ALL SELECT repo_id, perspective_id, 'n' || c, 1, 'n' || (c + 2) FROM n_heads),
n_persp AS (SELECT DISTINCT 'repo0' AS repo_id, o_orderpriority AS perspective_id FROM orders),
n_first AS (SELECT o_custkey AS c, o_orderkey AS ord FROM orders),
n_claims AS (
  SELECT 'repo0' AS repo_id, o.o_orderpriority AS brief_id,
         CASE f.c % 4 WHEN 0 THEN 'problem' WHEN 1 THEN 'solution' WHEN 2 THEN 'audience' ELSE 'capability' END
           AS claim_kind,
         f.ord, 'cap-' || f.c AS label, CASE WHEN f.c % 7 = 0 THEN '' ELSE 'Order ' || f.ord END AS text,
         CASE f.c % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence,
         f.c % 2 = 0 AS interpretation,
         CASE WHEN f.c % 4 = 3 THEN (CASE WHEN f.c % 13 = 0 THEN NULL WHEN f.c % 11 = 0 THEN 'none'
                                          ELSE o.o_orderpriority END) END AS perspective_ref,
         CASE WHEN f.c % 4 = 3 THEN 'n' || (f.c + 1) END AS node_ref
  FROM n_first f JOIN orders o ON o.o_orderkey = f.ord),
n_brefs AS (SELECT r.repo_id, c.brief_id, r.ord, r.ref_kind, r.ref_id, r.lno, r.lpk FROM n_refs r JOIN n_claims c ON c.ord = r.ord),
n_briefs AS (SELECT repo_id, perspective_id AS brief_id,
                    CASE WHEN perspective_id = '5-LOW' THEN '' ELSE 'Brief ' || perspective_id END AS headline
             FROM n_persp),
n_narr AS (SELECT repo_id, perspective_id AS narrative_id,
                  CASE perspective_id WHEN '1-URGENT' THEN 'abc123' WHEN '2-HIGH' THEN NULL ELSE 'head0' END
                    AS based_on
           FROM n_persp)
"""
DN = D_WITH + "," + N_CTES.rstrip()

_VSEL = "SELECT repo_id, '{sev}' AS severity, '{chk}' AS \"check\", CAST({scope} AS VARCHAR) AS scope, " \
        "CAST({subj} AS VARCHAR) AS subject, CAST({ref} AS VARCHAR) AS ref FROM "


def _vs(sev, chk, scope, subj, ref="NULL"):
    return _VSEL.format(sev=sev, chk=chk, scope=scope, subj=subj, ref=ref)


V_SQL = {
    "dup_node_ids": _vs("error", "node-ids", "perspective_id", "node_id") +
    "(SELECT * FROM n_nodes QUALIFY row_number() OVER (PARTITION BY perspective_id, node_id ORDER BY ord) > 1)",
    "orphan_file_refs": _vs("error", "referential-integrity", "perspective_id", "node_id", "ref_id") +
    "n_refs r WHERE ref_kind = 'file' AND NOT EXISTS (SELECT 1 FROM n_files f WHERE f.file_id = r.ref_id)",
    "orphan_module_refs": _vs("error", "referential-integrity", "perspective_id", "node_id", "ref_id") +
    "n_refs r WHERE ref_kind = 'module' AND NOT EXISTS (SELECT 1 FROM n_modules m WHERE m.module_id = r.ref_id)",
    "orphan_edge_refs": _vs("error", "referential-integrity", "perspective_id", "ord", "edge_id") +
    "n_relrefs r WHERE NOT EXISTS (SELECT 1 FROM n_edges e WHERE e.edge_id = r.edge_id)",
    "relationship_endpoints": _vs("error", "relationship-endpoints", "perspective_id", "'from'", "from_id") +
    "n_rels r WHERE NOT EXISTS (SELECT 1 FROM n_nodes n WHERE n.perspective_id = r.perspective_id "
    "AND n.node_id = r.from_id) UNION ALL " +
    _vs("error", "relationship-endpoints", "perspective_id", "'to'", "to_id") +
    "n_rels r WHERE NOT EXISTS (SELECT 1 FROM n_nodes n WHERE n.perspective_id = r.perspective_id "
    "AND n.node_id = r.to_id)",
    "empty_grounding": _vs("error", "empty-grounding", "perspective_id", "node_id") +
    "n_nodes n WHERE NOT EXISTS (SELECT 1 FROM n_refs r WHERE r.perspective_id = n.perspective_id "
    "AND r.ord = n.ord) AND NOT (interpretation AND confidence = 'low' AND description <> '')",
    "file_existence": _vs("error", "file-existence", "perspective_id", "file_id", "path") +
    "(SELECT DISTINCT r.repo_id, r.perspective_id, f.file_id, f.path FROM n_refs r "
    "JOIN n_files f ON f.file_id = r.ref_id WHERE r.ref_kind = 'file' "
    "AND NOT EXISTS (SELECT 1 FROM n_present p WHERE p.path = f.path))",
    "brief_grounding": _vs("error", "empty-grounding", "brief_id", "claim_kind", "ord") +
    "n_claims c WHERE NOT EXISTS (SELECT 1 FROM n_brefs b WHERE b.brief_id = c.brief_id AND b.ord = c.ord) "
    "AND NOT (interpretation AND confidence = 'low' AND text <> '')",
    "brief_orphan_refs": _vs("error", "referential-integrity", "brief_id", "ord", "ref_id") +
    "n_brefs b WHERE (ref_kind = 'file' AND NOT EXISTS (SELECT 1 FROM n_files f WHERE f.file_id = b.ref_id)) "
    "OR (ref_kind = 'module' AND NOT EXISTS (SELECT 1 FROM n_modules m WHERE m.module_id = b.ref_id))",
    "brief_file_existence": _vs("error", "file-existence", "brief_id", "ref_id", "path") +
    "(SELECT b.repo_id, b.brief_id, b.ref_id, f.path FROM n_brefs b JOIN n_files f ON f.file_id = b.ref_id "
    "WHERE b.ref_kind = 'file' AND NOT EXISTS (SELECT 1 FROM n_present p WHERE p.path = f.path))",
    "capability_refs": _vs("error", "capability-ref", "brief_id", "label", "perspective_ref") +
    "n_claims WHERE claim_kind = 'capability' AND perspective_ref IS NOT NULL "
    "AND perspective_ref NOT IN (SELECT perspective_id FROM n_persp) UNION ALL " +
    _vs("error", "capability-ref", "brief_id", "label", "node_ref") +
    "n_claims WHERE claim_kind = 'capability' AND node_ref IS NOT NULL AND perspective_ref IS NULL UNION ALL " +
    _vs("error", "capability-ref", "brief_id", "label", "node_ref") +
    "n_claims c WHERE claim_kind = 'capability' AND node_ref IS NOT NULL AND perspective_ref IS NOT NULL "
    "AND NOT EXISTS (SELECT 1 FROM n_nodes n WHERE n.perspective_id = c.perspective_ref AND n.node_id = c.node_ref)",
    "headline_warning": _vs("warning", "headline", "brief_id", "brief_id") + "n_briefs WHERE headline = ''",
    "commit_match": _vs("warning", "commit-match", "narrative_id", "based_on", "'head0'") +
    "n_narr WHERE based_on IS DISTINCT FROM 'head0'",
    "dangling_children": _vs("error", "dangling-child", "perspective_id", "node_id", "child_id") +
    "n_children c WHERE NOT EXISTS (SELECT 1 FROM n_nodes n WHERE n.perspective_id = c.perspective_id "
    "AND n.node_id = c.child_id)",
    "ungrounded_relationships": _vs("error", "ungrounded-relationship", "perspective_id", "ord") +
    "n_rels r WHERE NOT EXISTS (SELECT 1 FROM n_relrefs x WHERE x.perspective_id = r.perspective_id AND x.ord = r.ord)",
    "tier_sizing": _vs("warning", "tier0-size", "perspective_id", "n") +
    "(SELECT repo_id, perspective_id, count(*) AS n FROM n_nodes WHERE tier = 0 GROUP BY 1, 2 "
    "HAVING count(*) < 3 OR count(*) > 7) UNION ALL " +
    _vs("warning", "node-too-broad", "node_id", "ord", "n") +
    "(SELECT repo_id, node_id, ord, count(DISTINCT ref_id) AS n FROM n_refs WHERE ref_kind = 'file' "
    "GROUP BY 1, 2, 3 HAVING count(DISTINCT ref_id) > 15)",
}
for _k, _sql in V_SQL.items():
    ORACLES[_k] = DN + "\n" + _sql

ORACLES["dup_perspective_ids"] = DN + "\n" + _vs("error", "perspective-ids", "'3-MEDIUM'", "'3-MEDIUM'") + \
    "n_persp WHERE perspective_id = '3-MEDIUM'"

ORACLES["covered_files"] = DN + """,
cov AS (
  SELECT r.repo_id, r.perspective_id, r.ref_id AS file_id FROM n_refs r WHERE r.ref_kind = 'file'
  UNION
  SELECT r.repo_id, r.perspective_id, m.file_id FROM n_refs r JOIN n_modfiles m ON m.module_id = r.ref_id
  WHERE r.ref_kind = 'module')
SELECT DISTINCT c.repo_id, c.perspective_id, c.file_id FROM cov c JOIN n_files f ON f.file_id = c.file_id
"""
_COV = ORACLES["covered_files"].rsplit("SELECT DISTINCT", 1)[0].rstrip() + """,
covered AS (SELECT DISTINCT c.repo_id, c.perspective_id, c.file_id FROM cov c JOIN n_files f ON f.file_id = c.file_id),
tot AS (SELECT count(*) AS t FROM n_files)
"""
ORACLES["coverage_by_perspective"] = _COV + """
SELECT p.repo_id, p.perspective_id,
       (SELECT count(*) FROM n_nodes n WHERE n.perspective_id = p.perspective_id) AS node_count,
       (SELECT count(*) FROM covered c WHERE c.perspective_id = p.perspective_id) AS files_covered,
       CASE WHEN (SELECT t FROM tot) > 0 THEN round_even(100.0 * (SELECT count(*) FROM covered c
            WHERE c.perspective_id = p.perspective_id) / (SELECT t FROM tot), 2) ELSE 0.0 END AS coverage_pct
FROM n_persp p
"""
ORACLES["coverage_total"] = _COV + """
SELECT 'repo0' AS repo_id, (SELECT count(*) FROM n_nodes) AS node_count,
       (SELECT count(DISTINCT file_id) FROM covered) AS files_covered, (SELECT t FROM tot) AS total_files,
       CASE WHEN (SELECT t FROM tot) > 0 THEN round_even(100.0 * (SELECT count(DISTINCT file_id) FROM covered)
            / (SELECT t FROM tot), 2) ELSE 0.0 END AS coverage_pct,
       (SELECT count(*) FROM n_edges WHERE resolution = 'unresolved') AS unresolved_edges
"""
_GATE_KEYS = ["dup_node_ids", "orphan_file_refs", "orphan_module_refs", "orphan_edge_refs",
              "relationship_endpoints", "empty_grounding", "file_existence", "brief_grounding",
              "brief_orphan_refs", "brief_file_existence", "capability_refs", "headline_warning",
              "commit_match"]
ORACLES["gate_status"] = DN + ",\nallv AS (" + " UNION ALL ".join(
    "(" + V_SQL[k] + ")" for k in _GATE_KEYS) + """)
SELECT p.repo_id, p.perspective_id AS scope,
       CAST(count(*) FILTER (WHERE v.severity = 'error') AS BIGINT) AS n_errors,
       CAST(count(*) FILTER (WHERE v.severity = 'warning') AS BIGINT) AS n_warnings,
       CASE WHEN count(*) FILTER (WHERE v.severity = 'error') > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM n_persp p LEFT JOIN allv v ON v.scope = p.perspective_id
GROUP BY 1, 2
"""
ORACLES["techstack_refs"] = DM + "\n" + _vs("error", "techstack-ref", "repo_id", "tech_name", "fact_ref") + \
    "m_tech t WHERE NOT EXISTS (SELECT 1 FROM m_deps d WHERE d.repo_id = t.repo_id AND d.name = t.fact_ref)"

# ------------------------------------------------------------------ report queries
_NKEY = "repo_id, perspective_id, ord, node_id"
N_CONTENT = """,
n_content AS (SELECT 'repo0' AS repo_id, d.path, d.content FROM d_files d JOIN d_parts p ON p.path = d.path
              WHERE p.partkey % 3 <> 0),
n_refd AS (SELECT DISTINCT repo_id, ref_id AS file_id FROM n_refs WHERE ref_kind = 'file')"""

ORACLES["referenced_files"] = DN + "\nSELECT DISTINCT repo_id, ref_id AS file_id FROM n_refs WHERE ref_kind = 'file'"
ORACLES["code_truncate"] = """
SELECT doc_id, strlen(text) > 500 AS truncated,
       CASE WHEN strlen(text) > 500 THEN coalesce(try(decode(encode(text)[1:500])), try(decode(encode(text)[1:499])),
                                                  try(decode(encode(text)[1:498])), try(decode(encode(text)[1:497])))
            ELSE text END AS text
FROM documents
"""


def _fold(sized_sql: str, cap: int) -> str:
    return f""",
sized AS ({sized_sql}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file_id) AS i FROM sized),
fold AS (
  SELECT repo_id, i, file_id, n, false AS dropped, n AS total FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.repo_id, o.i, o.file_id, o.n, (f.total > 0 AND f.total + o.n > {cap}),
         CASE WHEN f.total > 0 AND f.total + o.n > {cap} THEN f.total ELSE f.total + o.n END
  FROM fold f JOIN ordered o ON o.repo_id = f.repo_id AND o.i = f.i + 1)"""


ORACLES["code_budget"] = DN.replace("WITH ", "WITH RECURSIVE ", 1) + N_CONTENT + _fold(
    "SELECT r.repo_id, r.file_id, CAST(strlen(c.content) AS BIGINT) AS n FROM n_refd r "
    "JOIN n_files f ON f.file_id = r.file_id JOIN n_content c ON c.path = f.path", 20000) + """
SELECT repo_id, file_id, n, dropped FROM fold
"""
ORACLES["code_payload"] = DN.replace("WITH ", "WITH RECURSIVE ", 1) + N_CONTENT + _fold(
    "SELECT r.repo_id, r.file_id, CAST(least(strlen(c.content), 120) AS BIGINT) AS n FROM n_refd r "
    "JOIN n_files f ON f.file_id = r.file_id JOIN n_content c ON c.path = f.path", 20000) + f"""
SELECT r.repo_id, r.file_id, f.path, {lang_sql('f.path')} AS lang,
       CASE WHEN c.path IS NULL OR fo.dropped THEN 0 ELSE least(strlen(c.content), 120) END AS n_bytes,
       coalesce(strlen(c.content) > 120 AND NOT fo.dropped, false) AS truncated,
       coalesce(fo.dropped, false) AS dropped, c.path IS NULL AS missing
FROM n_refd r JOIN n_files f ON f.file_id = r.file_id
LEFT JOIN n_content c ON c.path = f.path LEFT JOIN fold fo ON fo.file_id = r.file_id
"""
ORACLES["tier0_nodes"] = DN + f"\nSELECT {_NKEY} FROM n_nodes WHERE tier = 0"
ORACLES["children_of"] = DN + """
SELECT c.repo_id, c.perspective_id, c.node_id, c.pos, c.child_id FROM n_children c
WHERE EXISTS (SELECT 1 FROM n_nodes n WHERE n.perspective_id = c.perspective_id AND n.node_id = c.child_id)
"""
ORACLES["verified_only"] = DN + f"\nSELECT {_NKEY} FROM n_nodes WHERE NOT (interpretation OR confidence = 'low')"
ORACLES["visible_subgraph"] = DN + """,
vis AS (SELECT * FROM n_nodes WHERE NOT (interpretation OR confidence = 'low'))
SELECT repo_id, perspective_id, 'node' AS kind, ord, node_id AS from_id, CAST(NULL AS VARCHAR) AS to_id FROM vis
UNION ALL
SELECT r.repo_id, r.perspective_id, 'relationship', r.ord, r.from_id, r.to_id FROM n_rels r
WHERE EXISTS (SELECT 1 FROM vis v WHERE v.perspective_id = r.perspective_id AND v.node_id = r.from_id)
  AND EXISTS (SELECT 1 FROM vis v WHERE v.perspective_id = r.perspective_id AND v.node_id = r.to_id)
"""
ORACLES["node_relations"] = DN + """,
lab AS (SELECT perspective_id, node_id, nullif(arg_max(label, ord), '') AS label FROM n_nodes GROUP BY 1, 2),
ends AS (SELECT repo_id, perspective_id, ord, from_id AS node_id, 'out' AS direction, to_id AS other_id FROM n_rels
         UNION ALL SELECT repo_id, perspective_id, ord, to_id, 'in', from_id FROM n_rels)
SELECT e.repo_id, e.perspective_id, e.ord, e.node_id, e.direction, e.other_id,
       coalesce(l.label, e.other_id) AS other_label
FROM ends e LEFT JOIN lab l ON l.perspective_id = e.perspective_id AND l.node_id = e.other_id
"""
_NMOD = "n_modpaths AS (SELECT DISTINCT module_id, CASE WHEN module_id IN ('pkg_economy', 'pkg_small', 'pkg_large') " \
        "THEN 'src/' ELSE '' END || module_id AS path FROM n_modfiles)"
ORACLES["node_provenance"] = DN + ",\n" + _NMOD + """,
shown AS (
  SELECT r.*, CASE WHEN r.ref_kind = 'file' THEN coalesce(f.path, r.ref_id) ELSE coalesce(m.path, r.ref_id) END AS shown
  FROM n_refs r LEFT JOIN n_files f ON r.ref_kind = 'file' AND f.file_id = r.ref_id
  LEFT JOIN n_modpaths m ON r.ref_kind = 'module' AND m.module_id = r.ref_id)
SELECT repo_id, perspective_id, ord, node_id,
       coalesce(string_agg(shown, '|' ORDER BY lno, lpk, shown) FILTER (WHERE ref_kind = 'file'), '') AS file_paths,
       coalesce(string_agg(shown, '|' ORDER BY shown) FILTER (WHERE ref_kind = 'module'), '') AS module_paths
FROM shown GROUP BY 1, 2, 3, 4
"""
def _shown(refs: str) -> str:
    """References with path and id in brackets, an unknown id as its own path."""
    return f"""
shown AS (
  SELECT r.*, CASE WHEN r.ref_kind = 'file' THEN coalesce(f.path, r.ref_id) ELSE coalesce(m.path, r.ref_id) END
              || ' (' || r.ref_id || ')' AS shown
  FROM {refs} r LEFT JOIN n_files f ON r.ref_kind = 'file' AND f.file_id = r.ref_id
  LEFT JOIN n_modpaths m ON r.ref_kind = 'module' AND m.module_id = r.ref_id),"""


_CONFIDENCE = "'Confidence: ' || {0}.confidence || CASE WHEN {0}.interpretation THEN ' (interpretation)' ELSE '' END"
ORACLES["node_context"] = DN + ",\n" + _NMOD + "," + _shown("n_refs") + """
prov AS (
  SELECT perspective_id, ord,
         string_agg(shown, ', ' ORDER BY lno, lpk, shown) FILTER (WHERE ref_kind = 'file') AS fp,
         string_agg(shown, ', ' ORDER BY shown) FILTER (WHERE ref_kind = 'module') AS mp
  FROM shown GROUP BY 1, 2),
ends AS (SELECT perspective_id, ord, from_id AS node_id, 0 AS side FROM n_rels
         UNION ALL SELECT perspective_id, ord, to_id, 1 FROM n_rels),
ed AS (SELECT e.perspective_id, e.node_id, string_agg(x.edge_id, ', ' ORDER BY e.side, e.ord, x.edge_id) AS e
       FROM ends e JOIN n_relrefs x ON x.perspective_id = e.perspective_id AND x.ord = e.ord GROUP BY 1, 2)
SELECT n.repo_id, n.perspective_id, n.ord, n.node_id,
       concat_ws(chr(10), 'Repository: ' || n.repo_id, 'Perspective: ' || n.perspective_id, 'Node: ' || n.label,
                 nullif(n.description, ''), 'Modules: ' || p.mp, 'Files: ' || p.fp, 'Edges: ' || ed.e,
                 """ + _CONFIDENCE.format("n") + """) AS context
FROM n_nodes n LEFT JOIN prov p ON p.perspective_id = n.perspective_id AND p.ord = n.ord
LEFT JOIN ed ON ed.perspective_id = n.perspective_id AND ed.node_id = n.node_id
"""
ORACLES["brief_context"] = DN + ",\n" + _NMOD + "," + _shown("n_brefs") + """
prov AS (
  SELECT brief_id, ord,
         string_agg(shown, ', ' ORDER BY lno, lpk, shown) FILTER (WHERE ref_kind = 'file') AS fp,
         string_agg(shown, ', ' ORDER BY shown) FILTER (WHERE ref_kind = 'module') AS mp
  FROM shown GROUP BY 1, 2)
SELECT c.repo_id, c.brief_id, c.ord,
       concat_ws(chr(10), 'Repository: ' || c.repo_id, 'Claim: ' || c.claim_kind, nullif(c.text, ''),
                 'Modules: ' || p.mp, 'Files: ' || p.fp, """ + _CONFIDENCE.format("c") + """) AS context
FROM n_claims c LEFT JOIN prov p ON p.brief_id = c.brief_id AND p.ord = c.ord
"""
ORACLES["coverage_banner"] = D_IMP + f""",
lg AS (SELECT repo_id, array_to_string(list_sort(list_distinct(list(lang))), ', ') AS languages
       FROM (SELECT repo_id, {lang_sql('path')} AS lang FROM d_files) WHERE lang <> 'unknown' GROUP BY 1),
rc AS (SELECT repo_id, count(*) FILTER (WHERE resolution = 'resolved') AS r,
              count(*) FILTER (WHERE resolution = 'unresolved') AS u FROM d_edges GROUP BY 1)
SELECT lg.repo_id, lg.languages, CAST(coalesce(r, 0) AS VARCHAR) AS resolved,
       CAST(coalesce(u, 0) AS VARCHAR) AS unresolved, '—' AS tools,
       '{", ".join(sorted(ALWAYS_SKIP))}' AS skipped
FROM lg LEFT JOIN rc USING (repo_id)
"""
ORACLES["capability_cards"] = DN + """
SELECT repo_id, brief_id, ord, label, perspective_ref IS NOT NULL AND node_ref IS NOT NULL AS linkable
FROM n_claims WHERE claim_kind = 'capability' AND NOT (interpretation OR confidence = 'low')
"""
ORACLES["leaf_nodes"] = DN + f"""
SELECT {_NKEY} FROM n_nodes n
WHERE NOT EXISTS (SELECT 1 FROM n_children c WHERE c.perspective_id = n.perspective_id AND c.node_id = n.node_id)
"""
ORACLES["escape_inline_json"] = """
SELECT page_id, CAST((length(html) - length(replace(html, '</', ''))) / 2 AS BIGINT) AS n_breaks,
       true AS safe, true AS roundtrip
FROM pages
"""
ORACLES["hover_counts"] = DN + """,
rc AS (SELECT perspective_id, ord, count(*) FILTER (WHERE ref_kind = 'module') AS nm,
              count(*) FILTER (WHERE ref_kind = 'file') AS nf FROM n_refs GROUP BY 1, 2),
ends AS (SELECT perspective_id, from_id AS node_id FROM n_rels UNION ALL SELECT perspective_id, to_id FROM n_rels),
ec AS (SELECT perspective_id, node_id, count(*) AS nr FROM ends GROUP BY 1, 2)
SELECT n.repo_id, n.perspective_id, n.ord, n.node_id, coalesce(rc.nm, 0) AS n_modules, coalesce(rc.nf, 0) AS n_files,
       coalesce(ec.nr, 0) AS n_relationships
FROM n_nodes n LEFT JOIN rc ON rc.perspective_id = n.perspective_id AND rc.ord = n.ord
LEFT JOIN ec ON ec.perspective_id = n.perspective_id AND ec.node_id = n.node_id
"""

# ------------------------------------------------------------------ sources and sinks
ORACLES["commit_log_rows"] = D_WITH + """
SELECT repo_id, 'c' || commit_id AS commit_hash, seq, committed_at, path FROM d_touch
"""
ORACLES["commit_log_export"] = ORACLES["commit_log_rows"]
_DOCS = DN + """,
nd AS (SELECT perspective_id, ord, node_id, c, perspective_id || '#' || (c // 40) AS doc_id FROM n_nodes),
pid AS (SELECT DISTINCT doc_id, perspective_id AS p FROM nd
        UNION SELECT DISTINCT perspective_id || '#' || (c // 40), perspective_id FROM n_rels)
"""
_DOC_ROWS = _DOCS + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS npos
        FROM (SELECT n.*, n.perspective_id || '#' || (n.c // 40) AS doc_id FROM n_nodes n)),
rpos AS (SELECT *, perspective_id || '#' || (c // 40) AS doc_id,
                row_number() OVER (PARTITION BY perspective_id, c // 40 ORDER BY ord) - 1 AS npos FROM n_rels),
refs AS (SELECT *, row_number() OVER (PARTITION BY perspective_id, ord, ref_kind ORDER BY lno, lpk, ref_id) - 1 AS rp
         FROM n_refs),
cl0 AS (SELECT c.*, c.brief_id || '#' || (CAST(substr(c.label, 5) AS BIGINT) // 40) AS doc_id FROM n_claims c
        WHERE c.brief_id <> '5-LOW'),
cl AS (SELECT *, CASE claim_kind WHEN 'problem' THEN 0 WHEN 'solution' THEN 1 WHEN 'audience' THEN 2
                 ELSE 2 + row_number() OVER (PARTITION BY doc_id, claim_kind ORDER BY ord) END AS cpos
       FROM cl0 QUALIFY claim_kind = 'capability' OR row_number() OVER (PARTITION BY doc_id, claim_kind ORDER BY ord) = 1)
"""
ORACLES["read_narrative"] = _DOC_ROWS + """
SELECT doc_id, 'node' AS kind, npos AS ord, CAST(0 AS BIGINT) AS pos,
       concat_ws('|', node_id, label, description, tier, confidence, interpretation) AS value FROM pos
UNION ALL SELECT p.doc_id, r.ref_kind || '_ref', p.npos, r.rp, r.ref_id
FROM pos p JOIN refs r ON r.perspective_id = p.perspective_id AND r.ord = p.ord
UNION ALL SELECT p.doc_id, 'child', 0, c.pos, concat_ws('|', c.node_id, c.child_id)
FROM pos p JOIN n_children c ON c.perspective_id = p.perspective_id AND c.node_id = p.node_id
UNION ALL SELECT doc_id, 'relationship', npos, 0, concat_ws('|', from_id, to_id, confidence) FROM rpos
UNION ALL SELECT p.doc_id, 'edge_ref', p.npos, 0, x.edge_id
FROM rpos p JOIN n_relrefs x ON x.perspective_id = p.perspective_id AND x.ord = p.ord
UNION ALL SELECT doc_id, 'tier', 0, 0, '0|Top' FROM pid
UNION ALL SELECT doc_id, 'question', 0, 0, 'Why?' FROM pid WHERE p <> '5-LOW'
UNION ALL SELECT DISTINCT doc_id, 'brief', 0, 0, 'Brief ' || brief_id FROM cl
UNION ALL SELECT DISTINCT doc_id, 'tech', 0, 0, 'Flask|web|flask' FROM cl
UNION ALL SELECT doc_id, claim_kind, cpos, 0,
  concat_ws('|', CASE WHEN claim_kind = 'capability' THEN label ELSE '' END, text, confidence, interpretation,
            coalesce(perspective_ref, ''), coalesce(node_ref, '')) FROM cl
UNION ALL SELECT c.doc_id, 'claim_' || r.ref_kind || '_ref', c.cpos, r.rp, r.ref_id
FROM cl c JOIN refs r ON r.perspective_id = c.brief_id AND r.ord = c.ord
"""
ORACLES["normalize_perspectives"] = _DOCS + """
SELECT d.doc_id, CAST(0 AS BIGINT) AS ord,
       CASE WHEN d.p = '5-LOW' THEN 'default' ELSE d.p END AS perspective_id,
       CASE WHEN d.p = '5-LOW' THEN 'Overview' ELSE d.p END AS name,
       CASE WHEN d.p = '5-LOW' THEN 'structural'
            ELSE ['structural', 'functional', 'dataflow', 'runtime', 'domain'][CAST(left(d.p, 1) AS INTEGER)] END AS kind,
       CASE WHEN d.p = '5-LOW' THEN 'v1' ELSE 'v2' END AS shape
FROM pid d
"""
_FACTS_COUNTS = DM.replace("WITH ", "WITH ", 1) + "," + D_IMP_CTES.replace("d_ids", "dm_ids").rstrip() + f""",
dloc AS (SELECT repo_id, path FROM d_files),
cpl AS (SELECT a.repo_id, count(*) AS n FROM (
          SELECT a.repo_id, a.file_id AS fa, b.file_id AS fb FROM d_touch a JOIN d_touch b
            ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id AND a.file_id < b.file_id
          GROUP BY 1, 2, 3 HAVING count(*) >= 2) a GROUP BY 1),
ent AS (SELECT repo_id, count(*) AS n FROM (
          SELECT repo_id, file_id FROM m_entries
          UNION ALL SELECT w.repo_id, w.file_id FROM m_web w
          WHERE NOT EXISTS (SELECT 1 FROM m_entries e WHERE e.repo_id = w.repo_id AND e.file_id = w.file_id))
        GROUP BY 1),
mods AS (SELECT repo_id, count(DISTINCT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1)
                                             ELSE '.' END) AS n FROM dm_ids GROUP BY 1),
tiles AS (SELECT * FROM (""" + ORACLES["stat_tiles"] + """)),
modrec AS (SELECT repo_id, d, list(file_id ORDER BY file_id) AS ids,
                  row_number() OVER (PARTITION BY repo_id ORDER BY d) AS k
           FROM (SELECT repo_id, file_id, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1)
                                               ELSE '.' END AS d FROM dm_ids) GROUP BY repo_id, d),
couple AS (SELECT a.repo_id, ia.file_id AS fa, ib.file_id AS fb, count(*) AS n
           FROM d_touch a JOIN d_touch b ON a.repo_id = b.repo_id AND a.commit_id = b.commit_id
           JOIN dm_ids ia ON ia.repo_id = a.repo_id AND ia.path = a.path
           JOIN dm_ids ib ON ib.repo_id = b.repo_id AND ib.path = b.path
           WHERE ia.file_id < ib.file_id GROUP BY 1, 2, 3 HAVING count(*) >= 2),
rec AS (
  SELECT repo_id, 'repo' AS section, CAST(json_object('root', '/src/' || repo_id, 'headCommit', 'head-' || repo_id,
    'branch', 'main', 'generatedAt', '2024-01-01T00:00:00+00:00', 'totalFiles', n_files,
    'totalLoc', total_loc) AS VARCHAR) AS json FROM tiles
  UNION ALL SELECT repo_id, 'modules', CAST(json_object('id', printf('m%03d', k), 'path', d, 'fileIds', ids) AS VARCHAR)
  FROM modrec
  UNION ALL SELECT repo_id, 'edges', CAST(json_object('id', edge_id, 'type', 'import', 'from', from_id, 'to', to_id,
    'evidence', json_object('file', path, 'line', line, 'raw', raw), 'resolution', resolution,
    'extractor', 'treesitter') AS VARCHAR) FROM d_edges
  UNION ALL SELECT repo_id, 'gitCoupling', CAST(json_object('a', fa, 'b', fb, 'coChangeCount', n) AS VARCHAR) FROM couple),
cnt AS (
  SELECT repo_id, section, count(*) AS n_records,
         CAST(sum(('0x' || substr(md5(json), 1, 8))::BIGINT) AS BIGINT) AS digest FROM rec GROUP BY 1, 2
  UNION ALL SELECT repo_id, 'extractionReport', 1, NULL FROM m_repos
  UNION ALL SELECT repo_id, 'files', count(*), NULL FROM dm_ids GROUP BY 1
  UNION ALL SELECT repo_id, 'entrypoints', n, NULL FROM ent
  UNION ALL SELECT repo_id, 'externalDependencies', count(*), NULL FROM m_deps GROUP BY 1)
SELECT repo_id, section, n_records, digest, n_records AS n_parsed FROM cnt
"""
ORACLES["facts_document"] = _FACTS_COUNTS
ORACLES["write_facts"] = _FACTS_COUNTS

# ------------------------------------------------------------------ schema rules
ORACLES["facts_constraints"] = """
SELECT * FROM (VALUES
  ('repos', 'repo0', 'repo0', 'root-required'), ('repos', 'repo0', 'repo0', 'generated-at-required'),
  ('repos', 'repo0', 'repo0', 'total-files-minimum'), ('repos', 'repo0', 'repo0', 'total-loc-minimum'),
  ('report', 'repo0', '', 'languages-required'), ('report', 'repo0', '', 'resolved-minimum'),
  ('report', 'repo0', '', 'unresolved-minimum'), ('report', 'repo0', '', 'tools-required'),
  ('report', 'repo0', '', 'skipped-required'), ('report', 'repo0', '', 'warnings-required'),
  ('files', 'repo0', 'x0001', 'id-pattern'), ('files', 'repo0', 'x0001', 'loc-minimum'),
  ('edges', 'repo0', 'E1', 'id-pattern'), ('edges', 'repo0', 'E1', 'type-enum'),
  ('edges', 'repo0', 'E1', 'line-minimum'), ('edges', 'repo0', 'E1', 'resolution-enum'),
  ('edges', 'repo0', 'E1', 'extractor-enum'), ('entrypoints', 'repo0', 'f0001', 'kind-enum'),
  ('coupling', 'repo0', 'f0001', 'b-required'), ('coupling', 'repo0', 'f0001', 'count-minimum'))
  AS t("table", repo_id, "key", rule)
"""
_BROKEN = {   # table, key: the rules that the injected documents break
    ("documents", "bad#both"): ["one-of-shape"],
    ("documents", "bad#rules"): ["schema-version-required"],
    ("perspectives", "bad#rules|0"): ["id-required", "name-required", "kind-enum", "description-required",
                                      "tiers-min-items", "nodes-required", "relationships-required"],
    ("tiers", "bad#rules|p|0"): ["level-minimum", "name-required"],
    ("nodes", "bad#rules|p|0"): ["id-required", "tier-minimum", "label-required", "description-required",
                                 "confidence-enum", "interpretation-required", "fact-refs-required",
                                 "children-required"],
    ("relationships", "bad#rules|p|0"): ["from-required", "to-required", "label-required", "confidence-enum",
                                         "fact-edge-ids-required"],
    ("briefs", "bad#rules"): ["headline-min-length", "problem-required", "solution-required"],
    ("brief_claims", "bad#rules|3"): ["text-min-length", "fact-refs-required", "label-min-length",
                                      "confidence-enum", "interpretation-required"],
    ("tech", "bad#rules|0"): ["name-min-length", "fact-ref-min-length"],
}
ORACLES["narrative_constraints"] = _DOC_ROWS + """
SELECT 'brief_claims' AS "table", CAST(NULL AS VARCHAR) AS repo_id, doc_id || '|' || cpos AS "key",
       'text-min-length' AS rule FROM cl WHERE text = ''
UNION ALL SELECT 'briefs', NULL, d.doc_id, k || '-required'
FROM (SELECT DISTINCT doc_id FROM cl) d CROSS JOIN (SELECT unnest(['problem', 'solution']) AS k)
WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.doc_id = d.doc_id AND cl.claim_kind = k)
UNION ALL SELECT * FROM (VALUES """ + ", ".join(
    f"('{t}', NULL, '{k}', '{r}')" for (t, k), rules in _BROKEN.items() for r in rules) + """)
"""

# ------------------------------------------------------------------ streaming
ORACLES["stream_churn"] = """
WITH b AS (SELECT user_id AS file_id, time_bucket(INTERVAL 1 hour, ts) AS ws FROM events)
SELECT file_id, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS touches FROM b
GROUP BY 1, 2
"""
ORACLES["stream_last_touch"] = """
SELECT user_id AS file_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts,
       max(event_id) FILTER (WHERE ts = last) AS last_event_id
FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last FROM events) GROUP BY 1
"""
ORACLES["stream_orphan_refs"] = """
SELECT event_id, user_id AS file_id FROM events
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
"""

ORACLES["stream_orphan_refs_changing"] = """
SELECT c.event_id, c.user_id AS file_id FROM events c WHERE c.event_type = 'click' AND NOT EXISTS (
  SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = c.user_id
  AND v.ts >= c.ts - INTERVAL 2 HOUR AND v.ts <= c.ts + INTERVAL 1 HOUR)
"""

# ------------------------------------------------------------------ planned extensions
ORACLES["snapshot_diff"] = D_WITH + """
SELECT repo_id, path, CASE WHEN partkey % 5 = 0 THEN 'added' WHEN partkey % 7 = 0 THEN 'removed'
                           ELSE 'changed' END AS status
FROM d_parts
WHERE (partkey % 5 = 0 AND partkey % 7 <> 0) OR (partkey % 7 = 0 AND partkey % 5 <> 0)
   OR (partkey % 5 <> 0 AND partkey % 7 <> 0 AND partkey % 11 = 0)
"""
ORACLES["entry_reachability"] = DM_IMP.replace("WITH ", "WITH RECURSIVE ", 1) + """,
ents AS (SELECT DISTINCT repo_id, file_id FROM (
           SELECT repo_id, file_id FROM m_entries
           UNION ALL SELECT w.repo_id, w.file_id FROM m_web w
           WHERE NOT EXISTS (SELECT 1 FROM m_entries e WHERE e.repo_id = w.repo_id AND e.file_id = w.file_id))),
st AS (SELECT DISTINCT repo_id, from_id, to_id FROM d_edges WHERE to_id IS NOT NULL),
r(repo_id, entry_id, file_id, depth) USING KEY (repo_id, entry_id, file_id) AS (
  SELECT repo_id, file_id, file_id, 0 FROM ents
  UNION
  SELECT DISTINCT r.repo_id, r.entry_id, s.to_id, r.depth + 1
  FROM r JOIN st s ON s.repo_id = r.repo_id AND s.from_id = r.file_id
  WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.repo_id = r.repo_id
                    AND x.entry_id = r.entry_id AND x.file_id = s.to_id))
SELECT repo_id, entry_id, file_id, CAST(depth AS INTEGER) AS depth FROM r
"""

ORACLES["main_guard_entry"] = D_WITH + """
SELECT repo_id, path, 'cli' AS kind FROM d_parts WHERE ext = '.py' AND partkey % 53 = 0
UNION ALL
SELECT repo_id, path, 'web' AS kind FROM d_parts WHERE ext = '.py' AND partkey % 59 = 0
"""
ORACLES["more_manifests"] = DM + """
SELECT repo_id, 'example.org/lib' || k AS name, 'v1.' || k || '.0' AS version, 'go' AS ecosystem,
       'go.mod' AS manifest FROM m_s
UNION ALL SELECT repo_id, name, CASE WHEN k % 2 = 0 THEN '1.' || k || '.0' END, 'rubygems', 'Gemfile' FROM m_s
UNION ALL SELECT repo_id, name, '1.' || k || '.0', 'cargo', 'Cargo.toml' FROM m_s
UNION ALL SELECT repo_id, 'vendor/' || name, '^1.' || k || '.0', 'packagist', 'composer.json' FROM m_s
"""
ORACLES["nested_manifests"] = DM + """
SELECT repo_id, 'org.x:' || name AS name, '1.' || k || '.0' AS version, 'maven' AS ecosystem,
       unnest(['pom.xml', 'build.gradle']) AS manifest FROM m_s
UNION ALL SELECT repo_id, name, '1.' || k || '.0', 'nuget', 'App.csproj' FROM m_s
UNION ALL SELECT repo_id, name, CASE WHEN k % 3 = 0 THEN '1.' || k || '.0' END, 'pypi', 'setup.cfg' FROM m_s
"""
