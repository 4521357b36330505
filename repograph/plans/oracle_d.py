"""DuckDB SQL that derives corpus D from the STRUCTURED tables (never from the text).

Used as the independent oracle of ``__spark_entry__.oracle_sql``. Each oracle is
``D_WITH + ", <more ctes> SELECT ..."``.
"""

NL = "chr(10)"

D_CTES = r"""
d_p0 AS (
  SELECT p_partkey AS partkey, p_size, lower(p_type) AS ptype,
         CASE WHEN lower(p_type) IN ('economy', 'small', 'large') THEN 'src/' ELSE '' END AS root,
         'pkg_' || lower(p_type) AS pkg,
         'b' || regexp_extract(p_brand, '(\d+)$', 1) AS bdir,
         CASE WHEN (p_partkey // 4) % 8 <= 4 THEN '.py'
              WHEN (p_partkey // 4) % 8 = 5 THEN '.js'
              WHEN (p_partkey // 4) % 8 = 6 THEN '.ts' ELSE '.md' END AS ext,
         'repo' || (p_partkey % 4) AS repo_id
  FROM part),
d_parts AS (
  SELECT *, root || pkg || '/' || bdir AS dir,
         root || pkg || '/' || bdir || '/m' || partkey || ext AS path,
         pkg || '.' || bdir || '.m' || partkey AS modname
  FROM d_p0),
d_inits AS (
  SELECT DISTINCT repo_id, root || pkg || '/__init__.py' AS path,
         repeat(chr(34), 3) || 'Package ' || pkg || '.' || repeat(chr(34), 3) || chr(10) AS content FROM d_parts
  UNION ALL
  SELECT DISTINCT repo_id, dir || '/__init__.py' AS path,
         repeat(chr(34), 3) || 'Package ' || bdir || '.' || repeat(chr(34), 3) || chr(10) AS content FROM d_parts),
d_tp AS (
  SELECT DISTINCT l.l_orderkey AS commit_id, l.l_partkey AS partkey, o.o_orderdate AS committed_ts
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
d_nx AS (
  SELECT 'repo' || (partkey % 4) AS repo_id, commit_id, partkey,
         lead(partkey) OVER (PARTITION BY partkey % 4, commit_id ORDER BY partkey) AS nxt
  FROM d_tp),
d_pairs AS (
  SELECT DISTINCT repo_id,
         CASE WHEN commit_id % 2 = 0 THEN partkey ELSE nxt END AS f,
         CASE WHEN commit_id % 2 = 0 THEN nxt ELSE partkey END AS t
  FROM d_nx WHERE nxt IS NOT NULL),
d_lines AS (
  SELECT pr.repo_id, pr.f, pr.t, fp.ext AS f_ext, tp.ext AS t_ext, fp.path AS f_path,
         tp.path AS t_path, fp.dir AS f_dir, fp.ptype AS f_ptype, tp.ptype AS t_ptype,
         tp.modname AS t_modname, tp.bdir AS t_bdir, fp.root AS f_root, tp.root AS t_root,
         (CASE WHEN fp.dir = tp.dir THEN './'
               ELSE repeat('../', len(string_split(fp.dir, '/'))) || tp.dir || '/' END)
           || 'm' || pr.t || (CASE WHEN tp.ext = '.md' THEN '.md' ELSE '' END) AS spec,
         CASE WHEN fp.ext = '.py' THEN
                CASE WHEN tp.ext = '.py' THEN
                       CASE WHEN (pr.f + pr.t) % 3 = 0 THEN 'from ' || tp.modname || ' import thing'
                            WHEN (pr.f + pr.t) % 3 = 1 THEN 'import ' || tp.modname
                            WHEN fp.ptype = tp.ptype THEN 'from ..' || tp.bdir || '.m' || pr.t || ' import thing'
                            ELSE 'from ' || tp.modname || ' import thing' END
                     ELSE 'import ext_lib_' || (pr.t % 10) END
              WHEN fp.ext IN ('.js', '.ts') THEN
                CASE WHEN tp.ext = '.py' THEN
                       CASE WHEN pr.f % 5 = 0 THEN 'const React = require(''react'');'
                            ELSE 'import React from ''react'';' END
                     ELSE
                       CASE WHEN pr.f % 5 = 0 THEN 'const m' || pr.t || ' = require('''
                              || ((CASE WHEN fp.dir = tp.dir THEN './'
                                   ELSE repeat('../', len(string_split(fp.dir, '/'))) || tp.dir || '/' END)
                                   || 'm' || pr.t || (CASE WHEN tp.ext = '.md' THEN '.md' ELSE '' END))
                              || ''');'
                            ELSE 'import { m' || pr.t || ' } from '''
                              || ((CASE WHEN fp.dir = tp.dir THEN './'
                                   ELSE repeat('../', len(string_split(fp.dir, '/'))) || tp.dir || '/' END)
                                   || 'm' || pr.t || (CASE WHEN tp.ext = '.md' THEN '.md' ELSE '' END))
                              || ''';' END
                END
              ELSE 'Related to m' || pr.t || '.' END AS text
  FROM d_pairs pr JOIN d_parts fp ON fp.partkey = pr.f JOIN d_parts tp ON tp.partkey = pr.t),
d_body AS (
  SELECT repo_id, f AS partkey, string_agg(text, chr(10) ORDER BY t) AS body, count(*) AS n_lines
  FROM d_lines GROUP BY repo_id, f),
d_pfiles AS (
  SELECT p.repo_id, p.path, p.partkey, p.ext,
         concat_ws(chr(10),
           CASE WHEN p.ext = '.py' THEN '# m' || p.partkey || ' module'
                WHEN p.ext IN ('.js', '.ts') THEN '// m' || p.partkey || ' module'
                ELSE '# Notes on m' || p.partkey END,
           b.body,
           CASE WHEN p.ext = '.py' AND p.partkey % 97 = 0 THEN 'app = FastAPI()'
                WHEN p.ext = '.py' AND p.partkey % 89 = 0 THEN
                  'def create_app():' || chr(10) || '    return Flask(__name__)' || chr(10) || chr(10) || 'application = create_app()'
           END) || chr(10) AS content
  FROM d_parts p LEFT JOIN d_body b ON b.repo_id = p.repo_id AND b.partkey = p.partkey),
d_files AS (
  SELECT repo_id, path, content FROM d_pfiles
  UNION ALL SELECT repo_id, path, content FROM d_inits),
d_ids AS (
  SELECT repo_id, path, content,
         printf('f%04d', row_number() OVER (PARTITION BY repo_id ORDER BY path)) AS file_id
  FROM d_files),
d_commits AS (
  SELECT 'repo' || (t.partkey % 4) AS repo_id, t.commit_id, t.committed_ts,
         strftime(t.committed_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS committed_at, p.path
  FROM d_tp t JOIN d_parts p ON p.partkey = t.partkey),
d_seq AS (
  SELECT repo_id, commit_id,
         row_number() OVER (PARTITION BY repo_id ORDER BY committed_ts DESC, commit_id DESC) AS seq
  FROM (SELECT DISTINCT repo_id, commit_id, committed_ts FROM d_commits)),
d_touch AS (
  SELECT c.repo_id, c.commit_id, s.seq, c.committed_at, c.path, i.file_id
  FROM d_commits c JOIN d_seq s USING (repo_id, commit_id) JOIN d_ids i USING (repo_id, path))
"""

D_WITH = "WITH " + D_CTES.strip()

# Structural import edges of D: one per line of a .py/.js/.ts file that refers to t.
D_IMP_CTES = r"""
d_imp0 AS (
  SELECT l.*, 1 + row_number() OVER (PARTITION BY l.repo_id, l.f ORDER BY l.t) AS line,
         CASE WHEN l.f_ext = '.py' AND l.t_ext = '.py' AND (l.f + l.t) % 3 = 2
                   AND l.f_ptype = l.t_ptype THEN 2 ELSE 0 END AS lvl
  FROM d_lines l),
d_imp AS (
  SELECT i.repo_id, fi.file_id AS from_id, i.f_path AS path, i.line, i.text AS raw, i.lvl AS level,
         i.f, i.t, i.f_ext, i.t_ext, i.t_root,
         CASE WHEN i.f_ext = '.py' THEN 'python' ELSE 'js' END AS lang,
         CASE WHEN i.f_ext = '.py' AND i.t_ext = '.py' AND i.lvl = 2 THEN i.t_bdir || '.m' || i.t
              WHEN i.f_ext = '.py' AND i.t_ext = '.py' THEN i.t_modname
              WHEN i.f_ext = '.py' THEN 'ext_lib_' || (i.t % 10)
              WHEN i.t_ext = '.py' THEN 'react'
              ELSE i.spec END AS module,
         CASE WHEN (i.f_ext = '.py' AND i.t_ext = '.py') OR (i.f_ext IN ('.js', '.ts') AND i.t_ext <> '.py')
              THEN ti.file_id END AS to_id
  FROM d_imp0 i
  JOIN d_ids fi ON fi.repo_id = i.repo_id AND fi.path = i.f_path
  JOIN d_ids ti ON ti.repo_id = i.repo_id AND ti.path = i.t_path
  WHERE i.f_ext IN ('.py', '.js', '.ts')),
d_edges AS (
  SELECT *, CASE WHEN to_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS resolution,
         printf('e%04d', row_number() OVER (PARTITION BY repo_id ORDER BY path, line, raw)) AS edge_id
  FROM d_imp)
"""

D_IMP = D_WITH + "," + D_IMP_CTES.rstrip()
