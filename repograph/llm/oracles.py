"""DuckDB SQL for the queries that SQL can express."""

_SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
_KEY = (f"translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz')")

OP5_LINE_DEDUP = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
g AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, g.first IS NOT NULL AND g.first <> k.doc_id AS dropped
      FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
         AS kept_sha256
FROM m GROUP BY doc_id
"""

def _shingle_sql(table: str, key: str) -> str:
    """Distinct five-word shingles of a table; fewer words: the whole sequence."""
    words = (f"string_split_regex(translate(trim(coalesce(text, ''), {_SPACE}), "
             "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+')")
    return (f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE "
            "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s "
            f"FROM (SELECT {key}, {words} AS w FROM {table}) WHERE w[1] <> ''")


OP3_DECONTAMINATION = f"""
WITH i AS ({_shingle_sql('benchmark', 'item_id')}),
d AS ({_shingle_sql('documents', 'doc_id')}),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, n_found / n_shingles AS containment
FROM f JOIN n USING (item_id) WHERE n_found / n_shingles >= 0.8
"""

#: Base 32 of a hexadecimal SHA-1: its 160 bits, five at a time.
_BITS = ("array_to_string(list_transform(range(1, 41), lambda i: substr("
         "'0000000100100011010001010110011110001001101010111100110111101111', "
         "4 * instr('0123456789abcdef', substr(hex, i, 1)) - 3, 4)), '')")
_BASE32 = ("array_to_string(list_transform(range(0, 32), lambda i: substr("
           "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: "
           "substr(bits, 5 * i + j, 1)::INT * (1 << (5 - j))))::BIGINT, 1)), '')")

OP9_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex),
b AS (SELECT page_id, strlen(html) AS payload_bytes, last, {_BITS} AS bits FROM p JOIN m USING (hex))
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM b
"""

def _assigned(codebook: str) -> str:
    """Nearest entry and squared distance of every part, given (part, entry, c) of a codebook."""
    return (f"SELECT id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.id, p.part, "
            "b.entry, list_sum(list_transform(list_zip(p.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
            f"::BIGINT AS d FROM p JOIN {codebook} b ON b.part = p.part) GROUP BY id, part")


def _updated(codebook: str, assigned: str) -> str:
    """The codebook with each used entry replaced by the floor of its parts' mean."""
    mean = "".join(f", floor(sum(p.c[{i}]) / count(*))::BIGINT" for i in range(1, 5)).lstrip(", ")
    return (f"SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {codebook} b LEFT JOIN (SELECT p.part, "
            f"a.entry, [{mean}] AS c FROM p JOIN {assigned} a ON a.id = p.id AND a.part = p.part "
            "GROUP BY p.part, a.entry) m ON m.part = b.part AND m.entry = b.entry")


#: For 64 components, 16 parts of 4, 64 entries and two rounds.
OP11_VECTOR_CODES = f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS id,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
p AS MATERIALIZED (SELECT id, part, ints[4 * part + 1:4 * part + 4] AS c
  FROM v, (SELECT unnest(range(16)) AS part)),
b0 AS MATERIALIZED (SELECT part, id - 1 AS entry, c FROM p WHERE id <= 64),
a0 AS MATERIALIZED ({_assigned('b0')}),
b1 AS MATERIALIZED ({_updated('b0', 'a0')}),
a1 AS MATERIALIZED ({_assigned('b1')}),
b2 AS MATERIALIZED ({_updated('b1', 'a1')}),
a2 AS MATERIALIZED ({_assigned('b2')}),
r AS (SELECT id, string_agg(lower(lpad(to_base(entry, 16), 2, '0')), '' ORDER BY part) AS code,
    sum(d)::BIGINT AS error FROM a2 GROUP BY id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM r JOIN v USING (id), h
"""

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
_CRC_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"

OP12_IMPORTANCE_RESAMPLE = f"""
WITH RECURSIVE steps(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL
  SELECT i, {_CRC_STEP}, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
q AS MATERIALIZED (SELECT unnest({_WORDS}) AS w FROM benchmark),
u AS (SELECT w, list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(w)), '..'),
    lambda x: ('0x' || x)::BIGINT)) AS bytes FROM (SELECT w FROM d UNION SELECT w FROM q)),
k AS MATERIALIZED (SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])),
    4294967295) % 10000 AS bucket FROM u, crc),
s AS (SELECT bucket, count(*) AS s FROM d JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM q JOIN k USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM d) + 10000 AS s_all, (SELECT count(*) FROM q) + 10000 AS t_all),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * s_all / ((s + 1)::DOUBLE * t_all)))::BIGINT
    AS gain FROM s LEFT JOIN t USING (bucket), n),
x AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM d JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)
      ::DOUBLE / 4294967296)))::BIGINT AS score
    FROM (SELECT doc_id FROM documents) LEFT JOIN x USING (doc_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS nth,
    count(*) OVER (PARTITION BY n_features >= 20) AS of FROM y)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND nth <= 10 * of // 100 THEN nth END AS rank FROM z
"""

#: For pages that mark their article and hold no other references than these.
OP13_HTML_TEXT = r"""
WITH b AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''),
    '<article>(.*?)</article>', 1, 's'), '</?(p|h1)>') AS parts FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
    regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""

#: Every pair of a label compared, components by following all links: for small tables.
OP10_EMBEDDING_DEDUP = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL
  AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.x, r.root FROM r JOIN links l ON l.y = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""
