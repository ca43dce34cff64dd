"""DuckDB twins of the registered queries, over the same tables."""

from __future__ import annotations

from quillmap import constants as K

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# --- fragments --------------------------------------------------------------

def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def clean(x: str, keep: str = K.CLEAN_KEEP) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower({x}), '[^{keep}\\s]', ' ', 'g'), "
            "'\\s+', ' ', 'g'))")


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def words(x: str) -> str:
    return f"list_filter(string_split({clean(x)}, ' '), lambda w: w <> '')"


def ratio(q: str, t: str) -> str:
    qw = f"list_distinct({words(q)})"
    return (f"CASE WHEN len({qw}) = 0 THEN 0.0 ELSE "
            f"len(list_filter({qw}, lambda w: contains({clean(t)}, w))) / len({qw})::DOUBLE END")


def quoted(items) -> str:
    return ", ".join("'" + i + "'" for i in items)


def noisy(x: str) -> str:
    v = f"trim(coalesce({x}, ''))"
    return (f"(CASE WHEN length({v}) < 3 THEN true "
            f"WHEN regexp_matches({v}, '^([0-9]+\\.?[0-9]*|\\.[0-9]+)$') THEN true "
            f"WHEN NOT contains({v}, ' ') AND regexp_matches({v}, '[0-9]') THEN true "
            f"WHEN length(regexp_replace({v}, '[^0-9]', '', 'g'))::DOUBLE / length({v}) > 0.15 "
            f"THEN true ELSE lower({v}) IN ({quoted(K.LABEL_STOP_WORDS)}) END)")


def base(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def dirn(p: str) -> str:
    return f"(CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '' END)"


def parent(p: str) -> str:
    return f"lower({base(dirn(p))})"


def stem(p: str) -> str:
    return f"split_part(lower({base(p)}), '.', 1)"


def ext(p: str) -> str:
    return f"lower(regexp_extract({base(p)}, '^.+(\\.[^.]*)$', 1))"


def any_word(c: str, ws) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in ws) + ")"


PATHS = """
paths AS (
  SELECT p_partkey AS key, 'raw/a' || (p_size % 7) AS archive,
    'raw/a' || (p_size % 7) || '/'
    || CASE p_partkey % 3 WHEN 0 THEN 'images' WHEN 1 THEN lower(p_type) ELSE 'train' END || '/'
    || CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE 'img' || p_partkey END
    || ['.jpg', '.csv', '.PDF', '.bmp', '.JPEG', '.tar.gz', '.txt'][p_partkey % 7 + 1] AS path
  FROM part)
"""

FILES = """
files AS (
  SELECT doc_id, text, lang, source, n_chars, 'raw/' || source || '/' || lang AS archive,
    'raw/' || source || '/' || lang || '/doc_' || doc_id || '.txt' AS path,
    md5(text) AS file_hash, (1704067200 + doc_id) * 1000000 AS mtime
  FROM documents),
indexed AS (
  SELECT doc_id, file_hash, path AS source, archive FROM files
  WHERE doc_id IN (SELECT doc_id FROM labels)),
signatures AS (
  SELECT archive, md5(archive || '_' || max(mtime) || '_' || count(*)) AS signature
  FROM files GROUP BY archive),
contracts AS (
  SELECT archive AS folder_path, md5(archive || '_' || max(mtime) || '_' || count(*)) AS signature,
    CASE WHEN archive LIKE '%/fr' THEN 'unknown' ELSE split_part(archive, '/', 3) END
      AS assigned_domain,
    0.9::FLOAT AS confidence, 0 AS is_verified
  FROM files WHERE n_chars >= 200 GROUP BY archive)
"""

STATUS = """
status AS (
  SELECT f.doc_id, f.file_hash, f.path,
    CASE WHEN EXISTS (SELECT 1 FROM indexed i
                      WHERE i.file_hash = f.file_hash AND i.source = f.path) THEN 'exists'
         WHEN EXISTS (SELECT 1 FROM indexed i WHERE i.file_hash = f.file_hash) THEN 'moved'
         ELSE 'new' END AS status
  FROM files f)
"""


def embed(src: str, key: str, text: str, name: str, dim: int = 64) -> str:
    """CTEs that hash the words of ``text`` into unit vectors: ``name`` (key, vec)."""
    return f"""
{name}_w AS (SELECT {key}, unnest({words(text)}) AS w FROM {src}),
{name}_s AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::UBIGINT % {dim} AS pos,
    sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM {name}_w GROUP BY 1, 2),
{name}_n AS (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}_s GROUP BY 1),
{name} AS (
  SELECT i.{key}, list(coalesce(s.x, 0.0) / i.n ORDER BY r.pos) AS vec
  FROM (SELECT * FROM {name}_n WHERE n > 0) i CROSS JOIN range({dim}) r(pos)
  LEFT JOIN {name}_s s ON s.{key} = i.{key} AND s.pos = r.pos GROUP BY 1)
"""


def fused(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NULL THEN {b} WHEN {b} IS NULL THEN {a} ELSE "
            f"list_transform(range(1, len({a}) + 1), lambda i: (({a})[i] + ({b})[i]) / 2) END")


CATALOG = FILES + "," + embed("documents", "doc_id", "text", "tv") + f""",
catalog AS (
  SELECT f.doc_id, f.file_hash AS doc_hash, f.path AS source, f.archive,
    coalesce('d' || e.label, 'unknown') AS domain, f.lang AS label, f.text,
    substr(f.text, 1, 500) AS snippet, e.embedding::DOUBLE[] AS visual,
    {fused('tv.vec', 'e.embedding::DOUBLE[]')} AS vector, f.n_chars
  FROM files f LEFT JOIN embeddings e ON e.vec_id = f.doc_id LEFT JOIN tv USING (doc_id))
"""

QUERIES = f"""
raw_q AS (
  SELECT item_id * 2 + v AS qid, e.embedding::DOUBLE[] AS visual,
    CASE WHEN v = 0 THEN b.text ELSE '' END AS ocr_text, 'd' || e.label AS d,
    ['en', 'fr', 'de', 'es', 'unknown'][e.label % 5 + 1] AS l
  FROM benchmark b CROSS JOIN range(2) t(v) LEFT JOIN embeddings e ON e.vec_id = b.item_id),
{embed('raw_q', 'qid', 'ocr_text', 'qv')},
queries AS (
  SELECT q.qid, q.visual, {fused('qv.vec', 'q.visual')} AS vector, q.ocr_text,
    CASE WHEN length(q.ocr_text) >= 5 THEN coalesce(d, 'unknown') ELSE 'unknown' END AS f_domain,
    CASE WHEN length(q.ocr_text) >= 5 THEN coalesce(l, 'unknown') ELSE 'unknown' END AS f_label
  FROM raw_q q LEFT JOIN qv USING (qid))
"""


def top(name: str, no: int, cat: str, qry: str, k: int, where: str = "true") -> str:
    return f"""
{name} AS (
  SELECT {no} AS pass_no, * FROM (
    SELECT qid, doc_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, doc_id) AS rk
    FROM (SELECT q.qid, c.doc_id, {r6(f'1 - list_cosine_similarity(c.{cat}, q.{qry})')} AS dist
          FROM queries q, catalog c
          WHERE c.{cat} IS NOT NULL AND q.{qry} IS NOT NULL AND ({where})))
  WHERE rk <= {k})
"""


PREDICATE = ("(q.f_domain <> 'unknown' OR q.f_label <> 'unknown')"
             " AND (q.f_domain = 'unknown' OR c.domain = q.f_domain)"
             " AND (q.f_label = 'unknown' OR contains(c.label, q.f_label))")


def search_ctes(k: int) -> str:
    return ",".join([
        CATALOG, QUERIES, top("p1", 1, "visual", "visual", k),
        top("p2", 2, "vector", "vector", k), top("p3", 3, "vector", "vector", k, PREDICATE),
    ]) + f""",
merged AS (
  SELECT * EXCLUDE (n) FROM (
    SELECT h.*, c.doc_hash, c.source, c.domain, c.label, c.snippet, row_number() OVER (
      PARTITION BY qid, doc_hash ORDER BY pass_no, rk, h.doc_id) AS n
    FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) h
    JOIN catalog c USING (doc_id)) WHERE n = 1),
proofs AS (
  SELECT m.*, greatest(0.0, least(1.0, 1.0 - m.dist)) AS s_visual,
    CASE WHEN q.ocr_text <> '' THEN {ratio('q.ocr_text', "m.label || ' ' || m.snippet")}
         ELSE 0.0 END AS s_text,
    CASE WHEN m.domain = q.f_domain THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_intent,
    CASE WHEN q.ocr_text <> '' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS w_text
  FROM merged m JOIN queries q USING (qid)),
scored AS (
  SELECT *, (s_visual * 0.6::DOUBLE + s_text * w_text + s_intent * 0.1::DOUBLE)
    / (0.7::DOUBLE + w_text) * 100 AS confidence_raw FROM proofs),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY qid
    ORDER BY round(confidence_raw, 4) DESC, pass_no, rk, doc_id) AS rank FROM scored)
"""


def elements(ctes: str, src: str, key: str, vec: str) -> str:
    return (f"WITH {ctes} SELECT {key}, i - 1 AS pos, {r6(f'{vec}[i]')} AS x "
            f"FROM {src} CROSS JOIN range(1, 65) r(i) WHERE {vec} IS NOT NULL")


# --- sources ----------------------------------------------------------------

_TYPE = "CASE " + ext("path") + " " + " ".join(
    f"WHEN '{e}' THEN '{t}'" for e, t in K.EXTENSION_TYPES.items()) + " END"

oracle("scan_by_extension", f"""WITH {PATHS} SELECT {_TYPE} AS type, count(*) AS n FROM paths
WHERE {_TYPE} IS NOT NULL AND NOT starts_with({base('path')}, '.') GROUP BY 1""")
oracle("route_by_extension", f"""WITH {PATHS} SELECT key, path,
coalesce({_TYPE}, 'unsupported') AS type, coalesce({_TYPE} = 'image', false) AS visual FROM paths""")
oracle("unsupported_files", f"""WITH {PATHS} SELECT path,
'no reader for this extension' AS error FROM paths WHERE {_TYPE} IS NULL""")
oracle("csv_records", """SELECT 'csv' AS type, p_partkey::VARCHAR AS p_partkey, p_name, p_brand,
p_type, p_size::VARCHAR AS p_size FROM part""")
oracle("csv_mixed_records", """SELECT p_name AS name, p_partkey::VARCHAR AS id,
NULL::VARCHAR AS segment FROM part
UNION ALL SELECT c_name, c_custkey::VARCHAR, c_mktsegment FROM customer""")
oracle("csv_odd_headers", """SELECT row_number() OVER (PARTITION BY p_size % 7 ORDER BY p_partkey) - 1
AS position, p_partkey::VARCHAR AS key, p_name AS name, p_brand AS brand FROM part""")
oracle("csv_quoted_breaks", """SELECT doc_id AS id, md5(text) AS text FROM documents
UNION ALL SELECT p_partkey, md5(p_name) FROM part""")
oracle("tsv_records", """SELECT 'tsv' AS type, s_suppkey::VARCHAR AS s_suppkey, s_name,
s_nationkey::VARCHAR AS s_nationkey FROM supplier""")
oracle("json_records", """
WITH e AS (SELECT event_id::VARCHAR AS path, event_type,
  json_extract(props, '$.k')::INT AS k FROM events)
SELECT path, unnest([0, 2])::BIGINT AS position, k FROM e WHERE event_type = 'click'
UNION ALL SELECT path, 0::BIGINT, k FROM e WHERE event_type = 'view'""")

TXT = f"""
txt_l AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(
  text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS lines FROM documents),
txt_f AS (SELECT doc_id, text, lines, len(lines) > 2 AND
  list_sum(list_transform(lines[1:20], lambda x: len(regexp_extract_all(x, '\\S+'))))::DOUBLE
  / len(lines[1:20]) < 15 AS is_list FROM txt_l),
txt_p AS (
  SELECT doc_id, is_list, i - 1 AS position, {clean('lines[i]')} AS content
  FROM txt_f, unnest(range(1, len(lines) + 1)) t(i) WHERE is_list
  UNION ALL SELECT doc_id, is_list, 0, {clean('text')} FROM txt_f WHERE NOT is_list),
txt_docs AS (SELECT doc_id, position, content, CASE WHEN is_list THEN content END AS suggested_label
  FROM txt_p WHERE NOT is_list OR length(content) > 2)
"""
oracle("txt_list_explode",
       f"WITH {TXT} SELECT doc_id, position, content, suggested_label FROM txt_docs")
oracle("assemble_pages", """SELECT conv_id AS path, string_agg(text, chr(10) ORDER BY turn)
AS content, count(*) AS n_pages FROM conversations GROUP BY conv_id""")
oracle("blob_summary", """
SELECT page_id::VARCHAR AS name,
  CASE WHEN strlen(html) > 10240
       THEN 'Large Dataset: shape=(' || length(html) || ',), dtype=object' ELSE html END AS summary,
  CASE WHEN contains(url, '?') THEN regexp_extract(url, '^https?://([^/]*)', 1)
       ELSE nullif(regexp_extract(url, '^https?://[^/]*/([^/]*)/', 1), '') END AS suggested_label
FROM pages""")
oracle("ocr_assemble", """
SELECT user_id::VARCHAR AS path, coalesce(string_agg(event_type, ' ' ORDER BY event_id)
  FILTER (value / (SELECT max(value) FROM events) > 0.2), '') AS content
FROM events GROUP BY user_id""")
_UNIT = "sqrt(list_sum(list_transform(vector, lambda x: x * x)))"
oracle("catalog_rows", f"""WITH {CATALOG} SELECT source, doc_hash, 'txt' AS type, domain, label,
'' AS image_linked, snippet, least(20000, length(text)) AS content_chars,
{r6(f'(vector[1] / {_UNIT})::FLOAT::DOUBLE')} AS v_first,
{r6(f'(vector[64] / {_UNIT})::FLOAT::DOUBLE')} AS v_last,
visual IS NOT NULL AS has_image FROM catalog""")
oracle("reset_then_load", """SELECT lang AS domain, count(*) AS n,
count(DISTINCT md5(text)) AS n_hashes, sum(least(20000, length(text)))::BIGINT AS chars
FROM documents GROUP BY 1""")

# --- hashing and incremental load -------------------------------------------

oracle("fingerprint_docs", """
WITH b AS (SELECT doc_id, encode(text) AS b, strlen(text) AS n,
  encode(strlen(text) || '_' || (1704067200 + doc_id) * 1000000) AS head FROM documents)
SELECT doc_id, md5(CASE WHEN n <= 2000 THEN head || b
  ELSE head || b[1:200] || b[n // 2 + 1:n // 2 + 200] || b[n - 199:n] END) AS fingerprint
FROM b""")
oracle("record_hash", f"""WITH {TXT} SELECT t.doc_id, position,
CASE WHEN count(*) OVER (PARTITION BY t.doc_id) > 1 THEN md5(md5(d.text) || '_' || position)
     ELSE md5(d.text) END AS doc_hash FROM txt_docs t JOIN documents d USING (doc_id)""")
oracle("folder_signature", f"WITH {FILES} SELECT archive, signature FROM signatures")
oracle("skip_unchanged_folders", f"""WITH {FILES} SELECT archive, doc_id FROM files
WHERE archive IN (SELECT archive FROM signatures s WHERE NOT EXISTS (SELECT 1 FROM contracts c
  WHERE c.folder_path = s.archive AND c.signature = s.signature))""")
oracle("new_files_only", f"""WITH {FILES} SELECT doc_id, file_hash FROM files
WHERE file_hash NOT IN (SELECT file_hash FROM indexed)""")
oracle("indexed_hashes", f"WITH {FILES} SELECT DISTINCT file_hash FROM indexed")
oracle("file_status", f"WITH {FILES}, {STATUS} SELECT doc_id, status FROM status")
oracle("apply_moves", f"""WITH {FILES}, {STATUS},
m AS (SELECT file_hash, max(path) AS p FROM status WHERE status = 'moved' GROUP BY 1)
SELECT i.doc_id, coalesce(m.p, i.source) AS source FROM indexed i LEFT JOIN m USING (file_hash)""")
oracle("contract_upsert", f"""WITH {FILES},
u AS (SELECT archive, signature FROM signatures s WHERE NOT EXISTS (SELECT 1 FROM contracts c
  WHERE c.folder_path = s.archive AND c.signature = s.signature))
SELECT folder_path, signature, assigned_domain, is_verified FROM contracts
WHERE folder_path NOT IN (SELECT archive FROM u)
UNION ALL SELECT archive, signature, 'new', 1 FROM u""")
oracle("contract_lookup", f"""WITH {FILES} SELECT doc_id, assigned_domain,
{r6('confidence::DOUBLE')} AS confidence
FROM files LEFT JOIN contracts ON folder_path = archive""")
oracle("ingest_counters", f"""WITH {FILES}, {STATUS}
SELECT status, count(*) AS n FROM status GROUP BY 1""")

# --- text -------------------------------------------------------------------

oracle("clean_text", f"SELECT doc_id, {clean('text')} AS t FROM documents")
oracle("text_match_ratio", f"""SELECT a.conv_id, a.turn, {r6(ratio('a.text', 'b.text'))} AS ratio
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
oracle("snippets", """SELECT doc_id, substr(text, 1, 500) AS snippet,
md5(substr(text, 1, 20000)) AS content_md5 FROM documents""")
oracle("path_parts", f"""WITH {PATHS},
p AS (SELECT path FROM paths UNION ALL SELECT url FROM pages)
SELECT path, {base('path')} AS name, {dirn('path')} AS dir, {parent('path')} AS parent,
{stem('path')} AS stem, {ext('path')} AS ext,
replace(replace({base('path')}, '_', ' '), '-', ' ') AS words FROM p""")
oracle("archive_of", f"""WITH {PATHS} SELECT key, archive, '' AS outside, '_root' AS direct
FROM paths""")
oracle("label_noise", f"""WITH {PATHS},
n AS (SELECT 'p_name' AS kind, p_name AS name FROM part
  UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'c_name', c_name FROM customer
  UNION ALL SELECT 'path', {stem('path')} FROM paths)
SELECT kind, name, {noisy('name')} AS noisy FROM n""")
oracle("schema_text", "SELECT event_id, 'event type x' AS words FROM events")
oracle("parse_mapping_lines", f"""
WITH l AS (SELECT props AS line FROM events UNION ALL SELECT url FROM pages
  UNION ALL SELECT n_name FROM nation)
SELECT line, CASE WHEN regexp_matches(line, '[=:]')
    THEN lower({strip("regexp_extract(line, '^([^=:]*)[=:]', 1)")}) END AS k,
  CASE WHEN regexp_matches(line, '[=:]')
    THEN lower({strip("regexp_extract(line, '(?s)^[^=:]*[=:](.*)$', 1)")}) END AS v FROM l""")
AUTO = """
aw AS (SELECT key, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
  SELECT doc_id AS key, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{3,}') AS w
  FROM documents)),
ac AS (SELECT key, w, count(*) AS n, min(i) AS i FROM aw GROUP BY 1, 2),
auto AS (SELECT key, 'auto_' || w AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, i) AS r FROM ac) WHERE r = 1)
"""
oracle("auto_label", f"""WITH {AUTO} SELECT doc_id, a.label FROM documents
LEFT JOIN auto a ON a.key = doc_id""")
oracle("json_salvage", """SELECT event_id, CASE WHEN event_type = 'click'
THEN json_extract(props, '$.k')::INT END AS k FROM events""")
oracle("extra_json", """
SELECT event_id, CASE WHEN event_type = 'error' THEN '{broken' ELSE
  '{"detection_method":"' || event_type || '","user":' || user_id || '}' END AS extra,
  CASE WHEN event_type <> 'error' THEN event_type END AS method,
  CASE WHEN event_type <> 'error' THEN user_id END AS user FROM events""")
_BYTE = "(('0x' || substr(md5(d), {}, 2))::INT % 105 + 150)"
oracle("domain_colors", f"""
WITH n AS (SELECT r_name AS d FROM region UNION SELECT n_name FROM nation
  UNION SELECT source FROM documents)
SELECT upper(substr(d, 1, 1)) || lower(substr(d, 2)) AS display,
  'rgb(' || {_BYTE.format(1)} || ', ' || {_BYTE.format(3)} || ', ' || {_BYTE.format(5)} || ')'
  AS color FROM n""")

# --- structure --------------------------------------------------------------

INDEX = f"""
img AS (SELECT archive, lower({base('path')}) AS name, max(path) AS image_path FROM paths
  WHERE {_TYPE} = 'image' GROUP BY 1, 2)
"""
oracle("image_index", f"WITH {PATHS}, {INDEX} SELECT archive, name, image_path FROM img")
LINES = """
lines AS (SELECT doc_id, l AS line, i AS pos FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
    generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
kv AS (SELECT doc_id, pos, line, regexp_matches(line, '[=:]') AS has,
  regexp_extract(line, '^([^=:]*)[=:]', 1) AS k,
  regexp_extract(line, '(?s)^[^=:]*[=:](.*)$', 1) AS v FROM lines)
"""
oracle("mapping_labels", f"""WITH {LINES},
l AS (SELECT CASE WHEN has THEN lower({strip('v')})
  WHEN length({strip('line')}) >= 3 THEN lower({strip('line')}) END AS label FROM kv)
SELECT DISTINCT label FROM l WHERE label <> ''""")
oracle("file_mapping", f"""WITH {LINES}
SELECT lower({strip('k')}) AS file_name,
  arg_max(lower({strip('v')}), doc_id * 1000000 + pos) AS label
FROM kv WHERE has GROUP BY 1""")
oracle("folder_labels", f"""WITH {PATHS}
SELECT DISTINCT {parent('path')} AS label FROM paths
WHERE {parent('path')} NOT IN ({quoted(K.TECHNICAL_FOLDERS)}) AND NOT {noisy(parent('path'))}""")

RECORDS = f"""
rec AS (
  SELECT 'raw/' || replace(p_brand, '#', '_') || '.csv' AS file, archive, p_partkey AS row_no,
    p_brand, CASE WHEN p_size > 3 THEN upper({base('path')}) END AS picture, p_name, p_type
  FROM part JOIN paths ON key = p_partkey),
sampled AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY row_no) AS r FROM rec
  QUALIFY r <= 10),
cells AS (
  SELECT file, archive, r, 0 AS o, 'p_brand' AS c, p_brand AS v FROM sampled
  UNION ALL SELECT file, archive, r, 1, 'picture', picture FROM sampled
  UNION ALL SELECT file, archive, r, 2, 'p_name', p_name FROM sampled
  UNION ALL SELECT file, archive, r, 3, 'p_type', p_type FROM sampled),
probes AS (SELECT *, row_number() OVER (PARTITION BY file, o ORDER BY r) AS n FROM cells
  WHERE v IS NOT NULL QUALIFY n <= 5),
path_col AS (SELECT file, arg_min(c, o) AS path_key FROM probes p
  WHERE EXISTS (SELECT 1 FROM img i WHERE i.archive = p.archive AND i.name = lower(trim(p.v)))
  GROUP BY 1),
firsts AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY file ORDER BY row_no) = 1),
label_col AS (SELECT file, 'p_name' AS label_key FROM firsts LEFT JOIN path_col USING (file)
  WHERE coalesce(path_key, '') <> 'p_name' AND NOT {noisy('p_name')}),
plans AS (SELECT file, 'column' AS type, coalesce(label_key, 'unknown') AS label_key, path_key,
  path_key IS NOT NULL AS image_found FROM label_col FULL JOIN path_col USING (file)),
linked AS (SELECT r.file, r.row_no, i.image_path FROM rec r LEFT JOIN plans p USING (file)
  LEFT JOIN img i ON i.archive = r.archive AND i.name = nullif(nullif(nullif(lower(trim(
    CASE p.path_key WHEN 'picture' THEN picture WHEN 'p_brand' THEN p_brand
                    WHEN 'p_name' THEN p_name WHEN 'p_type' THEN p_type END)),
    'nan'), 'none'), ''))
"""
_REC = f"WITH {PATHS}, {INDEX}, {RECORDS}"
oracle("probe_path_column", f"{_REC} SELECT file, path_key FROM path_col")
oracle("file_plans", f"{_REC} SELECT * FROM plans")
oracle("link_record_image", f"{_REC} SELECT file, row_no, image_path FROM linked")
oracle("unlinked_images", f"""{_REC} SELECT key, path FROM paths
WHERE path NOT IN (SELECT image_path FROM linked WHERE image_path IS NOT NULL)""")
_FIRST = " UNION ALL ".join(
    f"SELECT '{t}' AS file, {o} AS o, '{c}' AS c, "
    f"(SELECT arg_min({c}, {k}) FROM {t})::VARCHAR AS v"
    for t, k, cols in (
        ("region", "r_regionkey", ["r_name"]), ("nation", "n_nationkey", ["n_name"]),
        ("customer", "c_custkey", ["c_name"]), ("supplier", "s_suppkey", ["s_name"]),
        ("part", "p_partkey", ["p_name"]))
    for o, c in enumerate(cols))
# the magic words occur only in these columns of the 14 tables and in embeddings.label
oracle("discover_label_column", f"""WITH f AS ({_FIRST} UNION ALL
SELECT 'embeddings', 0, 'label', (SELECT arg_min(label, vec_id) FROM embeddings)::VARCHAR)
SELECT file, c AS label_key, v AS first_value FROM f WHERE NOT {noisy('v')}""")
LABEL_WORDS = f"""
label_words AS (SELECT DISTINCT w AS label FROM (
  SELECT unnest(string_split({clean('text', 'a-z0-9')}, ' ')) AS w FROM benchmark)
  WHERE length(w) >= {K.LABEL_MIN_LENGTH})
"""
oracle("label_vectors", "WITH " + LABEL_WORDS + "," + embed(
    "label_words", "label", "label", "lv") + f""" SELECT label, i - 1 AS pos,
{r6('vec[i]')} AS x FROM lv CROSS JOIN range(1, 65) r(i)""")


# only the *_name columns hold a magic word; each table has one
_NAMED = """
named AS (SELECT 'raw/part' AS folder, p_partkey AS row_no, 'p_name' AS c, p_name AS v FROM part
  UNION ALL SELECT 'raw/customer', c_custkey, 'c_name', c_name FROM customer
  UNION ALL SELECT 'raw/supplier', s_suppkey, 's_name', s_name FROM supplier)
"""
oracle("schema_cache", f"""WITH {_NAMED} SELECT DISTINCT folder, c AS label_key FROM named
WHERE NOT {noisy('v')}""")

# --- labels -----------------------------------------------------------------

oracle("label_explicit", f"""WITH {PATHS},
m AS (SELECT p_name || '.jpg' AS f, arg_max(lower(p_type), p_partkey) AS label FROM part GROUP BY 1)
SELECT key, label AS explicit_label FROM paths
LEFT JOIN m ON m.f = replace(lower({base('path')}), '_', ' ')""")
oracle("label_by_plan", f"""{_REC} SELECT file, row_no,
CASE WHEN label_key = 'p_name' THEN lower(trim(p_name)) END AS label FROM rec
LEFT JOIN plans USING (file)""")
oracle("label_by_folder", f"""WITH {_NAMED},
c AS (SELECT DISTINCT folder FROM named WHERE NOT {noisy('v')})
SELECT folder, row_no, CASE WHEN c.folder IS NOT NULL THEN lower(trim(v)) END AS label
FROM named LEFT JOIN c USING (folder)""")
oracle("label_magic", f"""WITH {_NAMED} SELECT folder, row_no,
CASE WHEN NOT {noisy('v')} THEN lower(trim(v)) END AS label,
CASE WHEN {noisy('v')} THEN lower(trim(v)) END AS compat_label FROM named""")
_FOLDER_FILE = (f"CASE WHEN NOT ({noisy(parent('path'))} OR {parent('path')} IN "
                f"({quoted(K.GENERIC_FOLDERS)})) THEN {parent('path')} "
                f"WHEN NOT {noisy(stem('path'))} THEN {stem('path')} END")
oracle("label_folder_file", f"WITH {PATHS} SELECT key, {_FOLDER_FILE} AS label FROM paths")
IN_TEXT = LABEL_WORDS + """,
in_text AS (SELECT doc_id, arg_max(label, (length(label), label)) AS text_label
  FROM documents, label_words WHERE contains(lower(text), label) GROUP BY 1)
"""
oracle("label_in_text", f"""WITH {IN_TEXT} SELECT doc_id, text_label FROM documents
LEFT JOIN in_text USING (doc_id)""")
CENTROIDS = """
cm AS (SELECT 'd' || label AS domain, i, avg(embedding[i]::DOUBLE) AS x
  FROM embeddings CROSS JOIN range(1, 65) r(i) GROUP BY 1, 2),
centroids AS (SELECT domain, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM cm GROUP BY 1)
"""
SHOT = CENTROIDS + """,
shot AS (SELECT vec_id, arg_max(domain, s) AS best, max(s) AS sim FROM (
  SELECT vec_id, domain, list_cosine_similarity(embedding::DOUBLE[], v) AS s
  FROM embeddings, centroids) GROUP BY 1)
"""
oracle("label_zero_shot", f"""WITH {SHOT} SELECT vec_id AS doc_id,
CASE WHEN sim > 0.3 THEN best END AS vector_label, {r6('sim')} AS similarity FROM shot""")
ORACLES["label_zero_shot_grid"] = ORACLES["label_zero_shot"]
oracle("label_cascade", f"""WITH {PATHS}, {IN_TEXT}, {SHOT}, {AUTO},
m AS (SELECT 'img' || s_suppkey || '.jpg' AS f, lower(s_name) AS l FROM supplier),
j AS (SELECT p.key, m.l AS l1, {_FOLDER_FILE} AS l2, t.text_label AS l3,
    CASE WHEN s.sim > 0.3 THEN s.best END AS l4, a.label AS l5
  FROM paths p LEFT JOIN m ON m.f = lower({base('path')})
  LEFT JOIN in_text t ON t.doc_id = p.key LEFT JOIN shot s ON s.vec_id = p.key
  LEFT JOIN auto a ON a.key = p.key)
SELECT key, coalesce(l1, l2, l3, l4, l5, 'unknown') AS label,
  CASE WHEN l1 IS NOT NULL THEN 'explicit_mapping' WHEN l2 IS NOT NULL THEN 'folder_file'
       WHEN l3 IS NOT NULL THEN 'text' WHEN l4 IS NOT NULL THEN 'vector'
       WHEN l5 IS NOT NULL THEN 'statistic' ELSE 'none' END AS label_method FROM j""")

# --- domains ----------------------------------------------------------------

oracle("domain_centroids", f"""WITH {CENTROIDS} SELECT domain, i - 1 AS pos,
{r6('v[i] / n')} AS x FROM centroids CROSS JOIN range(1, 65) r(i)""")


def detected(force: float = 0.5) -> str:
    return CENTROIDS + f""",
sims AS (SELECT e.vec_id, domain,
    coalesce(list_cosine_similarity(c.embedding::DOUBLE[], v), 0.0) AS ctx,
    list_cosine_similarity(e.embedding::DOUBLE[], v) AS doc, c.vec_id IS NOT NULL AS has_ctx
  FROM embeddings e LEFT JOIN embeddings c ON c.vec_id = e.vec_id + 1, centroids),
fus AS (SELECT *, exp(10 * (0.6 * ctx + 0.4 * doc)) AS w FROM sims),
probs AS (SELECT vec_id, domain, ctx, has_ctx, w / sum(w) OVER (PARTITION BY vec_id) AS p FROM fus),
agg AS (SELECT vec_id, max(p) AS max_prob, arg_max(domain, p) AS best, max(ctx) AS max_ctx,
    arg_max(domain, ctx) AS best_ctx, bool_or(has_ctx) AS has_ctx FROM probs GROUP BY 1),
short AS (SELECT vec_id, domain, round(p, 4) AS prob FROM probs JOIN agg USING (vec_id)
  WHERE max_prob - p < 0.15 AND p > 0.05),
det AS (SELECT a.vec_id, max_prob,
    has_ctx AND max_ctx > {force} AS forced,
    CASE WHEN has_ctx AND max_ctx > {force} THEN best_ctx WHEN max_prob < 0.20 THEN 'unknown'
         ELSE best END AS domain,
    CASE WHEN has_ctx AND max_ctx > {force} THEN max_ctx WHEN max_prob < 0.20 THEN 0.0
         ELSE max_prob END AS score,
    CASE WHEN has_ctx AND max_ctx > {force} THEN 'structural_context_forced'
         WHEN max_prob < 0.20 THEN 'low_confidence_rejection' ELSE 'semantic_fusion' END AS method,
    (SELECT count(*) FROM short s WHERE s.vec_id = a.vec_id) AS n_short FROM agg a)
"""


oracle("domain_detect", f"""WITH {detected(0.4)}
SELECT vec_id, domain, {r6('score')} AS score, method FROM det""")
oracle("domain_softmax", f"""WITH {detected()} SELECT vec_id,
row_number() OVER (PARTITION BY vec_id ORDER BY domain) - 1 AS pos, {r6('p')} AS p FROM probs""")
oracle("domain_shortlist", f"""WITH {detected()} SELECT vec_id, domain, {r6('prob')} AS prob
FROM short""")
oracle("domain_confusion", f"""WITH {detected()} SELECT vec_id, {r6('max_prob')} AS max_prob,
n_short, NOT forced AND (max_prob < 0.25 OR n_short > 1) AS confused FROM det""")
DOC_DET = FILES + "," + detected() + """,
dd AS (SELECT f.doc_id, f.archive, d.domain, d.score, d.method
  FROM files f JOIN det d ON d.vec_id = f.doc_id)
"""
oracle("domain_precedence", f"""WITH {DOC_DET},
dec AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'unknown' ELSE 'd0' END AS a_domain,
  0.5::DOUBLE + quality / 4.0 AS a_score FROM labels),
ses AS (SELECT 'raw/src' || n_nationkey || '/fr' AS archive, lower(n_name) AS s_domain FROM nation),
j AS (SELECT dd.*, c.assigned_domain AS c_domain, c.confidence::DOUBLE AS c_score, s.s_domain,
    a.a_domain, a.a_score, dd.score < 0.8 AS asks
  FROM dd LEFT JOIN contracts c ON c.folder_path = dd.archive AND c.assigned_domain <> 'unknown'
  LEFT JOIN ses s ON s.archive = dd.archive LEFT JOIN dec a USING (doc_id))
SELECT doc_id,
  CASE WHEN c_domain IS NOT NULL THEN c_domain WHEN s_domain IS NOT NULL THEN s_domain
       WHEN asks AND a_domain IS NOT NULL THEN a_domain ELSE domain END AS domain,
  {r6('''CASE WHEN c_domain IS NOT NULL OR s_domain IS NOT NULL THEN 1.0
       WHEN asks AND a_domain IS NOT NULL THEN a_score ELSE score END''')} AS domain_score,
  {r6('''CASE WHEN c_domain IS NOT NULL THEN c_score WHEN s_domain IS NOT NULL THEN 0.7
       WHEN asks AND a_domain IS NOT NULL THEN a_score ELSE score END''')} AS actual_score,
  CASE WHEN c_domain IS NOT NULL THEN 'contract_trust' WHEN s_domain IS NOT NULL
       THEN 'session_cache' WHEN asks AND a_domain IS NOT NULL THEN 'model_arbitration'
       ELSE method END AS method,
  CASE WHEN c_domain IS NULL AND s_domain IS NULL AND asks AND a_domain IS NOT NULL
       THEN 'review' END AS justification,
  c_domain IS NULL AND s_domain IS NULL AND asks AS needs_arbitration FROM j""")
oracle("archive_domain", f"""WITH {DOC_DET} SELECT archive,
coalesce(arg_max(domain, doc_id) FILTER (domain <> 'unknown'), 'unknown') AS domain,
{r6("coalesce(arg_max(score, doc_id) FILTER (domain <> 'unknown'), 0.0)")} AS score
FROM dd GROUP BY 1""")
oracle("archive_majority", f"""WITH {DOC_DET},
n AS (SELECT archive, domain, count(*) AS n FROM dd GROUP BY 1, 2)
SELECT archive, coalesce(arg_max(domain, (n, domain)) FILTER (domain <> 'unknown'), 'unknown')
AS domain FROM n GROUP BY 1""")

# over every document: its own vector, or its embedded text where embeddings has no row
WHOLE_VECTORS = embed("documents", "doc_id", "text", "tv") + """,
vectors AS (SELECT doc_id AS vec_id, coalesce(e.embedding::DOUBLE[], tv.vec) AS embedding
  FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id LEFT JOIN tv USING (doc_id))
"""


def over_documents(sql: str) -> str:
    """A twin over detections with the documents' vectors in the place of the rows of embeddings."""
    own = detected().replace("FROM embeddings e LEFT JOIN", "FROM vectors e LEFT JOIN")
    assert own != detected() and detected() in sql
    return sql.replace(detected(), WHOLE_VECTORS + "," + own)


for _name in ("domain_precedence", "archive_domain", "archive_majority"):
    ORACLES[_name] = over_documents(ORACLES[_name])

# --- vectors ----------------------------------------------------------------

oracle("hash_embed", elements(embed("documents", "doc_id", "text", "tv"), "tv", "doc_id", "vec"))
oracle("image_embed", f"""
SELECT page_id, p AS pos, {r6('''CASE WHEN (('0x' || substr(md5(html), (p % 32 + 1)::INT, 1))::INT
  >> (p // 32 % 4)::INT) & 1 = 1 THEN 0.125 ELSE -0.125 END::DOUBLE''')} AS x
FROM pages CROSS JOIN range(64) r(p)""")
oracle("fuse_vectors", elements(f"""f AS (SELECT e.vec_id,
{fused('e.embedding::DOUBLE[]', 'n.embedding::DOUBLE[]')} AS v
FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1)""", "f", "vec_id", "v"))
oracle("l2_normalize", elements("""s AS (SELECT vec_id,
list_transform(embedding, lambda x: x::DOUBLE * label) AS v FROM embeddings),
n AS (SELECT vec_id, v AS raw, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM s),
u AS (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(raw, lambda x: x / n) ELSE raw END AS v
FROM n)""", "u", "vec_id", "v"))
oracle("vector_distances", f"""
WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, {r6('list_dot_product(a, b)')} AS dot,
  {r6('1 - list_cosine_similarity(a, b)')} AS cosine,
  {r6('list_sum(list_transform(range(1, 65), lambda i: (a[i] - b[i]) * (a[i] - b[i])))')} AS sq_l2
FROM p""")

# --- search -----------------------------------------------------------------

oracle("prepare_queries", f"""WITH {QUERIES} SELECT qid, ocr_text, f_domain, f_label,
{r6('vector[1]')} AS v_first, {r6('vector[64]')} AS v_last, {r6('visual[1]')} AS i_first
FROM queries""")
_TOP = "SELECT qid, doc_id, dist, rk FROM p"
oracle("explorer_sample", f"""WITH {CATALOG} SELECT doc_id FROM catalog WHERE vector IS NOT NULL
ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {K.EXPLORER_POINTS}""")
oracle("pca_covariance", f"""WITH {CATALOG},
s AS (SELECT vector FROM catalog WHERE vector IS NOT NULL
  ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {K.EXPLORER_POINTS})
SELECT (i - 1)::INT AS i, (j - 1)::INT AS j, {r6('covar_samp(vector[i], vector[j])')} AS cov
FROM s, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY i, j""")
oracle("topk_visual", f"WITH {CATALOG}, {QUERIES}, {top('p', 1, 'visual', 'visual', 10)} {_TOP}")
oracle("topk_fused", f"WITH {CATALOG}, {QUERIES}, {top('p', 2, 'vector', 'vector', 10)} {_TOP}")
oracle("topk_filtered",
       f"WITH {CATALOG}, {QUERIES}, {top('p', 3, 'vector', 'vector', 10, PREDICATE)} {_TOP}")
ORACLES["topk_grid"] = ORACLES["topk_fused"]
oracle("tripass_union", f"""WITH {search_ctes(5)}
SELECT qid, doc_id, pass_no, rk, dist FROM merged""")
oracle("tripass_search", f"""WITH {search_ctes(5)}
SELECT qid, rank, doc_id, pass_no, source, domain, label, dist, {r6('s_visual')} AS s_visual,
{r6('s_text')} AS s_text, s_intent, {r6('confidence_raw')} AS confidence FROM ranked""")
oracle("trust_score", f"""WITH {CATALOG}, {QUERIES},
x AS (SELECT c.doc_id, q.qid, greatest(0.0, least(1.0, 1.0 - abs(c.vector[1] * 4))) AS s_visual,
  CASE WHEN q.ocr_text <> '' THEN {ratio('q.ocr_text', "c.label || ' ' || c.snippet")}
       ELSE 0.0 END AS s_text,
  CASE WHEN c.domain = q.f_domain THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_intent,
  CASE WHEN q.ocr_text <> '' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS w_text
  FROM catalog c LEFT JOIN queries q ON q.qid = ('0x' || substr(md5(c.doc_id::VARCHAR), 1, 8))::BIGINT
    % (SELECT 2 * count(*) FROM benchmark))
SELECT doc_id, qid, {r6('s_visual')} AS s_visual, {r6('s_text')} AS s_text, s_intent,
{r6('''(s_visual * 0.6::DOUBLE + s_text * w_text + s_intent * 0.1::DOUBLE)
    / (0.7::DOUBLE + w_text) * 100''')} AS confidence FROM x""")
oracle("compose_response", f"""WITH {search_ctes(5)}
SELECT q.qid, CASE WHEN count(r.rank) = 0 THEN 'no_results' ELSE 'success' END AS status,
  any_value(q.ocr_text) AS query_ocr, count(r.rank) AS count,
  arg_min(r.source, r.rank) AS best_source,
  CASE WHEN count(r.rank) = 0 THEN NULL ELSE sum((r.s_intent > 0)::INT)::BIGINT END AS n_intent
FROM queries q LEFT JOIN ranked r USING (qid) GROUP BY q.qid""")
oracle("intent_filter", f"""WITH {CATALOG}, {QUERIES}
SELECT q.qid, count(c.doc_id) AS n FROM queries q LEFT JOIN catalog c ON {PREDICATE}
WHERE q.f_domain <> 'unknown' OR q.f_label <> 'unknown' GROUP BY 1""")
# both indexes are exact, so their twin is the plain scan
ORACLES["ivf_search"] = ORACLES["topk_visual"]
ORACLES["pq_search"] = ORACLES["topk_visual"]

# --- ingestion --------------------------------------------------------------

_PROMPTS = ", ".join(
    f"('{d}', {i}, '{t.format(d)}')" for d in K.DEFAULT_DOMAINS
    for i, t in enumerate(K.DOMAIN_PROMPTS))
_ORDER = ", ".join(f"('{d}', {i})" for i, d in enumerate(K.DEFAULT_DOMAINS))
INGEST = CATALOG + f""",
dp AS (SELECT domain || '#' || i AS pid, domain, prompt FROM (VALUES {_PROMPTS}) t(domain, i, prompt)),
{embed('dp', 'pid', 'prompt', 'dv')},
dm AS (SELECT split_part(pid, '#', 1) AS domain, i, avg(vec[i]) AS x
  FROM dv CROSS JOIN range(1, 65) r(i) GROUP BY 1, 2),
dc AS (SELECT domain, list(x ORDER BY i) AS v FROM dm GROUP BY 1),
ctx_t AS (SELECT doc_id, replace({base('path')}, '_', ' ') AS words FROM files),
{embed('ctx_t', 'doc_id', 'words', 'cv')},
isim AS (SELECT c.doc_id, dc.domain, coalesce(list_cosine_similarity(cv.vec, dc.v), 0.0) AS ctx,
    coalesce(list_cosine_similarity(c.vector, dc.v), 0.0) AS doc
  FROM catalog c CROSS JOIN dc LEFT JOIN cv USING (doc_id)),
iw AS (SELECT *, exp(10 * (0.6 * ctx + 0.4 * doc)) AS w FROM isim),
ip AS (SELECT doc_id, domain, ctx, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM iw),
ir AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(p, 9) DESC, o) AS rp,
    row_number() OVER (PARTITION BY doc_id ORDER BY round(ctx, 9) DESC, o) AS rc
  FROM ip JOIN (VALUES {_ORDER}) t(domain, o) USING (domain)),
ib AS (SELECT doc_id, max(p) AS p, max(domain) FILTER (rp = 1) AS d, max(ctx) AS c,
  max(domain) FILTER (rc = 1) AS dc FROM ir GROUP BY 1),
{IN_TEXT},
{embed('label_words', 'label', 'label', 'lv')},
near AS (SELECT doc_id, s, label AS l FROM (
  SELECT c.doc_id, lv.label, round(list_cosine_similarity(c.visual, lv.vec), 9) AS s
  FROM catalog c, lv WHERE c.visual IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, label) = 1),
{AUTO},
ingested AS (SELECT c.doc_id, c.source, c.doc_hash,
  CASE WHEN ib.c > 0.5 THEN ib.dc WHEN ib.p < 0.2 THEN 'unknown' ELSE ib.d END AS domain,
  CASE WHEN ib.c > 0.5 THEN ib.c WHEN ib.p < 0.2 THEN 0.0 ELSE ib.p END AS score,
  CASE WHEN ib.c > 0.5 THEN 'structural_context_forced' WHEN ib.p < 0.2
       THEN 'low_confidence_rejection' ELSE 'semantic_fusion' END AS method,
  coalesce(t.text_label, CASE WHEN n.s > 0.3 THEN n.l END, a.label, 'unknown') AS label,
  CASE WHEN t.text_label IS NOT NULL THEN 'text' WHEN n.s > 0.3 THEN 'vector'
       WHEN a.label IS NOT NULL THEN 'statistic' ELSE 'none' END AS label_method
  FROM catalog c JOIN ib USING (doc_id) LEFT JOIN in_text t USING (doc_id)
  LEFT JOIN near n USING (doc_id) LEFT JOIN auto a ON a.key = c.doc_id)
"""
oracle("ingest_full", f"""WITH {INGEST} SELECT source, domain, label, 'txt' AS type, doc_hash,
{r6('round(score, 4)::FLOAT::DOUBLE')} AS domain_score, method, label_method FROM ingested""")
oracle("ingest_incremental", f"""WITH {INGEST}
SELECT i.source, i.doc_hash AS file_hash, i.label,
  CASE WHEN l.doc_id IS NOT NULL THEN '1' ELSE '2' END AS batch
FROM ingested i LEFT JOIN labels l USING (doc_id)
WHERE l.doc_id IS NOT NULL OR i.doc_hash NOT IN (SELECT file_hash FROM indexed)""")
oracle("ingest_folders", f"""
SELECT 'csv' AS type, lower(p_name) AS label, '{{"p_partkey":"' || p_partkey || '","p_name":"'
  || p_name || '","p_brand":"' || p_brand || '"}}' AS content, '1' AS batch FROM part
UNION ALL SELECT 'tsv', 'unknown', '{{"s_suppkey":"' || s_suppkey || '","s_name":"' || s_name
  || '"}}', '1' FROM supplier
UNION ALL SELECT 'txt', 'nations', {clean('n_name')}, '1' FROM nation""")

# --- exploration ------------------------------------------------------------

oracle("catalog_filter", f"""WITH {FILES}
SELECT f.doc_id, f.path AS source, 'd' || e.label AS domain, f.lang AS label, l.quality, l.toxic
FROM files f JOIN embeddings e ON e.vec_id = f.doc_id JOIN labels l ON l.doc_id = f.doc_id
WHERE l.toxic = 1 OR l.quality = 0 ORDER BY f.path LIMIT 1000""")
oracle("catalog_metrics", f"""WITH {FILES}
SELECT 'total_vectors' AS metric, count(*) AS value FROM documents
UNION ALL SELECT 'folder_contracts', count(*) FROM contracts""")
oracle("domain_palette", f"""
WITH n AS (SELECT DISTINCT coalesce('d' || e.label, 'unknown') AS d
  FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id)
SELECT upper(substr(d, 1, 1)) || lower(substr(d, 2)) AS domain_display,
  'rgb(' || {_BYTE.format(1)} || ', ' || {_BYTE.format(3)} || ', ' || {_BYTE.format(5)} || ')'
  AS color FROM n""")

# --- models -----------------------------------------------------------------

_NL = "chr(10)"
oracle("build_prompts", f"""WITH {FILES} SELECT doc_id,
md5('Give this document a label of three to five words.' || {_NL} || 'TEXT: '
  || substr(text, 1, 500) || {_NL} || 'CURRENT LABEL: ' || lang || {_NL}
  || 'Reply in JSON: {{"refined_label": string, "is_document": boolean}}') AS refine,
md5('You know the domain ' || lang || '. Extract date, entities, keywords and a summary.' || {_NL}
  || 'TEXT: ' || substr(text, 1, 2000) || {_NL}
  || 'Reply in JSON: {{"date": string, "entities": [], "keywords": [], "summary": string, '
  || '"confidence": number}}') AS extract,
md5('Decide the domain of a document.' || {_NL} || 'FILE: doc_' || doc_id || '.txt' || {_NL}
  || 'TEXT: ' || substr(text, 1, 1000) || {_NL} || 'SCORES: en=0.5' || {_NL}
  || 'Reply in JSON: {{"final_domain": string, "confidence": number, "justification": string}}')
  AS arbitrate FROM files""")
oracle("arbitrate_domain", f"""WITH {detected()}
SELECT d.vec_id AS doc_id, (SELECT min(domain) FROM short s WHERE s.vec_id = d.vec_id)
  AS final_domain, 0.9::DOUBLE AS confidence, n_short || ' candidates' AS justification
FROM det d JOIN documents ON doc_id = d.vec_id
WHERE NOT forced AND (max_prob < 0.25 OR n_short > 1)""")
ORACLES["arbitrate_domain"] = over_documents(ORACLES["arbitrate_domain"])


def split_words(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> '')"


oracle("refine_label", f"""WITH {PATHS},
j AS (SELECT p.key, {_FOLDER_FILE} AS label, d.text
  FROM paths p LEFT JOIN documents d ON d.doc_id = p.key)
SELECT key, CASE WHEN label IS NOT NULL THEN label WHEN coalesce(text, '') = '' THEN 'unknown'
  ELSE coalesce(nullif(array_to_string(({split_words('substr(text, 1, 500)')})[1:3], ' '), ''),
                'unknown') END AS label FROM j""")
oracle("query_intent", f"""WITH {QUERIES} SELECT qid,
CASE WHEN length(ocr_text) < 5 THEN 'unknown' WHEN contains(lower(ocr_text), 'the') THEN 'food'
     ELSE 'cars' END AS domain,
CASE WHEN length(ocr_text) < 5 THEN 'unknown' ELSE ({split_words('ocr_text')})[1] END AS label,
'image' AS type FROM queries""")
oracle("extract_metadata", f"""SELECT doc_id, 'ok' AS status,
({split_words('substr(text, 1, 2000)')})[1] AS keyword,
least(2000, length(text))::INT AS chars FROM documents""")
oracle("column_mapping", f"""{_REC} SELECT file, 'p_name' AS label_key,
NULL::VARCHAR AS path_key, '4 columns' AS reason FROM firsts""")
oracle("extraction_plan", f"""{_REC} SELECT file, 'column' AS type,
'{{"n":"' || p_name || '"}}' AS key, NULL::VARCHAR AS pattern FROM firsts""")
oracle("rag_context", f"""WITH {search_ctes(5)}
SELECT qid, string_agg('--- DOC [' || rank || '] ---' || {_NL} || snippet || {_NL} || {_NL}, ''
  ORDER BY rank) AS context FROM ranked GROUP BY 1""")
oracle("rag_answer", f"""WITH {search_ctes(5)}
SELECT qid, count(*)::VARCHAR AS answer, true AS found FROM ranked GROUP BY 1""")

# --- streaming --------------------------------------------------------------

oracle("stream_ingest", """SELECT DISTINCT md5(text) AS file_hash, 'txt' AS type,
least(20000, length(text)) AS chars FROM documents""")
ORACLES["stream_ingest_full"] = ORACLES["ingest_full"]
oracle("stream_dedup", """SELECT DISTINCT md5(event_type || '|' || props) AS file_hash
FROM events""")
oracle("debounce_sessions", """
WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 3600000000 THEN 1 ELSE 0 END AS s
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n FROM r
GROUP BY user_id, run""")
