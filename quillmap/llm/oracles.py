"""DuckDB twins of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from quillmap.llm.queries import URL_GLOBS, URL_RULES

WORDS = r"'[^\x20\x09-\x0D]+'"

_OP6 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORDS})) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM base WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + s) AS c FROM twice, (VALUES (0), (1), (2)) AS shifts(s) GROUP BY doc_id
), words AS (
  SELECT doc_id, max(c) AS top FROM (
    SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(w) AS x FROM base) GROUP BY doc_id, x) GROUP BY doc_id
), facts AS (
  SELECT b.doc_id, len(w) AS n_words,
         CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.c, 0) AS n_repeat_words,
         coalesce(words.top, 0) AS top,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS no_letter,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS big, length(regexp_replace(t, '[^a-z]', '', 'g')) AS small
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN words USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(chars, 0) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (10 * n_symbols > n_words)
         AND coalesce(chars, 0) BETWEEN 2 * n_words AND 20 * n_words AND NOT (2 * n_dup_lines > n_lines)
         AND NOT (10 * big > 3 * (big + small)) AND NOT (5 * top > n_words) AND NOT (5 * no_letter > n_words) AS kept
FROM facts
"""

def _op10() -> str:
    rules = sorted(((r.host, r.path, r.verdict) for r in URL_RULES), key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, rules, strict=True))
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, rules, strict=True))
    globs = sorted(URL_GLOBS, key=lambda g: (-len(g.text), g.text))
    exp = lambda x: "(?s)" + x.replace(".", r"\.").replace("*", ".*")
    glob = " ".join(f"WHEN regexp_full_match(host, '{exp(g.host)}') AND regexp_full_match(path || query, '{exp(g.path)}') THEN '{g.text}'" for g in globs)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1) AS query FROM r),
j AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said, CASE {glob} END AS pat FROM p)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN pat IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN rule IS NULL THEN pat END AS pattern FROM j
"""


_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_OP9 = """
WITH t AS (
  SELECT *, coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-') AS item,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, position, md5(string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY position)) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns FROM p WHERE position = n_turns GROUP BY prefix
), kept AS (
  SELECT conv_id, n_turns FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < n_turns)
)
SELECT conv_id, turn, position, CAST(n_turns AS BIGINT) AS n_turns, role,
       '<|im_start|>' || coalesce(role, '') || chr(10)
         || replace(replace(coalesce(text, ''), '<|im_start|>', '<' || chr(8203) || '|im_start|>'), '<|im_end|>', '<' || chr(8203) || '|im_end|>')
         || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN kept USING (conv_id)
"""

_GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _op11(rounds: int = 4) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, label, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT x.vec_id, x.label, x.p, c.e, CAST(list_sum(list_transform(range(1, 1 + len(x.x)), lambda i: (x.x[i] - c.x[i]) * (x.x[i] - c.x[i]))) AS BIGINT) AS d
    FROM x JOIN c{i} c USING (p)) GROUP BY vec_id, label, p)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT p, e, list(m ORDER BY i) AS x FROM (
    SELECT a.p, a.best.e AS e, i, CAST(floor(sum(x.x[i]) / count(*)) AS BIGINT) AS m
    FROM a{i} a JOIN x USING (vec_id, p), range(1, 1 + (SELECT any_value(len(x)) FROM x)) AS t(i) GROUP BY a.p, a.best.e, i) GROUP BY p, e),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (p, e))""")
    middle = ",\n".join(steps)
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_GOOD}
), x AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM v, range(0, 4) AS t(p)
), c0 AS MATERIALIZED (
  SELECT p, e, x FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM x) WHERE e < 256
), {middle},
done AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label
), told AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS s FROM c{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM done, told
"""


_OP12 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM d
"""

_OP13 = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_GOOD}
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, s.vec_id, s.score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
) WHERE rank <= 3
"""

ORACLES = {"op5_exact_topk": _OP5, "op6_quality_rules": _OP6, "op9_chat_format": _OP9, "op10_url_filter": _op10(), "op11_vector_codes": _op11(), "op12_warc": _OP12, "op13_hard_negatives": _OP13}
