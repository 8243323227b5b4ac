"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from tidewater.llm.url_reputation import SECOND_LEVEL_SUFFIXES

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_STRENGTH = """
  SELECT CASE WHEN k < 2 THEN 1000.0 WHEN between_ <= 0 OR noise <= 0 THEN 1000.0
              ELSE least(1000.0, greatest(1.0, noise / between_ - 1)) END AS s
  FROM (SELECT k, noise, CASE WHEN n - n2 / n > 0 THEN (s - (k - 1) * noise) / (n - n2 / n) ELSE 0 END AS between_
        FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS n, sum(n::DOUBLE * n) AS n2, sum(n * (bad / n - up) * (bad / n - up)) AS s,
                     (sum(bad) / sum(n)) * (1 - sum(bad) / sum(n)) AS noise
              FROM {children} WHERE n > 0))
"""

OP5 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
), h AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN {SECOND_LEVEL_SUFFIXES}
              THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
         CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN {SECOND_LEVEL_SUFFIXES}
              THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix
  FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY host
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
x AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
t AS (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.5 END AS rate FROM x),
hc AS (SELECT h.n, h.bad, coalesce(d.bad / nullif(d.n, 0), t.rate) AS up FROM h LEFT JOIN d USING (domain), t),
dc AS (SELECT d.n, d.bad, coalesce(x.bad / nullif(x.n, 0), t.rate) AS up FROM d LEFT JOIN x USING (suffix), t),
xc AS (SELECT x.n, x.bad, t.rate AS up FROM x, t),
sh AS ({_STRENGTH.format(children="hc")}), sd AS ({_STRENGTH.format(children="dc")}), sx AS ({_STRENGTH.format(children="xc")}),
mx AS (SELECT suffix, (bad + sx.s * t.rate) / (n + sx.s) AS m FROM x, sx, t),
md AS (SELECT domain, (bad + sd.s * mx.m) / (n + sd.s) AS m FROM d JOIN mx USING (suffix), sd),
r AS (SELECT host, n, (bad + sh.s * md.m) / (n + sh.s) AS m, sh.s FROM h JOIN md USING (domain), sh),
f AS (
  SELECT page_id, host, path, m - 1.645 * sqrt(m * (1 - m) / (n + s + 1)) AS lower_,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p JOIN r USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN lower_ > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""

OP7 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (SELECT doc_id, pos, line, translate(trim(line, {_SPACE}), {_UPPER}) AS key FROM l),
rep AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), j AS (SELECT k.*, rep.keeper IS NOT NULL AND rep.keeper <> k.doc_id AS gone FROM k LEFT JOIN rep USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

OP10 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_ FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN first_ IS NULL OR first_ = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_ <> page_id THEN first_ END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""

_SPACES = r"\x20\x09-\x0D"

OP11 = rf"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS w FROM documents
), d AS (
  SELECT doc_id, part, min(doc_id) OVER (PARTITION BY text) < doc_id AS repeat,
         len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d
  FROM words
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, (a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * coalesce(repeat, false)::INT) AS bits,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS o
  FROM letters v JOIN letters w ON w.bit <> v.bit JOIN letters x ON x.bit NOT IN (v.bit, w.bit)
  JOIN letters y ON y.bit NOT IN (v.bit, w.bit, x.bit) JOIN letters z ON z.bit NOT IN (v.bit, w.bit, x.bit, y.bit)
), steps AS (
  SELECT filter_order, s::INT AS step, o[s] AS bit, coalesce(list_sum(o[1:s - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), r AS (
  SELECT part, filter_order, step, bit, bits, good, toxic, n, bits & bit <> 0 AS fails, bits & before <> 0 AS earlier FROM f, steps
), t AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
         coalesce(sum(n) FILTER (NOT fails AND NOT earlier), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (fails AND NOT earlier), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (fails AND earlier), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (bits = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (fails AND NOT earlier AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (fails AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM t
"""

OP13 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+') AS w FROM documents
), n AS (
  SELECT doc_id, text, w, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
), f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n
), c AS (
  SELECT *, CASE WHEN a = 0 THEN '' ELSE array_to_string(w[1:a], '') END AS p, CASE WHEN b <= a THEN '' ELSE array_to_string(w[a + 1:b], '') END AS m,
         CASE WHEN b >= n THEN '' ELSE array_to_string(w[b + 1:n], '') END AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""

SQL: dict[str, str] = {
    "op3_pivot_topk": OP3,
    "op5_url_reputation": OP5,
    "op7_line_dedup": OP7,
    "op10_warc": OP10,
    "op11_filter_audit": OP11,
    "op13_fill_middle": OP13,
}
