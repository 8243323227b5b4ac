"""Oracle SQL for the registered scenarios, written for DuckDB over the same tables.

The request derivation mirrors ``tidewater.sources.testdata`` in plain SQL; the
gate rules are restated with DuckDB's JSON functions so an independent engine
checks every verdict.
"""

from __future__ import annotations

from tidewater.scenarios import COMMITS, MIX_UNIONS, MIX_VALUES, NODES, RENAMES, SETTINGS

MAX_LEN = SETTINGS.max_content_length
# Fixed value: the CRC-64-AVRO fingerprint of the demo event schema.
EVENT_FP = "3ac5718106bde79d"

REQUESTS = f"""
requests AS (
  SELECT 'req-' || event_id AS request_id,
         CASE WHEN event_id % 3 = 0 THEN 'corr-' || event_id END AS x_correlation_id,
         ts AS received_at,
         CASE WHEN event_id % 29 = 11 THEN 'v2' ELSE 'v1' END AS api_version,
         event_type AS producer,
         CASE event_id % 13 WHEN 1 THEN 'text/plain' WHEN 2 THEN NULL
              WHEN 3 THEN 'Application/JSON; charset=utf-8' ELSE 'application/json' END AS content_type,
         body_text AS body,
         CASE event_id % 19 WHEN 9 THEN NULL WHEN 10 THEN {MAX_LEN} + event_id WHEN 11 THEN 0
              ELSE coalesce(strlen(body_text), 16) END AS content_length,
         CASE WHEN event_id % 5 = 0
              THEN ' 10.0.' || (event_id % 256) || '.' || (user_id % 256) || ' , 172.16.0.1' END AS x_forwarded_for,
         CASE WHEN event_id % 7 = 1 THEN '192.168.' || (user_id % 256) || '.1' END AS x_real_ip,
         CASE WHEN event_id % 11 <> 3 THEN '203.0.113.' || (event_id % 256) END AS remote_addr,
         (event_id * 37 + user_id * 11) % 450 + 5 AS duration_ms,
         'POST' AS method,
         '/api/' || (CASE WHEN event_id % 29 = 11 THEN 'v2' ELSE 'v1' END) || '/' || event_type || '/data' AS path,
         event_id, user_id, props
  FROM (
    SELECT *,
      CASE event_id % 17
        WHEN 4 THEN ''
        WHEN 5 THEN '{{"id":"evt-' || event_id || '","seq":' || user_id
        WHEN 6 THEN '{{"id":"evt-' || event_id || '","seq":"' || user_id || '","payload":' || props || '}}'
        WHEN 7 THEN '{{"id":"evt-' || event_id || '","seq":' || user_id || '}}'
        WHEN 8 THEN NULL
        ELSE '{{"id":"evt-' || event_id || '","seq":' || user_id || ',"payload":' || props || '}}'
      END AS body_text
    FROM events)
)"""

ROUTES = """
routes(producer, schema_subject, schema_version, schema_fingerprint, validates, pointer, renames) AS (
  VALUES ('click', 'click-raw', 1, NULL, false, NULL, false),
         ('view', 'view-event', 2, '{fp}', true, NULL, false),
         ('purchase', 'purchase-raw', 1, NULL, false, '/payload/k', false),
         ('signup', 'signup-event', 3, '{fp}', true, NULL, true),
         ('error', 'error-raw', 1, NULL, false, NULL, false)
)""".format(fp=EVENT_FP)

# The demo Event schema restated as DuckDB JSON checks.
EVENT_CONFORMS = """(CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT'
   AND coalesce(json_type(body, '$.id') = 'VARCHAR', false)
   AND coalesce(json_type(body, '$.seq') IN ('BIGINT', 'UBIGINT'), false)
   AND coalesce(json_type(body, '$.payload') = 'OBJECT', false)
   AND coalesce(json_type(body, '$.payload.k') IN ('BIGINT', 'UBIGINT'), false)
   AND coalesce(TRY_CAST(json_extract(body, '$.payload.k') AS HUGEINT) BETWEEN -2147483648 AND 2147483647, false)
   ELSE false END)"""

# Root "id" renamed to "push_event_id" on routes with a target table and no pointer; the rest of the text as it was sent.
RENAMED = """(CASE WHEN renames AND json_valid(body) THEN
     CASE WHEN json_type(body) = 'OBJECT' AND json_exists(body, '$.id') AND NOT json_exists(body, '$.push_event_id')
          THEN regexp_replace(body, '^\\{"id":', '{"push_event_id":') ELSE body END
   ELSE body END)"""

STATUS = """CASE error_code WHEN 'unrouted' THEN 404 WHEN 'content_type' THEN 415 WHEN 'length_required' THEN 411
    WHEN 'too_large' THEN 413 WHEN 'no_content' THEN 400 WHEN 'serialization' THEN 400
    WHEN 'schema_validation' THEN 400 WHEN 'invalid_json_path' THEN 400 END"""

GATED = f"""
gated AS (
  SELECT q.*, r.schema_subject, r.schema_version, r.schema_fingerprint, r.pointer, r.renames,
    CASE
      WHEN r.producer IS NULL OR q.api_version <> 'v1' THEN 'unrouted'
      WHEN coalesce(lower(trim(split_part(q.content_type, ';', 1))) = 'application/json', false) = false
        THEN 'content_type'
      WHEN q.content_length IS NULL THEN 'length_required'
      WHEN q.content_length > {MAX_LEN} THEN 'too_large'
      WHEN q.content_length <= 0 THEN 'no_content'
      WHEN q.body IS NULL THEN 'serialization'
      WHEN q.body = '' THEN 'no_content'
      WHEN r.validates AND NOT coalesce({EVENT_CONFORMS.replace('body', 'q.body')}, false) THEN 'schema_validation'
      WHEN r.pointer IS NOT NULL AND NOT (CASE WHEN json_valid(q.body)
           THEN json_extract(q.body, r.pointer) IS NOT NULL ELSE false END) THEN 'invalid_json_path'
    END AS error_code
  FROM requests q LEFT JOIN routes r ON q.producer = r.producer AND q.api_version = 'v1'
),
landed AS (
  SELECT *, {RENAMED} AS payload
  FROM gated WHERE error_code IS NULL
),
outcomes AS (
  SELECT *, CAST(coalesce({STATUS}, 202) AS INTEGER) AS status FROM gated
)"""

MESSAGE = f"""CASE error_code
    WHEN 'unrouted' THEN ''
    WHEN 'content_type' THEN 'Only application/json is accepted'
    WHEN 'length_required' THEN 'Content-Length header is required'
    WHEN 'too_large' THEN 'Payload too large: ' || content_length || ' bytes (max {MAX_LEN})'
    WHEN 'no_content' THEN 'Request body is required'
    WHEN 'serialization' THEN 'Invalid payload: request body could not be read'
    WHEN 'schema_validation' THEN 'Schema validation failed: body does not conform to schema '
         || schema_subject || ' v' || schema_version
    WHEN 'invalid_json_path' THEN 'application error: invalid json path for payload: ''' || pointer || ''''
  END"""

WITH = f"WITH {REQUESTS},\n{ROUTES},\n{GATED}\n"

ID = """(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
               || '-' || substr(h, 21, 12) FROM (SELECT sha256(producer || '|' || request_id) AS h))"""

UTC_TEXT = "strftime(received_at, '%Y-%m-%dT%H:%M:%S.%fZ')"

ROUTE_EVENTS = """
ev AS (
  SELECT o_orderkey AS seq,
         CASE WHEN o_orderkey % 997 = 0 THEN 'Reseted' WHEN o_orderkey % 11 = 3 THEN 'Deleted'
              WHEN o_orderkey % 2 = 0 THEN 'Modified' ELSE 'Added' END AS event_type,
         'route-' || o_custkey AS name,
         'p-' || o_custkey AS producer, o_orderpriority AS schema_subject,
         CAST(year(o_orderdate) - 1990 AS INTEGER) AS schema_version, o_orderstatus AS status,
         (o_orderkey % 997 <> 0 AND o_orderkey % 11 = 3) OR o_orderkey % 13 = 5 AS spec_null
  FROM orders
),
eff AS (
  SELECT * FROM ev
  WHERE (event_type IN ('Added', 'Modified') AND NOT spec_null) OR event_type IN ('Deleted', 'Reseted')
),
named AS (SELECT * FROM eff WHERE event_type <> 'Reseted'),
resets AS (SELECT seq FROM ev WHERE event_type = 'Reseted'),
ivs AS (
  SELECT name, valid_from, valid_to, event_type, producer, schema_subject, schema_version, status FROM (
    SELECT n.*, n.seq AS valid_from,
           least(lead(n.seq) OVER (PARTITION BY n.name ORDER BY n.seq),
                 (SELECT min(r.seq) FROM resets r WHERE r.seq > n.seq)) AS valid_to
    FROM named n)
  WHERE event_type IN ('Added', 'Modified')
),
snap AS (
  SELECT name, seq, producer, schema_subject, schema_version, status FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS rn FROM eff
    WHERE event_type <> 'Reseted' AND seq > coalesce((SELECT max(seq) FROM resets), -1))
  WHERE rn = 1 AND event_type <> 'Deleted'
),
chg AS (
  SELECT seq, name,
    CASE WHEN event_type IN ('Added', 'Modified')
         THEN NOT live_before OR producer <> prev_producer OR schema_subject <> prev_subject
              OR schema_version <> prev_version OR status <> prev_status
         ELSE live_before END AS changed
  FROM (
    SELECT *, coalesce(prev_seq IS NOT NULL AND prev_type IN ('Added', 'Modified')
                       AND (reset_before IS NULL OR prev_seq > reset_before), false) AS live_before
    FROM (
      SELECT n.*,
        lag(n.seq) OVER w AS prev_seq, lag(n.event_type) OVER w AS prev_type,
        lag(n.producer) OVER w AS prev_producer, lag(n.schema_subject) OVER w AS prev_subject,
        lag(n.schema_version) OVER w AS prev_version, lag(n.status) OVER w AS prev_status,
        (SELECT max(r.seq) FROM resets r WHERE r.seq < n.seq) AS reset_before
      FROM named n WINDOW w AS (PARTITION BY n.name ORDER BY n.seq)))
)"""

SQL = {
    "gate_outcomes": WITH + f"""
SELECT request_id, producer,
       CAST(coalesce({STATUS}, 202) AS INTEGER) AS status, error_code,
       CASE WHEN error_code IS NULL THEN
         'accepted for ' || producer || ': ' || strlen({RENAMED}) || ' bytes'
       ELSE {MESSAGE} END AS message
FROM gated""",
    "landing_rows": WITH + """
SELECT producer,
       strftime(received_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestampUTC,
       (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
               || '-' || substr(h, 21, 12) FROM (SELECT sha256(producer || '|' || request_id) AS h)) AS id,
       payload,
       CAST(epoch_us(received_at) // 1000 AS BIGINT) AS createdAt,
       schema_subject AS schemaSubject, CAST(schema_version AS INTEGER) AS schemaVersion,
       schema_fingerprint AS schemaFingerprint,
       CAST(strlen(payload) AS BIGINT) AS payload_bytes
FROM landed""",
    "unrouted": f"""WITH {REQUESTS}
SELECT request_id, api_version, producer FROM requests
WHERE NOT (api_version = 'v1' AND producer IN ('click', 'view', 'purchase'))""",
    "requests_total": WITH + """
SELECT producer, CASE WHEN status < 300 THEN 'ok' ELSE 'error' END AS outcome, count(*) AS requests
FROM outcomes WHERE error_code IS NULL OR error_code <> 'unrouted' GROUP BY 1, 2""",
    "bytes_total": WITH + """
SELECT producer, CAST(sum(strlen(payload)) AS BIGINT) AS bytes FROM landed GROUP BY producer""",
    "accept_rate": WITH + """
SELECT strftime(date_trunc('day', received_at), '%Y-%m-%d') AS day, producer,
       count(*) FILTER (WHERE status = 202) AS accepted, count(*) FILTER (WHERE status <> 202) AS rejected,
       round(avg(CASE WHEN status = 202 THEN 1 ELSE 0 END), 6) AS accept_rate
FROM outcomes GROUP BY 1, 2""",
    "slo_check": WITH + """
SELECT *, p95_ms < 200 AS p95_ok, p99_ms < 500 AS p99_ok, failed_rate < 0.01 AS failed_ok,
       accepted_rate > 0.99 AS accepted_ok
FROM (SELECT count(*) AS requests,
             quantile_cont(duration_ms, 0.95) AS p95_ms, quantile_cont(duration_ms, 0.99) AS p99_ms,
             round(avg(CASE WHEN status >= 400 THEN 1 ELSE 0 END), 6) AS failed_rate,
             round(avg(CASE WHEN status = 202 THEN 1 ELSE 0 END), 6) AS accepted_rate
      FROM outcomes)""",
    "client_address": WITH + """
SELECT request_id, coalesce(x_correlation_id, request_id) AS correlation_id,
       coalesce(trim(split_part(x_forwarded_for, ',', 1)), x_real_ip, remote_addr, 'unknown') AS client_ip,
       method, path, producer, status
FROM outcomes""",
    "producers": WITH + "SELECT DISTINCT producer FROM landed",
    "keyed_lww": WITH + f"""
SELECT producer, key_hour, id, timestampUTC FROM (
  SELECT producer, strftime(date_trunc('hour', received_at), '%Y-%m-%dT%H') AS key_hour, {ID} AS id,
         {UTC_TEXT} AS timestampUTC,
         row_number() OVER (PARTITION BY producer, date_trunc('hour', received_at)
                            ORDER BY received_at DESC, {ID} DESC) AS rn
  FROM landed)
WHERE rn = 1""",
    "last_n": """
SELECT conv_id, turn, role, CAST(rank AS INTEGER) AS rank FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank
  FROM conversations)
WHERE rank <= 3""",
    "pointer_extract": """
SELECT event_id, CAST(json_extract(doc, '/p/k') AS VARCHAR) AS k,
       CAST(json_extract(doc, '/m/a~1b/t~01/1') AS VARCHAR) AS escaped,
       CAST(json_extract(doc, '/m/a~1b/t~01/2') AS VARCHAR) AS missing
FROM (SELECT event_id, '{"m":{"a/b":{"t~1":[' || user_id || ',' || event_id || ']}},"p":' || props || '}' AS doc
      FROM events)""",
    "oversize_docs": """
SELECT 'doc-' || doc_id AS request_id, 'docs-' || substr(md5(coalesce(source, '')), 1, 1) AS producer,
       CAST(CASE WHEN text IS NULL THEN 411 WHEN strlen(text) > 16384 THEN 413 WHEN strlen(text) <= 0 THEN 400
                 ELSE 202 END AS INTEGER) AS status,
       CAST(strlen(text) AS BIGINT) AS content_length,
       CAST(CASE WHEN strlen(text) BETWEEN 1 AND 16384 THEN strlen(text) END AS BIGINT) AS payload_bytes
FROM documents""",
    "incremental_pull": WITH + f"""
SELECT 'evt-' || event_id AS push_event_id, user_id AS seq, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       {UTC_TEXT} AS timestampUTC, {ID} AS merge_key
FROM landed WHERE producer = 'signup' AND received_at > TIMESTAMP '2024-01-15 00:00:00'""",
    "payload_explode": """
SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
       CASE WHEN l_linenumber % 2 = 0 THEN 'line ' || l_linenumber END AS l_comment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "merge_target": """
SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""",
    "embedding_variant": """
SELECT vec_id AS push_event_id, CAST(len(embedding) AS INTEGER) AS n_elems, label FROM embeddings""",
    "route_snapshot": f"WITH {ROUTE_EVENTS}\nSELECT * FROM snap",
    "route_intervals": f"WITH {ROUTE_EVENTS}\nSELECT * FROM ivs",
    "route_changes": f"""WITH {ROUTE_EVENTS}
SELECT c.seq, e.event_type, c.name, c.changed FROM chg c JOIN eff e ON c.seq = e.seq
UNION ALL
SELECT seq, 'Reseted' AS event_type, NULL AS name, seq IN (SELECT valid_to FROM ivs WHERE valid_to IS NOT NULL) AS changed FROM resets""",
    "route_reloads": f"""WITH {ROUTE_EVENTS}
SELECT CAST(1 + (SELECT count(*) FROM chg WHERE changed)
            + (SELECT count(*) FROM resets WHERE seq IN (SELECT valid_to FROM ivs)) AS BIGINT) AS reloads,
       (SELECT count(*) FROM snap) AS active_routes""",
    "route_asof": f"""WITH {ROUTE_EVENTS},
reqs AS (
  SELECT l_orderkey || '-' || l_linenumber AS request_id, 'p-' || o_custkey AS producer, l_orderkey AS at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT r.request_id, r.producer,
       coalesce(i.valid_from IS NOT NULL AND (i.valid_to IS NULL OR r.at < i.valid_to), false) AS routed,
       CASE WHEN i.valid_from IS NOT NULL AND (i.valid_to IS NULL OR r.at < i.valid_to)
            THEN i.schema_subject END AS schema_subject
FROM reqs r ASOF LEFT JOIN ivs i ON r.producer = i.producer AND r.at >= i.valid_from""",
    "reject_rows": WITH + f"""
SELECT request_id, {UTC_TEXT} AS received_at, producer, status, error_code, {MESSAGE} AS message
FROM outcomes WHERE error_code IS NOT NULL""",
    "route_first_seen": f"""WITH {ROUTE_EVENTS}
SELECT producer, seq, name, schema_subject, schema_version FROM (
  SELECT *, row_number() OVER (PARTITION BY producer ORDER BY seq) AS rn
  FROM eff WHERE event_type IN ('Added', 'Modified'))
WHERE rn = 1""",
    "page_roundtrip": """
SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS html_bytes, sha256(html) AS html_sha256 FROM pages""",
    "metric_windows": WITH + f"""
SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%dT%H:%M:%S') AS window_start, producer,
       count(*) FILTER (WHERE status = 202) AS requests_ok,
       count(*) FILTER (WHERE status <> 202 AND error_code <> 'unrouted') AS requests_error,
       CAST(coalesce(sum(CASE WHEN error_code IS NULL THEN strlen({RENAMED}) ELSE 0 END), 0) AS BIGINT) AS bytes,
       count(*) FILTER (WHERE status = 202) AS accepted,
       count(*) FILTER (WHERE status <> 202) AS rejected
FROM outcomes GROUP BY 1, 2""",
    "array_merge": """
SELECT l_orderkey, l_linenumber, l_partkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestampUTC
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "declared_envelope": """
SELECT event_id AS key, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp,
       substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
         AS merge_key
FROM (SELECT *, sha256('stamped|st-' || event_id) AS h FROM events)""",
    "conformity_mix": """
SELECT 'mx-' || event_id AS request_id, CAST(CASE WHEN ok THEN 202 ELSE 400 END AS INTEGER) AS status,
       CASE WHEN NOT ok THEN 'schema_validation' END AS error_code
FROM (SELECT event_id, [@VALUES@][event_id % @NV@ + 1] AND [@UNIONS@][(event_id // @NV@) % @NU@ + 1] AS ok FROM events)"""
    .replace("@VALUES@", ", ".join(str(ok).lower() for _, ok in MIX_VALUES)).replace("@NV@", str(len(MIX_VALUES)))
    .replace("@UNIONS@", ", ".join(str(ok).lower() for _, ok in MIX_UNIONS)).replace("@NU@", str(len(MIX_UNIONS))),
    "drained_rows": WITH + f"""
SELECT CAST(epoch_us(received_at) // 1000000 % {COMMITS} AS INTEGER) AS drain, {ID} AS id, {UTC_TEXT} AS timestampUTC
FROM landed WHERE producer = 'click'""",
    "pulled_commits": WITH + f"""
SELECT {ID} AS id, {UTC_TEXT} AS timestampUTC, payload
FROM landed WHERE producer = 'signup' AND epoch_us(received_at) // 1000000 % {COMMITS} > 0""",
    "window_slo": WITH + """
SELECT strftime(hour, '%Y-%m-%dT%H') AS hour, producer, count(*) AS requests,
       CAST(min(duration_ms) FILTER (WHERE rn >= 0.95 * n) AS BIGINT) AS p95_ms,
       CAST(min(duration_ms) FILTER (WHERE rn >= 0.99 * n) AS BIGINT) AS p99_ms
FROM (SELECT *, row_number() OVER (PARTITION BY hour, producer ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY hour, producer) AS n
      FROM (SELECT *, date_trunc('hour', received_at) AS hour FROM outcomes))
GROUP BY hour, producer""",
    "conformity_chains": """
SELECT 'chain-' || event_id AS request_id, CAST(CASE WHEN ok THEN 202 ELSE 400 END AS INTEGER) AS status,
       CASE WHEN NOT ok THEN 'schema_validation' END AS error_code
FROM (SELECT event_id, [@OK@][event_id % @N@ + 1] AS ok FROM events)"""
    .replace("@OK@", ", ".join(str(ok).lower() for _, ok in NODES)).replace("@N@", str(len(NODES))),
    "renamed_bodies": """
SELECT 'renamed-' || event_id AS request_id, 202 AS status, payload, CAST(strlen(payload) AS BIGINT) AS payload_bytes
FROM (SELECT event_id, replace([@TEXTS@][event_id % @N@ + 1], '#', CAST(user_id AS VARCHAR)) AS payload FROM events)"""
    .replace("@TEXTS@", ", ".join("'" + t.replace("'", "''") + "'" for _, t in RENAMES)).replace("@N@", str(len(RENAMES))),
}
SQL["landing_table"] = WITH + f"""
SELECT producer, CAST(epoch_us(received_at) // 1000000 % 2 AS BIGINT) AS batch_id, {ID} AS id, {UTC_TEXT} AS timestampUTC,
       schema_subject AS schemaSubject, CAST(schema_version AS INTEGER) AS schemaVersion
FROM landed"""
SQL["consumed_target"] = WITH + f"""
SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, {UTC_TEXT} AS timestampUTC, {ID} AS merge_key
FROM landed WHERE producer = 'signup'"""
SQL["streamed_landing"] = WITH + f"""
SELECT producer, {ID} AS id, CAST(NULL AS VARCHAR) AS error_code FROM landed
UNION ALL
SELECT producer, request_id AS id, error_code FROM outcomes WHERE error_code IS NOT NULL"""
SQL["tagged_totals"] = f"SELECT *, 'ingest' AS service, 'demo' AS env FROM ({SQL['requests_total']})"
SQL["name_collisions"] = """
WITH c AS (
  SELECT DISTINCT 'r' || (event_id % 50) AS route_name,
         CASE event_id % 3 WHEN 0 THEN 'Col' WHEN 1 THEN 'COL' ELSE 'other' END || (user_id % 40) AS column_name FROM events)
SELECT route_name, lower(column_name) AS lower_name, count(*) AS n, string_agg(column_name, ',' ORDER BY column_name) AS names
FROM c GROUP BY 1, 2 HAVING count(*) > 1"""
SQL["streamed_windows"] = SQL["metric_windows"]
SQL["bucket_merge"] = SQL["merge_target"]
SQL["route_folds"] = SQL["route_changes"]
