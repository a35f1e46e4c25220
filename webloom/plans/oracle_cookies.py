"""DuckDB oracle SQL for the cookie queries: the same replay written as
window SQL (LAG/LEAD per cookie, running segment sums, a correlated
"last read before" subquery) and a plain range join for requests."""

_HOSTS = """h AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
                 regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)"""

_VERS = """ev AS (SELECT event_id, ts, user_id % 10 AS jar_id, event_type,
                 'u' || CAST(event_id % 5 AS VARCHAR) || '.example.com' AS host FROM events),
  sets AS (
    SELECT jar_id, event_id, ts,
      CASE event_type WHEN 'click' THEN 'c' WHEN 'signup' THEN 's' WHEN 'purchase' THEN 'p' ELSE 'c' END AS name,
      CASE WHEN event_type = 'error' THEN '' ELSE CAST(event_id AS VARCHAR) END AS value,
      CASE WHEN event_type = 'signup' THEN 'example.com' ELSE host END AS domain,
      event_type <> 'signup' AS host_only,
      CASE WHEN event_type = 'purchase' THEN '/shop' ELSE '/' END AS path,
      event_type = 'purchase' AS secure,
      event_type = 'error' AS remove,
      CASE WHEN event_type = 'signup' THEN ts + INTERVAL 86400 SECOND
           WHEN event_type = 'purchase' THEN ts + to_seconds(CAST((event_id % 48 + 1) * 3600 AS BIGINT))
           ELSE TIMESTAMP '9999-12-31 23:59:59' END AS expires,
      event_type IN ('signup', 'purchase') AS persistent
    FROM ev WHERE event_type IN ('click', 'signup', 'purchase', 'error')),
  k AS (SELECT *, domain || ';' || path || ';' || name AS cookie_id FROM sets),
  reads AS (SELECT jar_id, ts, event_id, host, starts_with(CASE WHEN event_id % 2 = 1 THEN 'http' ELSE 'https' END, 'https') AS https,
                   '/shop/' || CAST(event_id AS VARCHAR) AS req_path FROM ev WHERE event_type = 'view'),
  w AS (SELECT k.*, lag(remove) OVER wi AS p_remove, lag(ts) OVER wi AS p_ts, lag(expires) OVER wi AS p_exp,
               lag(persistent) OVER wi AS p_pers, lead(ts) OVER wi AS n_ts
        FROM k WINDOW wi AS (PARTITION BY jar_id, cookie_id ORDER BY ts, event_id)),
  lr AS (SELECT w.*, (SELECT max(r.ts) FROM reads r WHERE r.jar_id = w.jar_id AND r.ts < w.ts) AS last_read FROM w),
  sg AS (SELECT lr.*, sum(CASE WHEN p_remove IS NULL OR p_remove
                                 OR (p_pers AND last_read > p_ts AND last_read >= p_exp) THEN 1 ELSE 0 END)
                        OVER (PARTITION BY jar_id, cookie_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg
         FROM lr),
  v AS (SELECT *, min(ts) OVER (PARTITION BY jar_id, cookie_id, seg) AS creation,
               arg_min(event_id, ts) OVER (PARTITION BY jar_id, cookie_id, seg) AS seq_eid
        FROM sg WHERE NOT remove)"""

_SENT = """s AS (SELECT r.jar_id, r.event_id AS req_id, r.ts AS req_ts, v.* EXCLUDE (jar_id, ts, event_id)
        FROM reads r JOIN v ON v.jar_id = r.jar_id AND v.ts < r.ts AND (v.n_ts IS NULL OR r.ts < v.n_ts)
        WHERE (NOT v.persistent OR v.expires > r.ts)
          AND (v.domain = r.host OR (NOT v.host_only AND ends_with(r.host, '.' || v.domain)))
          AND (r.req_path = v.path OR (starts_with(r.req_path, v.path)
               AND (ends_with(v.path, '/') OR substr(r.req_path, length(v.path) + 1, 1) = '/')))
          AND (r.https OR NOT v.secure))"""

ORACLE = {
    "canonical_hosts": f"""WITH {_HOSTS} SELECT page_id, host,
        regexp_replace(regexp_replace(lower(host), ':[0-9]*$', ''), '[.]$', '') AS canonical_host,
        regexp_matches(host, '^[0-9.]+$') AS is_ip FROM h""",
    "registrable_domain": f"""WITH {_HOSTS} SELECT page_id,
        regexp_extract(regexp_replace(lower(host), ':[0-9]*$', ''), '([^.]*[.][^.]*)$', 1) AS jar_key,
        CASE WHEN ends_with(host, '.example.net') THEN regexp_extract(host, '([^.]+[.]example[.]net)$', 1)
             ELSE regexp_extract(host, '([^.]*[.][^.]*)$', 1) END AS site FROM h""",
    "default_path": f"""WITH {_HOSTS} SELECT page_id,
        CASE WHEN path = '' OR NOT starts_with(path, '/') OR regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/'
             ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS default_path FROM h""",
    "cookie_versions": f"""WITH {_VERS}
      SELECT jar_id, cookie_id, ts AS valid_from, n_ts AS valid_to, value, creation, expires, persistent FROM v""",
    "cookies_for_requests": f"""WITH {_VERS}, {_SENT},
      agg AS (SELECT jar_id, req_id, string_agg(name || '=' || value, ' '
                ORDER BY length(path) DESC, creation, seq_eid) AS cookies FROM s GROUP BY 1, 2)
      SELECT r.jar_id, r.event_id AS req_id, coalesce(agg.cookies, '') AS cookies
      FROM reads r LEFT JOIN agg ON agg.jar_id = r.jar_id AND agg.req_id = r.event_id""",
    "cookie_last_access": f"""WITH {_VERS}, {_SENT},
      ls AS (SELECT jar_id, cookie_id, ts AS last_set FROM v WHERE n_ts IS NULL AND NOT (persistent AND EXISTS (
               SELECT 1 FROM reads r WHERE r.jar_id = v.jar_id AND r.ts > v.ts AND r.ts >= v.expires))),
      lq AS (SELECT jar_id, cookie_id, max(req_ts) AS last_sent FROM s GROUP BY 1, 2)
      SELECT ls.jar_id, ls.cookie_id, greatest(last_set, coalesce(last_sent, last_set)) AS last_access
      FROM ls LEFT JOIN lq USING (jar_id, cookie_id)""",
    "cookie_table_scan": f"""WITH {_VERS}
      SELECT name, value, path, CASE WHEN host_only THEN domain ELSE '.' || domain END AS host_key,
             epoch_us(ts) + 11644473600000000 AS creation_utc,
             CASE WHEN persistent THEN make_timestamp(epoch_us(expires) // 1000000 * 1000000)
                  ELSE make_timestamp(0) END AS expires,
             secure AS is_secure
      FROM k WHERE NOT remove AND (CASE WHEN host_only THEN domain ELSE '.' || domain END) ILIKE '%u1.example.com'""",
}

ORACLE["cookie_resume"] = ORACLE["cookie_versions"]
ORACLE["stream_cookie_versions"] = ORACLE["cookie_versions"]
