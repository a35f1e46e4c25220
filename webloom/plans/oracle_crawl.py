"""DuckDB oracle SQL for the crawl and cache queries (WITH RECURSIVE for the
crawl, ROW_NUMBER for keep-latest, semi/anti joins for lookups)."""

from webloom.plans.oracle_extract import _PAGES, _TITLE, _TRACK

_REACH = """WITH RECURSIVE e AS (
    SELECT p.page_id AS src, c.page_id AS dst FROM pages p JOIN pages c
      ON c.page_id = 2 * p.page_id + 1 OR c.page_id = 2 * p.page_id + 2
    UNION ALL SELECT page_id, 0 FROM pages),
  r(node, depth, path) AS (
    SELECT page_id, 0, [page_id] FROM pages WHERE page_id = 0
    UNION ALL SELECT e.dst, r.depth + 1, list_append(r.path, e.dst) FROM r JOIN e ON e.src = r.node
      WHERE r.depth < 3 AND NOT list_contains(r.path, e.dst)),
  reach AS (SELECT node, min(depth) AS depth, min(path) AS path FROM r GROUP BY node)"""

_VERSIONS = """v AS (
    SELECT md5(url) AS url_key, url, k AS version,
           TIMESTAMP '2024-01-01' + to_minutes(CAST(k * page_id AS BIGINT)) AS fetched_at,
           html || '<!-- ' || CAST(k AS VARCHAR) || ' -->' AS body
    FROM pages, (VALUES (0), (1), (2)) AS t(k)),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY fetched_at DESC, version DESC) AS rn
             FROM v) WHERE rn = 1)"""

ORACLE = {
    "link_edges": _PAGES + "SELECT page_id, type, seq, value AS dst FROM r WHERE type IN ('CONTENT', 'NEXT', 'FOLLOW')",
    "frontier": _PAGES + """SELECT DISTINCT value AS url FROM r WHERE type IN ('CONTENT', 'NEXT', 'FOLLOW')
                            AND value NOT IN (SELECT url FROM pages)""",
    "crawl_depth3": _REACH + " SELECT node AS page_id, depth FROM reach",
    "inherited_tags": _REACH + """,
      t AS (SELECT page_id, """ + _TITLE + """ AS tag FROM pages
            UNION SELECT page_id, lower(unnest(""" + _TRACK + """)) FROM pages),
      anc AS (SELECT node, unnest(path[1:len(path) - 1]) AS anc FROM reach),
      g AS (SELECT anc.node, list_sort(list(DISTINCT t.tag)) AS tags FROM anc JOIN t ON t.page_id = anc.anc
            GROUP BY anc.node)
      SELECT reach.node AS page_id, reach.depth,
             array_to_string(list_concat(coalesce(g.tags, []::VARCHAR[]),
               ['source:' || p.url, 'filename:' || CASE WHEN rtrim(p.url, '/') = '' THEN '/'
                                                       ELSE regexp_extract(rtrim(p.url, '/'), '([^/]*)$', 1) END]), ',') AS tags
      FROM reach LEFT JOIN g USING (node) JOIN pages p ON p.page_id = reach.node""",
    "route_bodies": """SELECT 'page' AS kind, page_id AS id, 'parse' AS route FROM pages
                       UNION ALL SELECT 'document', doc_id, 'ingest' FROM documents""",
    "prefix_values": "SELECT page_id, substr(" + _TITLE + ", 7) AS value FROM pages",
    "page_cache_latest": "WITH " + _VERSIONS + """ SELECT url_key, url, version, fetched_at,
                          length(body) AS body_chars FROM latest""",
    "cache_hits": "SELECT page_id, url FROM pages WHERE starts_with(url, 'https:')",
    "cache_misses": "SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'https:')",
}

ORACLE["stream_page_cache"] = ORACLE["page_cache_latest"]
