"""DuckDB oracle SQL for the classification queries.

Hand-written against the built-in rule set (FIXTURES 2.2) - an independent
formulation (regex + CASE in priority order) of what the Spark side compiles.
"""

_SPLIT = r"""
u0 AS (
  SELECT page_id, url,
    lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS scheme,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) AS host,
    regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query,
    regexp_extract(url, '^[^#]*#(.*)$', 1) AS fragment
  FROM pages),
u1 AS (
  SELECT *, regexp_replace(regexp_extract(host, '([^@]*)$', 1), ':[0-9]*$', '') AS hostname,
         string_split(CASE WHEN starts_with(path, '/') THEN substr(path, 2) ELSE path END, '/') AS segs,
         list_transform(list_filter(string_split(query, '&'), lambda p: p <> '' AND starts_with(p, 'page=') OR p = 'page'),
                        lambda p: CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END) AS page_vals
  FROM u0),
m AS (
  SELECT *,
    (hostname = 'spam-farm.example.org' OR ends_with(hostname, '.spam-farm.example.org')) AS m_spam,
    (hostname = 'cheap-pills.example.com' OR ends_with(hostname, '.cheap-pills.example.com')) AS m_pills,
    ((hostname = 'example.org' OR ends_with(hostname, '.example.org'))
      AND len(segs) >= 2 AND regexp_matches(segs[1], '^(en|fr|de|es)$')
      AND segs[2] <> '' AND regexp_matches(segs[2], '[0-9]+')
      AND (len(page_vals) = 0 OR list_bool_and(list_transform(page_vals, lambda v: v <> '' AND regexp_matches(v, '^[0-9]+$'))))) AS m_listing,
    ((hostname = 'example.com' OR ends_with(hostname, '.example.com'))
      AND len(segs) >= 2 AND regexp_matches(segs[1], '^(en|fr|de|es)$') AND regexp_matches(segs[2], '^[0-9]+$')) AS m_article,
    ((hostname = 'example.com' OR ends_with(hostname, '.example.com'))
      AND len(segs) >= 2 AND regexp_matches(segs[1], '^(en|fr|de|es)$') AND regexp_matches(segs[2], '^[0-9]+[.]html$')) AS m_file
  FROM u1),
c AS (
  SELECT page_id, url,
    CASE WHEN m_spam THEN 'spam_farm' WHEN m_pills THEN 'cheap_pills' WHEN m_listing THEN 'listing'
         WHEN m_article THEN 'article' WHEN m_file THEN 'article_file' END AS uclass,
    CASE WHEN m_spam OR m_pills THEN 'IGNORE' WHEN m_listing THEN 'LIST'
         WHEN m_article THEN 'POST' WHEN m_file THEN 'FILE' END AS class_type,
    CASE WHEN m_spam OR m_pills THEN 'https://' || host || '/'
         WHEN m_listing THEN 'https://' || CASE WHEN hostname = 'example.org' THEN host ELSE 'example.org' END
              || '/' || segs[1] || '/' || segs[2] || '?'
              || CASE WHEN len(page_vals) = 0 THEN 'page=1'
                      ELSE array_to_string(list_transform(page_vals, lambda v: 'page=' || v), '&') END
         WHEN m_article OR m_file THEN 'https://' || host || '/' || segs[1] || '/' || segs[2]
    END || CASE WHEN (m_spam OR m_pills OR m_listing OR m_article OR m_file) AND fragment <> ''
                THEN '#' || fragment ELSE '' END AS normalized_url
  FROM m)
"""

ORACLE = {
    "classify_pages": "WITH " + _SPLIT + " SELECT page_id, url, uclass, class_type, normalized_url FROM c",
    "classify_counts": "WITH " + _SPLIT + " SELECT uclass, class_type, count(*) AS n_pages FROM c GROUP BY uclass, class_type",
    "unclassified_pages": "WITH " + _SPLIT + " SELECT page_id, url FROM c WHERE uclass IS NULL",
    "ignored_pages": "WITH " + _SPLIT + " SELECT page_id, url, uclass FROM c WHERE class_type = 'IGNORE'",
    "normalize_urls": "WITH " + _SPLIT + " SELECT page_id, url, uclass, normalized_url FROM c "
                      "WHERE uclass IS NOT NULL AND class_type <> 'IGNORE'",
}

ORACLE["classify_pages_by_host"] = ORACLE["classify_pages"]
