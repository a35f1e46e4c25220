"""DuckDB oracle SQL for the content and tag queries."""

_STORE = "store AS (SELECT sha256(text) AS id_hash, min(doc_id) AS first_seq, count(*) AS n_copies, " \
         "arg_min(text, doc_id) AS body FROM documents GROUP BY 1)"

_TAGSTORE = """tstore AS (
  SELECT id_hash, tags FROM (
    SELECT sha256(d.text) AS id_hash,
           ['quality:' || CAST(l.quality AS VARCHAR), 'toxic:' || CAST(l.toxic AS VARCHAR)] AS tags,
           row_number() OVER (PARTITION BY sha256(d.text) ORDER BY d.doc_id DESC) AS rn
    FROM documents d JOIN labels l USING (doc_id)) WHERE rn = 1)"""

ORACLE = {
    "content_ids": "SELECT doc_id, sha256(text) AS id_hash FROM documents",
    "id_color": f"WITH {_STORE} SELECT id_hash, '#' || lower(substr(id_hash, 1, 6)) AS color FROM store",
    "content_dedup": f"WITH {_STORE} SELECT id_hash, first_seq AS first_doc_id, n_copies, "
                     "length(body) AS body_chars FROM store",
    "content_lookup": f"""WITH {_STORE},
      probes AS (SELECT 'benchmark' AS kind, item_id AS probe_id, sha256(text) AS id_hash FROM benchmark
                 UNION ALL SELECT 'document', doc_id, sha256(text) FROM documents)
      SELECT p.kind, p.probe_id, p.id_hash, s.id_hash IS NOT NULL AS present, s.first_seq AS first_doc_id
      FROM probes p LEFT JOIN store s USING (id_hash)""",
    "source_tags": """WITH i AS (SELECT sha256(text) AS id_hash, 'source:' || source AS tag, doc_id AS seq FROM documents),
      f AS (SELECT id_hash, tag, min(seq) AS s FROM i GROUP BY 1, 2)
      SELECT id_hash, string_agg(tag, ',' ORDER BY s) AS tags, count(*) AS n_tags FROM f GROUP BY 1""",
    "tags_parse": """SELECT doc_id, array_to_string(list_sort(list_distinct(
         ['source:' || source, 'lang:' || lang, 'source:' || source])), ',') AS tags,
         len(list_distinct(['source:' || source, 'lang:' || lang])) AS n_tags FROM documents""",
    "tags_string": """WITH i AS (
        SELECT sha256(text) AS id_hash, 'source:' || source AS tag, doc_id * 2 AS seq FROM documents
        UNION ALL SELECT sha256(text), 'lang:' || lang, doc_id * 2 + 1 FROM documents),
      f AS (SELECT id_hash, tag, min(seq) AS s FROM i GROUP BY 1, 2)
      SELECT id_hash, string_agg(tag, ',' ORDER BY s) AS tags, count(*) AS n_tags FROM f GROUP BY 1""",
    "tag_put_get": f"""WITH {_STORE}, {_TAGSTORE}
      SELECT s.id_hash, coalesce(array_to_string(t.tags, ','), '') AS tags, coalesce(len(t.tags), 0) AS n_tags
      FROM store s LEFT JOIN tstore t USING (id_hash)""",
    "find_tagged": f"WITH {_TAGSTORE} SELECT id_hash FROM tstore WHERE len(tags) > 0",
    "find_tagged_quality": f"WITH {_TAGSTORE} SELECT id_hash FROM tstore "
                           "WHERE list_contains(tags, 'quality:1') AND NOT list_contains(tags, 'toxic:1')",
}

ORACLE["stream_content_dedup"] = "SELECT DISTINCT sha256(text) AS id_hash, length(text) AS body_chars FROM documents"

ORACLE["tags_has"] = """SELECT DISTINCT sha256(text) AS id_hash,
  sha256(text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id)) AS present FROM documents"""
