"""DuckDB oracle SQL for the similarity queries: brute force over all pairs."""

_ITEMS = """b AS (SELECT vec_id, array_to_string(list_transform(embedding,
                 lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT::UBIGINT AS u FROM embeddings),
  items AS (SELECT vec_id AS id, u FROM b
            UNION ALL SELECT vec_id + 100000, xor(u, ((1::UBIGINT << (vec_id % 12)::INTEGER) - 1)) FROM b)"""

ORACLE = {
    "signature_of_embedding": f"""WITH {_ITEMS}
      SELECT id, CAST(CAST(u AS HUGEINT) - CASE WHEN u >= 9223372036854775808 THEN 18446744073709551616::HUGEINT
                                               ELSE 0 END AS BIGINT) AS sig,
             'phash:p:' || printf('%016x', u) AS tag FROM items""",
    "similar_pairs": f"""WITH {_ITEMS}
      SELECT a.id AS id_a, b.id AS id_b, bit_count(xor(a.u, b.u))::DOUBLE AS dist
      FROM items a JOIN items b ON a.id < b.id AND bit_count(xor(a.u, b.u)) <= 10""",
    "similar_to_target": f"""WITH {_ITEMS}
      SELECT t.id AS target, i.id, bit_count(xor(t.u, i.u))::DOUBLE AS dist
      FROM items t JOIN items i ON t.id = 0 AND i.id <> 0 AND bit_count(xor(t.u, i.u)) <= 22""",
}
