"""DuckDB SQL for those queries of this folder that SQL can express."""

ORACLES = {
    "op1_sharding": """
SELECT doc_id, lang, source, n_chars, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents""",
    "op8_exact_dedup": """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d""",
}
