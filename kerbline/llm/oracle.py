"""DuckDB SQL for those ``llm`` queries that SQL can express."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER w AS k, sum(source_size) OVER () AS tokens,
         coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM s WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST)
), l AS (SELECT *, (tokens::DOUBLE - 3.0::DOUBLE * capped::DOUBLE) / left_weight AS level FROM o
), f AS (SELECT min_by(level, k) AS level FROM l WHERE source_size * 3.0::DOUBLE / weight >= level
), t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, f.level * weight) AS target FROM s, f
), c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + d.size::DOUBLE / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, round(target, 6) AS target,
       (CASE WHEN size > 0 THEN greatest(ceil((target - middle) / source_size), 0) ELSE 0 END * size)::BIGINT AS taken
FROM c
"""

OP3 = r"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest
  FROM pages
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (5 * (7 - i % 8))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < latest THEN latest END AS refers_to
FROM p
"""

OP7 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), r AS (
  SELECT *, lag(role) OVER w AS prev,
         length(regexp_replace(text, '<(\**)\|', '<*\1|', 'g')) AS chars,
         length(replace(regexp_replace(role, '<(\**)\|', '<*\1|', 'g'), chr(10), '<|nl|>')) AS role_chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(chars + CASE WHEN prev = role THEN length('<|turn|>') ELSE role_chars + length('<|im_start|><|im_end|>') + 2 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
items AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - k + 1)) AS i FROM b)),
places AS (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
hits AS (SELECT p.r, p.i, p.k, item FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM places) p JOIN items USING (k, g)),
words AS (SELECT r, count(DISTINCT place)::BIGINT AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(i, i + k - 1)) AS place FROM hits) GROUP BY r),
found AS (SELECT r, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

ORACLE: dict[str, str] = {"op1_mixing": OP1, "op3_warc": OP3, "op7_chat": OP7, "op10_decontam": OP10}
