"""DuckDB SQL with the same rows as queries of the training-data operators, where SQL can express them."""

ORACLES = {
    "op1_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN twice USING (k)),
run AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit) GROUP BY doc_id, g),
cut AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM run),
gone AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(h, 2 * b + 1, 2 * (s - b)), '' ORDER BY s) AS kept FROM cut JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)""",
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * k >= 80 * (len(a.sh) + len(b.sh) - k)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT q.y, r.root FROM r JOIN both_ways q ON q.x = r.id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(root) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, sh""",
}
