"""DuckDB SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

WORD = r"[^ \t\n\x0B\x0C\r]+"
REACH = "reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.root = l.a)"

SUBSTRINGS = rf"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM texts)),
repeated AS (SELECT r, i FROM (SELECT *, min((doc_id, i)) OVER (PARTITION BY k) AS first FROM windows) WHERE (doc_id, i) > first),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM repeated),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS line, count(*) AS n FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM texts) ANTI JOIN covered USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM texts LEFT JOIN kept USING (r)"""

BYTES = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS k FROM (SELECT *, unnest(range(len(h) // 2 - 199)) AS i FROM texts WHERE len(h) >= 400)),
repeated AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM repeated),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM marked),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY r, span),
gaps AS (SELECT r, a AS b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a FROM spans UNION ALL SELECT r, len(h) // 2, max(b) FROM spans JOIN texts USING (r) GROUP BY r, h),
kept AS (SELECT r, string_agg(substring(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM gaps JOIN texts USING (r) GROUP BY r),
sums AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM spans GROUP BY r)
SELECT doc_id, len(t.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (r) LEFT JOIN sums USING (r)"""

VECTORS = f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
good AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM nodes WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.size * y.size) >= 0.9),
{REACH},
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(any_value(n), 0) AS n_links, min(root) AS component_id, min(root) = id AS kept FROM reach LEFT JOIN counts USING (id) GROUP BY id"""

SETS = rf"""
WITH RECURSIVE texts AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
nodes AS (SELECT id FROM texts),
{REACH}
SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, min(root) = id AS kept FROM reach LEFT JOIN sizes USING (id) GROUP BY id"""

ORACLE = {"op4_substring_dedup": SUBSTRINGS, "op5_suffix_dedup": BYTES, "op6_embedding_dedup": VECTORS, "op9_minhash_dedup": SETS}
