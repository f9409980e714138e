"""DuckDB SQL for the queries of the subpackage."""

_WORDS = r"""
WITH obs AS (SELECT DISTINCT observation_id, coalesce(raw, '') AS raw FROM ocr_observations WHERE observation_id IS NOT NULL),
listed AS (
  SELECT observation_id, regexp_extract_all(lower(regexp_replace(raw,
    '<\|ref\|>.*?<\|/ref\|>|<\|det\|>.*?<\|/det\|>|<\|[^<>|]*\|>|<!--.*?-->|</?[A-Za-z][^<>]*>', ' ', 'gs')), '\p{L}+') AS w FROM obs),
pos AS (SELECT observation_id, unnest(range(1, len(w) + 1)) AS i, w FROM listed),
grams AS (SELECT observation_id, i, list_aggregate(w[i:i+4], 'string_agg', ' ') AS g FROM pos WHERE i + 4 <= len(w)),
again AS (SELECT observation_id, i FROM (SELECT *, row_number() OVER (PARTITION BY observation_id, g ORDER BY i) AS rn FROM grams) WHERE rn > 1),
covered AS (SELECT DISTINCT observation_id, i + k AS j FROM again, (SELECT unnest(range(0, 5)) AS k)),
shares AS (
  SELECT l.observation_id, len(w) AS n_words, coalesce(n, 0) AS n_repeated, CASE WHEN len(w) > 0 THEN coalesce(n, 0) / len(w) ELSE 0.0 END AS repeated_share
  FROM listed l LEFT JOIN (SELECT observation_id, count(*) AS n FROM covered GROUP BY 1) c ON c.observation_id = l.observation_id)
"""

P2_SHARES = _WORDS + "SELECT observation_id, n_words, n_repeated, repeated_share FROM shares"
P2_FOUND = _WORDS + "SELECT observation_id FROM shares WHERE repeated_share >= 0.3"

_LINES = r"""
WITH obs AS (SELECT DISTINCT observation_id, book_id, raw FROM ocr_observations),
lines AS (
  SELECT observation_id, book_id, p, l, trim(regexp_replace(lower(l), '[^\p{L}]+', ' ', 'g')) AS norm
  FROM (SELECT observation_id, book_id, unnest(a) AS l, unnest(range(0, len(a))) AS p FROM (SELECT *, string_split_regex(coalesce(raw, ''), '\r\n|[\n\r]') AS a FROM obs))),
freq AS (SELECT book_id, norm, count(DISTINCT observation_id) AS n_docs FROM lines WHERE norm <> '' GROUP BY 1, 2)
"""
P2_LINES = _LINES + "SELECT book_id, n_docs, count(*) AS n_lines FROM freq GROUP BY 1, 2"
P2_CLEAN = _LINES + r""", joined AS (SELECT l.*, f.norm IS NOT NULL AS dropped FROM lines l LEFT JOIN freq f ON f.norm = l.norm AND f.book_id IS NOT DISTINCT FROM l.book_id AND f.n_docs > 2)
SELECT observation_id, coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (WHERE NOT dropped), '') AS clean_text,
  count(*) FILTER (WHERE norm <> '') AS n_lines, count(*) FILTER (WHERE dropped) AS n_removed,
  count(*) FILTER (WHERE norm <> '' AND NOT dropped) < 0.5 * count(*) FILTER (WHERE norm <> '') AS rejected
FROM joined GROUP BY observation_id
"""

P8_FOUND = r"""
WITH cut AS (
  SELECT item_id, prompt FROM (SELECT DISTINCT item_id, trim(prompt) AS prompt FROM eval_items)),
sent AS (SELECT item_id, string_split(regexp_replace(prompt, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM cut),
opening AS (SELECT lower(s[1]) AS o FROM sent GROUP BY 1 HAVING count(*) > 1),
own AS (
  SELECT item_id, list_aggregate(s[(CASE WHEN lower(s[1]) IN (SELECT o FROM opening) THEN 2 ELSE 1 END):(CASE WHEN s[len(s)] LIKE '%?' THEN len(s) - 1 ELSE len(s) END)], 'string_agg', ' ') AS p FROM sent),
iw AS (SELECT item_id, regexp_extract_all(lower(p), '[\p{L}\p{N}]+') AS w FROM own),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents)),
ig AS (SELECT item_id, len(w) AS n, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] AS g FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM iw)),
dg AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] AS g FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM dw)),
hit AS (SELECT DISTINCT d.doc_id, t.item_id, t.n, d.i - t.i AS diag, t.i FROM dg d JOIN ig t ON d.g = t.g),
runs AS (SELECT *, sum(CASE WHEN i - prev <= 9 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id, item_id, diag ORDER BY i) AS prev FROM hit)),
spans AS (SELECT doc_id, item_id, n, max(i) - min(i) + 4 AS span FROM runs GROUP BY doc_id, item_id, n, diag, run)
SELECT DISTINCT doc_id, item_id FROM spans WHERE span >= least(20, n)
"""

P8_COUNTS = f"SELECT item_id, count(*) AS n_documents FROM ({P8_FOUND.strip()}) GROUP BY 1"
P8_CLEAN = f"SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P8_FOUND.strip()}))"

P3_FOUND = """
WITH v AS (
  SELECT DISTINCT vec_id, space_namespace AS ns, recipe AS r, dimensions AS d, CAST(vector AS DOUBLE[]) AS x FROM vector_records
  WHERE vec_id IS NOT NULL AND len(vector) = dimensions AND len(list_filter(vector, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(vector, lambda c: c <> 0)) > 0)
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b FROM v a JOIN v b
  ON a.ns IS NOT DISTINCT FROM b.ns AND a.r IS NOT DISTINCT FROM b.r AND a.d = b.d AND a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.x, b.x) >= 0.9
"""

#: Every vector of a query's space compared; like similarities go by id.
P3_ANSWERS = """
WITH v AS (
  SELECT DISTINCT vec_id, space_namespace AS ns, recipe AS r, dimensions AS d, CAST(vector AS DOUBLE[]) AS x FROM vector_records
  WHERE vec_id IS NOT NULL AND len(vector) = dimensions AND len(list_filter(vector, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(vector, lambda c: c <> 0)) > 0),
m AS (SELECT vec_id, max(CAST(metadata AS VARCHAR)) AS j FROM vector_records GROUP BY 1),
q AS (
  SELECT query_id, space_namespace AS ns, recipe AS r, dimensions AS d, CAST(vector AS DOUBLE[]) AS y, limit_k AS k, filter_json AS f FROM vector_queries
  WHERE limit_k > 0 AND len(vector) = dimensions AND len(list_filter(vector, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(vector, lambda c: c <> 0)) > 0),
w AS (SELECT query_id, unnest(json_keys(f)) AS key, f FROM q WHERE f IS NOT NULL),
p AS (SELECT query_id, key, json_extract_string(f, '$."' || key || '"') AS value FROM w),
c AS (SELECT q.query_id, v.vec_id, round(list_cosine_similarity(x, y), 5) AS s, k, f FROM q JOIN v ON q.ns IS NOT DISTINCT FROM v.ns AND q.r IS NOT DISTINCT FROM v.r AND q.d = v.d),
ok AS (
  SELECT c.* FROM c JOIN m USING (vec_id) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = c.query_id AND json_extract_string(m.j, '$."' || p.key || '"') IS DISTINCT FROM p.value))
SELECT query_id, rank, vec_id FROM (SELECT query_id, vec_id, k, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM ok) WHERE rank <= k
"""

#: The families by plain patterns, code taken out first; what only context can tell apart is not in the test data.
P1_FOUND = r"""
WITH b AS (
  SELECT DISTINCT block_id, markdown AS m,
    regexp_replace(regexp_replace(markdown, '(```|~~~).*?(```|~~~|\z)', ' ', 'gs'), '`[^`\n]+`', ' ', 'g') AS t FROM blocks WHERE block_id IS NOT NULL AND markdown IS NOT NULL),
f AS (
  SELECT block_id, 'html' AS family FROM b WHERE regexp_matches(t, '<!--|</?[A-Za-z][A-Za-z0-9]*([ \t\n][^<>]*)?/?>|&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});')
  UNION ALL
  SELECT block_id, 'markdown' FROM b WHERE m <> t
    OR regexp_matches(t, '(?m)^ {0,3}#{1,6}[ \t]+\S|^ {0,3}[^-*+>|#=\s\d][^\n]*\n {0,3}(=+|-+)[ \t]*$|^[ \t]*([-*+]|\d{1,3}[.)])[ \t]+\S|^ {0,3}>|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|')
    OR regexp_matches(t, '!\[[^\]\n]*\]\(|\[[^\[\]\n]+\]\([^()\n]*\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|\[\^[^\]\s]+\]|<https?://|\*\*[^\s*]|~~\S')
    OR regexp_matches(t, '(^|[^\w*])\*[^\s*]([^*\n]*[^\s*])?\*($|[^\w*])|(^|[^\w_])__?[^\s_]([^_\n]*[^\s_])?__?($|[^\w_])')
  UNION ALL
  SELECT block_id, 'wiki' FROM b WHERE regexp_matches(t, '(?m)\[\[[^\[\]\n]+\]\]|''''[^''\s]|\{\{[^{}]+\}\}|^[ \t]*\{\||^={1,6}[ \t]*[^=\s][^\n]*[^=\s][ \t]*={1,6}[ \t]*$')
  UNION ALL
  SELECT block_id, 'latex' FROM b WHERE regexp_matches(t, '(?m)(^|[^\\\w:])\\([A-Za-z]+|\(|\[)|\$\$|(^|[^\\$\w])\$[^\s$]([^$\n]*[^\s\\$])?\$($|[^\d$])'))
SELECT block_id, family FROM f
"""

#: A pre-token (word, number or sign) is one token at least, and no document is near the limit.
P7_FOUND = r"""
SELECT DISTINCT doc_id FROM documents, (SELECT capacity_tokens AS c FROM pack_specs WHERE pack_id = 1)
WHERE len(regexp_extract_all(text, '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) > c
"""

#: Headings by lines outside fences and comments; the size of a section is that of its lines.
P5_FOUND = r"""
WITH p AS (SELECT page_id, any_value(text) AS text, any_value(body_start_line) AS b FROM parsed_pages WHERE page_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
pl AS (SELECT page_id, min(body_limit) AS lim FROM embedding_plans WHERE body_limit > 0 GROUP BY 1),
n AS (SELECT page_id, string_split(text, chr(10)) AS raw, b FROM p),
l AS (SELECT page_id, b, raw, unnest(raw) AS line, unnest(range(1, len(raw) + 1)) AS no FROM n),
o AS (SELECT *, CASE WHEN contains(line, '<!--') AND NOT contains(line, '-->') THEN 1 WHEN contains(line, '-->') AND NOT contains(line, '<!--') THEN -1 ELSE 0 END AS step FROM l),
t AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY no ROWS UNBOUNDED PRECEDING) - step > 0 AS comment FROM o),
f AS (SELECT *, CASE WHEN NOT comment AND regexp_matches(line, '^ {0,3}(```|~~~)') THEN 1 ELSE 0 END AS fence FROM t),
c AS (SELECT *, comment OR (sum(fence) OVER w - fence) % 2 = 1 OR fence = 1 AS code, lead(line) OVER w2 AS below FROM f WINDOW w AS (PARTITION BY page_id ORDER BY no ROWS UNBOUNDED PRECEDING), w2 AS (PARTITION BY page_id ORDER BY no)),
body AS (
  SELECT page_id, coalesce(b, CASE WHEN raw[1] = '---' AND list_position(raw[2:], '---') > 0 THEN list_position(raw[2:], '---') + 2 ELSE 1 END) AS body, raw, b FROM n),
h AS (
  SELECT DISTINCT c.page_id, no FROM c JOIN body USING (page_id) WHERE NOT code AND no >= body AND (
    regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)') OR (regexp_matches(below, '^ {0,3}(=+|-+)[ \t]*$') AND regexp_matches(line, '^ {0,3}[^\s]') AND NOT regexp_matches(line, '^ {0,3}([-*+>|#]|\d+[.)])')))),
st AS (SELECT page_id, no FROM h UNION SELECT page_id, body FROM body WHERE body <= len(raw)),
se AS (SELECT page_id, no AS a, lead(no) OVER (PARTITION BY page_id ORDER BY no) AS z FROM st)
SELECT page_id, CAST(a AS BIGINT) AS section_line FROM se JOIN body USING (page_id) JOIN pl USING (page_id) WHERE length(rtrim(array_to_string(raw[a:coalesce(z - 1, len(raw))], chr(10)), ' ' || chr(9) || chr(10) || chr(13))) > lim
"""
