"""DuckDB SQL for the operators that SQL can express, written apart from the Spark code."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL = {
    "op3_substring_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
firsts AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, list(DISTINCT i) AS starts FROM win JOIN firsts USING (s) WHERE doc_id > f GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS g FROM hit),
kept AS (SELECT doc_id, w, coalesce(len(g), 0) AS n, CASE WHEN g IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(g, i)) END AS k FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
""",
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
part AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings LEFT JOIN part ON part.a = vec_id LEFT JOIN n ON n.a = vec_id
""",
    "op9_url_filters": r"""
WITH list AS (SELECT column0 AS domain, column1 AS action, column2 AS starts FROM (VALUES {url_list}) AS t(column0, column1, column2)),
spans AS (SELECT *, lead(starts) OVER (PARTITION BY domain ORDER BY starts) AS ends FROM list),
caps AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
  nullif(rtrim(regexp_extract(trim(lower(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') AS host FROM pages),
hits AS (SELECT page_id, domain, action, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS r
  FROM caps JOIN spans ON (host = domain OR ends_with(host, '.' || domain)) AND fetched >= starts AND (ends IS NULL OR fetched < ends) WHERE action <> 'remove')
SELECT caps.page_id, url, CAST(fetched AS VARCHAR) AS fetched, host, domain AS matched_domain, action, coalesce(action <> 'block', true) AS kept
FROM caps LEFT JOIN hits ON hits.page_id = caps.page_id AND r = 1
""",
    "op6_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(t, r))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(11 + length(role) + length(regexp_replace(role, '[^\\<>\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
""",
    "op11_filter_audit": rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
least_id AS (SELECT coalesce(text, '') AS text, min(doc_id) AS m FROM documents GROUP BY 1),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 2 * length(t.text),
     regexp_matches(t.text, '[#$%&*|]'), coalesce(t.doc_id > m, false)] AS bad
  FROM t JOIN least_id ON least_id.text = t.text LEFT JOIN marks ON marks.doc_id = t.doc_id),
cells AS (SELECT part, bad, good, toxic, count(*) AS n FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
tall AS (
  SELECT part, filter_order, step, n, good, toxic, filter_order[step] AS letter, bad[ascii(filter_order[step]) - 64] AS fails,
    list_bool_or(list_transform(range(1, step), lambda k: bad[ascii(filter_order[k]) - 64])) AS earlier,
    len(list_filter(bad, lambda b: b)) = 1 AS single
  FROM cells, orders, LATERAL (SELECT unnest(range(1, 6)) AS step)),
per_step AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT fails AND NOT coalesce(earlier, false)), 0) AS kept,
    coalesce(sum(n) FILTER (fails AND NOT coalesce(earlier, false)), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND coalesce(earlier, false)), 0) AS redundant,
    coalesce(sum(n) FILTER (fails AND single), 0) AS unique_fails,
    coalesce(sum(n) FILTER (fails AND NOT coalesce(earlier, false) AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (fails AND NOT coalesce(earlier, false) AND toxic), 0) AS toxic_lost
  FROM tall GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM per_step
""",
    "op12_source_divergence": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM t),
u AS (SELECT r, lang, source, unnest(w) AS term FROM t),
kept AS (SELECT lang, term, count(*)::HUGEINT AS c FROM u GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cnt AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM u JOIN kept USING (lang, term) GROUP BY ALL),
vocab AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
sums AS (SELECT grp.lang, grp.source, coalesce(sum(c), 0)::HUGEINT AS n FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
dense AS (
  SELECT s.lang, s.source, k.term, coalesce(cnt.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(cnt.c, 0) + 1)) // (s.n + v) AS p, 1 + (1000000000::HUGEINT * (k.c + 1)) // (vocab.n + v) AS q
  FROM sums s JOIN kept k USING (lang) JOIN vocab USING (lang) LEFT JOIN cnt ON cnt.lang = s.lang AND cnt.source = s.source AND cnt.term = k.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL),
rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM dense WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op13_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256 FROM t
""",
}
