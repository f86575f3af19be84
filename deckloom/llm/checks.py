"""SQL that checks the queries of the training-data operators, where SQL can express them."""

from __future__ import annotations

#: Words of a text: runs of anything but space and the characters 9 to 13.
WORDS = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"

SQL: dict[str, str] = {}

SQL["op9_mixing"] = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols FROM documents),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 13)
    AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / ((size + 1.0::DOUBLE) / (size + 1.0::DOUBLE + symbols)) AS k FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS n
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE n % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most
  FROM sources),
-- Share, stop those above their limit, and share the excess again, until none is above.
rounds(i, full_n) AS (
  SELECT 0, CAST([] AS BIGINT[])
  UNION ALL
  SELECT i + 1, (SELECT list(n ORDER BY n) FROM weighted q WHERE list_contains(full_n, n) OR most < w * (
     SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(most) FILTER (list_contains(full_n, n)), 0)) / sum(w) FILTER (NOT list_contains(full_n, n))
     FROM weighted))
  FROM rounds WHERE i < (SELECT count(*) FROM weighted)),
last AS (SELECT coalesce(full_n, CAST([] AS BIGINT[])) AS full_n FROM rounds WHERE i = (SELECT max(i) FROM rounds)),
targets AS (
  SELECT source, source_size, CASE WHEN list_contains(full_n, n) THEN most ELSE w * (
     SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(most) FILTER (list_contains(full_n, n)), 0)) / sum(w) FILTER (NOT list_contains(full_n, n))
     FROM weighted) END AS target FROM weighted, last),
summed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target / nullif(t.source_size, 0)) AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id) AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(size * (coalesce(epochs, 0) + CASE WHEN target - epochs * source_size > 0 AND size > 0
    AND upto - size / 2.0::DOUBLE <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed"""

#: The tree of path templates, level by level, as the rules of ``links`` state them.
_DEPTH, _ONE_IN = 4, 20
_PARTS = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
_LEVELS = "".join(f"""
level{d} AS (SELECT *, coalesce(CASE WHEN len(segments) >= {d} THEN segments[{d}] END, '') AS segment FROM tree{d - 1}),
counts{d} AS (SELECT host, template, segment, sum(n) AS own FROM level{d} GROUP BY ALL),
often{d} AS (SELECT host, template, segment, own * {_ONE_IN} >= sum(own) OVER (PARTITION BY host, template) AS often FROM counts{d}),
tree{d} AS (SELECT host, shape, n, n_labelled, n_bad, segments, template || CASE WHEN segment = '' THEN ''
    WHEN often OR starts_with(segment, '*') THEN '/' || segment ELSE '/*' END AS template
  FROM level{d} JOIN often{d} USING (host, template, segment)),""" for d in range(1, _DEPTH + 1))

SQL["op8_links"] = f"""
WITH parted AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), {_PARTS}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), {_PARTS}, 2) AS path FROM pages),
labelled AS (
  SELECT host, path, quality = 0 OR toxic = 1 AS bad FROM parted JOIN labels
    ON regexp_extract(url, '://[^/?#]*[^?#]*/([0-9]+)', 1) = CAST(doc_id AS VARCHAR)),
everything AS (SELECT host, path, NULL::BOOLEAN AS bad FROM parted UNION ALL SELECT * FROM labelled WHERE bad IS NOT NULL),
shaped AS (
  SELECT *, regexp_replace(replace(path, '/', '//') || '/', '/[^/]*?[0-9][^/]*?(\\.[A-Za-z]+)?/', '/*\\1/', 'g') AS s FROM everything),
shapes AS (SELECT host, path, bad, replace(substr(s, 1, len(s) - 1), '//', '/') AS shape FROM shaped),
tree0 AS (
  SELECT host, shape, count(*) AS n, count(bad) AS n_labelled, count(*) FILTER (bad) AS n_bad,
    list_filter(string_split(shape, '/'), lambda x: x <> '') AS segments, '' AS template FROM shapes GROUP BY host, shape),{_LEVELS}
templates AS (
  SELECT host, shape, template || CASE WHEN len(segments) > {_DEPTH} THEN '/**' ELSE '' END AS template, n, n_labelled, n_bad
  FROM tree{_DEPTH}),
leaves AS (
  SELECT host, template, sum(n_labelled)::DOUBLE AS n, sum(n_bad)::DOUBLE AS bad, regexp_replace(template, '^/[^/*]+', '/{{}}') AS family
  FROM templates GROUP BY host, template),
pooled AS (SELECT *, sum(bad) OVER f / greatest(sum(n) OVER f, 1) AS share FROM leaves WINDOW f AS (PARTITION BY host, family)),
branches AS (
  SELECT *, CASE WHEN (bad - n * share) * (bad - n * share) <= 1.96::DOUBLE * 1.96::DOUBLE * (n * share) * (1 - share)
    THEN family ELSE template END AS branch FROM pooled),
judged AS (
  SELECT host, template, CASE WHEN (sum(bad) OVER b + 10.0::DOUBLE * (SELECT coalesce(sum(n_bad)::DOUBLE / greatest(sum(n_labelled), 1), 0) FROM templates))
    / (sum(n) OVER b + 10.0::DOUBLE) >= 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM branches WINDOW b AS (PARTITION BY host, branch)),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
pages_shaped AS (
  SELECT page_id, host, path, replace(substr(s, 1, len(s) - 1), '//', '/') AS shape FROM (
    SELECT *, regexp_replace(replace(path, '/', '//') || '/', '/[^/]*?[0-9][^/]*?(\\.[A-Za-z]+)?/', '/*\\1/', 'g') AS s FROM parted)),
fitting AS (
  SELECT page_id, host, path, shape, (SELECT max_by(struct_pack(r := h || p, v := r.verdict), len(h || p)) FROM rules r
    WHERE (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, p)) AS fit FROM pages_shaped q)
SELECT page_id, host, path, fit.r AS rule, coalesce(fit.v, j.verdict) AS verdict, t.template
FROM fitting JOIN templates t USING (host, shape) JOIN judged j ON j.host = t.host AND j.template = t.template"""


def _license_sql() -> str:
    """Base phrases, and template spans by word-for-word windows of three, from the same texts and limits."""
    from deckloom.llm.licences import PHRASES, TEMPLATES, template_words

    templates = ", ".join("({}, '{}', ['{}'])".format(i, label, "', '".join(template_words(text)))
                          for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in PHRASES)
    return f"""
WITH worded AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
templates(t, label, words) AS (VALUES {templates}),
phrases(phrase, label, n) AS (VALUES {phrases}),
placed AS (SELECT r, words, unnest(range(0, len(words))) AS pos FROM worded),
windows AS (SELECT r, pos, words[pos + 1] AS a, words[pos + 2] AS b, words[pos + 3] AS c FROM placed WHERE pos + 3 <= len(words)),
template_at AS (SELECT t, len(words) AS size, words, unnest(range(0, len(words) - 2)) AS spot FROM templates),
hits AS (
  SELECT r, t, size, spot, pos, pos - spot AS diagonal FROM windows JOIN template_at
    ON a = words[spot + 1] AND b = words[spot + 2] AND c = words[spot + 3]),
lagged AS (
  SELECT r, t, diagonal, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > 4, TRUE)::INT AS apart
  FROM (SELECT DISTINCT r, t, diagonal FROM hits)),
bands AS (SELECT r, t, diagonal, sum(apart) OVER (PARTITION BY r, t ORDER BY diagonal) AS band FROM lagged),
grouped AS (
  SELECT r, t, size, spot, pos, 'd' || diagonal AS g FROM hits UNION ALL
  SELECT h.r, h.t, size, spot, pos, 'b' || band FROM hits h JOIN bands USING (r, t, diagonal)),
covered AS (SELECT r, t, size, g, pos, unnest(range(spot, spot + 3)) AS word FROM grouped),
spans AS (
  SELECT r, t, count(DISTINCT word)::DOUBLE / any_value(size) AS coverage FROM covered GROUP BY r, t, g
  HAVING count(DISTINCT word)::DOUBLE / any_value(size) >= 0.6 AND count(DISTINCT word) >= 0.6::DOUBLE * (max(pos) + 3 - min(pos))),
more AS (SELECT r, list(DISTINCT label) AS labels, max(coverage) AS coverage FROM spans JOIN templates USING (t) GROUP BY r),
base AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels
  FROM placed JOIN phrases ON array_to_string(words[pos + 1:pos + n], ' ') = phrase GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(more.labels, []))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(coverage, 0.0::DOUBLE) END AS score
FROM worded LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""


SQL["op6_licences"] = _license_sql()

SQL["op2_topk"] = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""

#: Masks of failed filters for each document, then every order of the filters step by step.
SQL["op13_filter_audit"] = """
WITH worded AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY 1),
judged AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(min(w.doc_id) OVER (PARTITION BY text) < w.doc_id, FALSE)::INT AS mask
  FROM worded w LEFT JOIN marks m ON w.doc_id = m.doc_id),
counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM judged GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS own, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS earlier
  FROM orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS s)),
done AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0) AS toxic_lost
  FROM counted, steps GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM done"""

#: Control strings, escaped or not, get one sign more; the template adds three signs to a chat and 17 to a turn.
SQL["op12_chat_format"] = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, 17 + length(regexp_replace(role, '(<|\[)(\\*/?(?:s>|INST\]))', '\1\\\2', 'g'))
    + length(regexp_replace(text, '(<|\[)(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS signs FROM given)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(signs) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id"""
