"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from .divergence import CHAR_LIMIT, CHAR_NOISE, COMMON, LEAST_WORDS, LONGEST, MIN_CHARS, MIN_DOCS, MIN_WORDS, WORD_LIMIT, WORD_NOISE

_CLASSES = [r"\p{Ll}", r"\p{Lu}\p{Lt}", r"\p{Lm}\p{Lo}\p{M}", r"\p{N}", r"\p{Z}\x09-\x0D", r".,;:!?''’\"()\-"]
_COUNT = ", ".join(f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g')) AS c{i}" for i, c in enumerate(_CLASSES))
_EDGE = r".,;:!?''’\"()"
_BITS = "greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
cut AS (SELECT rid, lang, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
forms AS (SELECT rid, lang, lower(regexp_replace(w, '^[{_EDGE}]+|[{_EDGE}]+$', '', 'g')) AS w, count(*) AS n FROM (SELECT rid, lang, len(ws) AS n_words, unnest(ws) AS w FROM cut) WHERE n_words >= {LEAST_WORDS} GROUP BY ALL),
spread AS (SELECT lang, w, count(*) AS n FROM forms WHERE lang IS NOT NULL AND length(w) BETWEEN 1 AND {LONGEST} GROUP BY lang, w),
common AS (SELECT lang, w FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS place FROM spread) WHERE place <= {COMMON}),
places AS (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM cut WHERE len(ws) > 8),
wins AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS key FROM places),
twice AS (SELECT rid, unnest(range(i, i + 8)) AS pos FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, key) AS n FROM wins) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT pos) AS n FROM twice GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, d.lang, t, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN cut USING (rid) LEFT JOIN lines l USING (rid) LEFT JOIN repeats r USING (rid)),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
langs AS (SELECT lang FROM judged WHERE NOT base_failed AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= {MIN_DOCS}),
classes AS (SELECT rid, {_COUNT}, length(t) - length(regexp_replace(t, '[\p{{P}}\p{{S}}]', '', 'g')) - (length(t) - length(regexp_replace(t, '[{_CLASSES[5]}]', '', 'g'))) AS c6, length(t) AS n FROM judged WHERE NOT base_failed),
chars AS (SELECT rid, unnest(range(8)) AS bin, unnest([c0, c1, c2, c3, c4, c5, c6, n - c0 - c1 - c2 - c3 - c4 - c5 - c6]) AS n FROM classes),
counts AS (SELECT rid, f.w, n FROM forms f JOIN judged USING (rid) WHERE NOT base_failed AND w IN (SELECT w FROM common)),
char_refs AS (SELECT lang, bin, CAST(sum(chars.n * 1000000 // classes.n) AS DOUBLE) AS r FROM chars JOIN classes USING (rid) JOIN judged USING (rid) JOIN langs USING (lang) GROUP BY lang, bin),
own_refs AS (SELECT c.lang, c.w, coalesce(r, 0) AS r FROM common c JOIN langs USING (lang) LEFT JOIN (SELECT j.lang, k.w, sum(k.n * 1000000 // j.n_words) AS r FROM counts k JOIN judged j USING (rid) GROUP BY ALL) s ON s.lang = c.lang AND s.w = c.w),
word_refs AS (
  SELECT lang, w, CAST(r AS DOUBLE) AS r FROM own_refs
  UNION ALL SELECT lang, '', CAST(1000000 * docs - coalesce(own, 0) AS DOUBLE) FROM (SELECT lang, count(*) AS docs FROM judged JOIN langs USING (lang) WHERE NOT base_failed GROUP BY lang) LEFT JOIN (SELECT lang, sum(r) AS own FROM own_refs GROUP BY lang) USING (lang)),
good AS (SELECT rid, lang, t, n_words FROM judged WHERE NOT base_failed),
own_words AS (SELECT g.rid, c.lang, c.w, coalesce(k.n, 0) AS n FROM good g CROSS JOIN (SELECT * FROM common JOIN langs USING (lang)) c LEFT JOIN counts k ON k.rid = g.rid AND k.w = c.w),
own_counts AS (
  SELECT rid, lang, w, n FROM own_words
  UNION ALL SELECT g.rid, l.lang, '', g.n_words - coalesce(o.n, 0) FROM good g CROSS JOIN langs l LEFT JOIN (SELECT rid, lang, sum(n) AS n FROM own_words GROUP BY rid, lang) o ON o.rid = g.rid AND o.lang = l.lang),
char_pairs AS (SELECT rid, lang, n / sum(n) OVER (PARTITION BY rid, lang) AS p, r / sum(r) OVER (PARTITION BY rid, lang) AS q FROM chars JOIN char_refs USING (bin)),
word_pairs AS (SELECT rid, lang, n / sum(n) OVER (PARTITION BY rid, lang) AS p, r / sum(r) OVER (PARTITION BY rid, lang) AS q FROM own_counts JOIN word_refs USING (lang, w)),
char_far AS (SELECT rid, lang, {_BITS} AS far FROM char_pairs GROUP BY rid, lang),
word_far AS (SELECT rid, lang, {_BITS} AS far FROM word_pairs GROUP BY rid, lang),
near AS (
  SELECT rid, bool_or((length(t) < {MIN_CHARS} OR c.far <= {CHAR_LIMIT**2} + {CHAR_NOISE} / length(t)) AND (n_words < {MIN_WORDS} OR w.far <= {WORD_LIMIT**2} + {WORD_NOISE} / n_words)) AS ok
  FROM char_far c JOIN word_far w USING (rid, lang) JOIN good USING (rid) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (coalesce(ok, true) OR (lang IS NOT NULL AND lang NOT IN (SELECT lang FROM langs))) AS kept
FROM judged LEFT JOIN near USING (rid)
"""

OP2 = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT rid, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
pairs AS (SELECT a.rid AS a, b.rid AS b FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(rid, id) AS (SELECT rid, vec_id FROM ok UNION SELECT p.a, r.id FROM reach r JOIN pairs p ON p.b = r.rid)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, vec_id = coalesce(low, vec_id) AS kept
FROM v LEFT JOIN (SELECT a AS rid, count(*) AS n FROM pairs GROUP BY a) USING (rid) LEFT JOIN (SELECT rid, min(id) AS low FROM reach GROUP BY rid) USING (rid)
"""

OP5 = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
texts AS (SELECT text, min(doc_id) AS low, row_number() OVER () AS tid FROM d WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text),
cut AS (SELECT tid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts),
grams AS (SELECT tid, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS s, least(5, len(ws)) AS width FROM (SELECT tid, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM cut)),
sets AS (SELECT tid, s, width, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT tid, sum(n) AS n FROM sets GROUP BY tid),
inter AS (SELECT a.tid AS a, b.tid AS b, sum(least(a.n, b.n)) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.width = b.width AND a.tid < b.tid GROUP BY ALL),
near AS (SELECT a, b FROM inter JOIN totals x ON x.tid = a JOIN totals y ON y.tid = b WHERE inter.n / CAST(x.n + y.n - inter.n AS DOUBLE) >= 0.8),
links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(tid, id) AS (SELECT tid, low FROM texts UNION SELECT l.a, r.id FROM reach r JOIN links l ON l.b = r.tid),
classes AS (SELECT tid, min(id) AS class_id FROM reach GROUP BY tid),
found AS (SELECT doc_id, CASE WHEN t.tid IS NULL THEN doc_id ELSE class_id END AS class_id FROM d LEFT JOIN texts t ON d.text = t.text LEFT JOIN classes USING (tid))
SELECT doc_id, class_id, coalesce(doc_id = class_id, class_id IS NULL) AS kept FROM found
"""

OP4 = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
urls AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM rest),
best AS (
  SELECT page_id, max_by(struct_pack(rule := r_host || r_path, verdict := r_verdict), length(r_host || r_path)) AS b
  FROM (SELECT DISTINCT page_id, host, path FROM urls) u
  JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY page_id)
SELECT u.page_id, u.host, u.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN best USING (page_id)
"""

OP7 = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS key
  FROM documents),
each AS (SELECT source, CAST(sum(size) AS BIGINT) AS s_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM rows GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER o AS r, sum(s_size) OVER o AS full_size, sum(w) OVER o AS full_w,
    sum(s_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM each WINDOW o AS (ORDER BY 3 * s_size / w, source ROWS UNBOUNDED PRECEDING)),
share AS (
  SELECT coalesce(
    (SELECT CASE WHEN r = 1 THEN CAST(total AS DOUBLE) / CAST(all_w AS DOUBLE)
       ELSE CAST(total - 3 * (full_size - s_size) AS DOUBLE) / CAST(all_w - full_w + w AS DOUBLE) END
     FROM ranked
     WHERE (total - 3 * (full_size - s_size)) * w <= 3 * s_size * (all_w - full_w + w)
     ORDER BY r LIMIT 1), 0) AS s),
plan AS (SELECT source, s_size, CASE WHEN s * w > 3 * s_size THEN 3.0 * s_size ELSE s * w END AS target FROM each, share),
named AS (
  SELECT rows.doc_id, rows.source, size, key, s_size, target, CAST(floor(target) AS BIGINT) AS words, count(*) OVER (PARTITION BY rows.source, key, rows.doc_id, size) AS copies
  FROM rows JOIN plan ON rows.source IS NOT DISTINCT FROM plan.source),
cut AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - size * copies AS ahead
  FROM named)
SELECT doc_id, size, s_size AS source_size, CAST(target AS DOUBLE) AS target,
  CAST(CASE WHEN s_size > 0 THEN words // s_size ELSE 0 END * size
    + greatest(0, least(size, (words - CASE WHEN s_size > 0 THEN words // s_size ELSE 0 END * s_size - ahead) // copies)) AS BIGINT) AS taken
FROM cut
"""

OP10 = r"""
WITH RECURSIVE crc(n, c, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc WHERE k = 8),
docs AS (
  SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS digits,
    (CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT)) AS part,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) >> 1) AS own
  FROM documents),
sized AS (
  SELECT doc_id, CAST(octet_length(raw) + 16 AS BIGINT) AS size, part, part * 2147483648 + own AS key,
    xor(list_reduce(
      list_prepend(4294967295, list_transform(regexp_extract_all(digits, '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) AS text_crc32
  FROM docs, crc_table),
total AS (SELECT sum(size) AS bytes FROM sized),
parts AS (SELECT part, sum(size) AS part_bytes, sum(sum(size)) OVER (ORDER BY part) - sum(size) AS part_start FROM sized GROUP BY part),
keys AS (SELECT key, sum(size) AS key_bytes, sum(sum(size)) OVER (ORDER BY key) - sum(size) AS key_start FROM sized GROUP BY key),
placed AS (
  SELECT doc_id, size, text_crc32, key,
    CAST(least(39, CASE WHEN part_bytes * 40 * 100 <= bytes
      THEN ((2 * part_start + part_bytes) * 40) // (2 * bytes)
      ELSE ((2 * key_start + key_bytes) * 40) // (2 * bytes) END) AS INTEGER) AS shard
  FROM sized JOIN parts USING (part) JOIN keys USING (key), total)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, size) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM placed
"""

ORACLES = {"op1_divergence": OP1, "op2_euclidean_lsh": OP2, "op5_dart_minhash": OP5, "op4_url_rules": OP4, "op7_mixing": OP7, "op10_histogram_shards": OP10}
