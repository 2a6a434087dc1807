"""SQL forms of the training-data queries, for those that SQL can express."""

ORACLE: dict[str, str] = {
    "op2_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('0:' || doc_id::VARCHAR) AS k
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE number % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS most FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(w) OVER (ORDER BY most::DOUBLE / w, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY most::DOUBLE / w, number) AS place FROM weighed),
targets AS (
  SELECT l.*, least(most::DOUBLE, coalesce((SELECT arg_min(level, place) FROM levels WHERE most::DOUBLE / w > level), 'inf'::DOUBLE) * w) AS target FROM levels l),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
    coalesce(sum(s.size) OVER (PARTITION BY t.number ORDER BY s.k, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
epochs AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS e FROM placed)
SELECT doc_id, size, source_size, target, (e * size + greatest(0, least(size, goal - e * source_size - before)))::BIGINT AS taken FROM epochs
""",
    "op3_quality": r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
counted AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM counted, range(0, 3) AS r(j) WHERE c > 1 GROUP BY rid),
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM lines LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM b
""",
    "op13_merkle": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, unnest([false, true]) AS altered,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id::VARCHAR END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source)::VARCHAR || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang)::VARCHAR || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars::VARCHAR END AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents),
hashed AS (
  SELECT rid, doc_id, source, altered, xor(crc, 4294967295) % 5 = 0 AND text IS NOT NULL AS chosen,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text)::VARCHAR || ':'
      || CASE WHEN altered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END END) AS digest
  FROM docs),
leaves AS (
  SELECT h.rid, h.doc_id, h.source, h.digest AS leaf, CASE WHEN a.chosen THEN a.digest ELSE h.digest END AS start,
    row_number() OVER (PARTITION BY h.source ORDER BY h.doc_id NULLS FIRST, h.digest) - 1 AS place
  FROM hashed h JOIN hashed a USING (rid) WHERE NOT h.altered AND a.altered),
low AS (
  SELECT source, 0 AS level, place, leaf AS digest, count(*) OVER (PARTITION BY source) AS held FROM leaves
  UNION ALL
  SELECT source, any_value(level) + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (any_value(held) + 15) // 16
  FROM low WHERE held > 1 GROUP BY source, place // 16),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM low WHERE held = 1),
high AS (
  SELECT 0 AS level, place, subroot AS digest, count(*) OVER () AS held FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 16, sha256(string_agg(digest, '' ORDER BY place)), (any_value(held) + 15) // 16
  FROM high WHERE held > 1 GROUP BY place // 16),
nodes AS (
  SELECT source, level, place, digest, held FROM low WHERE held > 1
  UNION ALL
  SELECT s.source, 100 + level, h.place, h.digest, h.held FROM high h, subroots s WHERE h.held > 1),
sided AS (
  SELECT source, level, place, held,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, place // 16 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, place // 16 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes),
levels AS (
  SELECT source, level, row_number() OVER (PARTITION BY source ORDER BY level) AS step FROM (SELECT DISTINCT source, level FROM nodes)),
walked AS (
  SELECT l.rid, l.source, 0::BIGINT AS step, l.start AS node, '' AS proof FROM leaves l
  UNION ALL
  SELECT w.rid, w.source, w.step + 1, sha256(d.before || w.node || d.after), w.proof || d.before || d.after
  FROM walked w JOIN leaves l ON l.rid = w.rid JOIN subroots s ON s.source IS NOT DISTINCT FROM w.source
  JOIN levels v ON v.source IS NOT DISTINCT FROM w.source AND v.step = w.step + 1
  JOIN sided d ON d.source IS NOT DISTINCT FROM w.source AND d.level = v.level
    AND d.place = CASE WHEN v.level < 100 THEN l.place // (16 ** v.level)::BIGINT ELSE s.place // (16 ** (v.level - 100))::BIGINT END)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = r.digest AS verified
FROM leaves l JOIN (SELECT rid, arg_max(proof, step) AS proof, arg_max(node, step) AS node FROM walked GROUP BY rid) w USING (rid)
JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source, (SELECT digest FROM high WHERE held = 1) r
""",
}
