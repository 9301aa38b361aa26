"""DuckDB SQL for the rows of ``op11_importance``."""

#: The CRC-32 of each distinct word by its table of 256 entries, which follows from the
#: polynomial 0xEDB88320; a word's bytes come from its hexadecimal digits.
SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b)),
texts AS (
  SELECT 0 AS side, rowid_ AS r, doc_id, text FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS (
  SELECT side, r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts),
hexes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
coded AS (
  SELECT word, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(h)::BIGINT, 2), lambda i: ('0x' || h[i:i+1])::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexes, crc_table),
counts AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN coded USING (word) GROUP BY bucket),
totals AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts, totals),
weights AS (
  SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM words JOIN coded USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM placed
UNION ALL
SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
"""
