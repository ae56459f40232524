"""SQL twins of the queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

# Windows of every item looked up at every place of every document.
OP4 = r"""
WITH item_words AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS words
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT r, i, size, item FROM places JOIN windows USING (size, words)),
hit_words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS place FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS listed FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN items USING (r)
"""
# All 200-byte windows, as hex text, and the runs that the repeated ones cover.
OP2 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
hexed AS (SELECT r, doc_id, lower(hex(b)) AS h, CAST(octet_length(b) AS BIGINT) AS n FROM docs),
windows AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT r, h, unnest(range(0, n - 199)) AS i FROM hexed WHERE n >= 200)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY w) AS c FROM windows) WHERE c > 1),
edges AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS first FROM repeated),
runs AS (
  SELECT r, min(i) AS start, max(i) + 200 AS stop
  FROM (SELECT r, i, sum(first) OVER (PARTITION BY r ORDER BY i) AS run FROM edges) GROUP BY r, run),
kept_before AS (SELECT r, start, stop, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS since FROM runs),
parts AS (
  SELECT r, sum(stop - start) AS gone, count(*) AS spans, max(stop) AS last,
    string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (start - since) AS BIGINT)), '' ORDER BY start) AS head
  FROM kept_before JOIN hexed USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE head || substr(h, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM hexed LEFT JOIN parts USING (r)
"""
# Base counts, and the line rules by the same patterns.
OP8 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)),
repeats AS (
  SELECT r, count(DISTINCT place) AS n
  FROM (SELECT r, unnest(range(i, i + 8)) AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM windows) WHERE c > 1) GROUP BY r),
split AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs),
counted AS (
  SELECT r, line, place, greatest(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')), 1) AS words,
    length(line) - length(regexp_replace(line, '[#*$%&<>]', '', 'g')) AS symbols,
    len(regexp_extract_all(line, '[!?]{2,}')) AS marks,
    len(regexp_extract_all(line, '(?:[|»›•·→]|\x20/\x20|\x20>\x20)')) AS separators
  FROM split),
judged AS (
  SELECT r, line, place,
    symbols > 0.3 * words OR marks > 0.3 * words OR (separators >= 3 AND separators > 0.2 * words)
      OR (words <= 40 AND regexp_matches(line, '(?i)\b(?:all rights reserved|cookies? (?:policy|settings|to improve)|we use cookies|privacy policy|terms of (?:use|service)|licensed under|copyright (?:\(c\)|©|\d{4})|enable javascript|click here|sign (?:in|up) (?:to|for|now)|subscribe to|share (?:this|on)|follow us|powered by|skip to (?:main )?content)\b')) AS fails,
    regexp_matches(line, '[^\x20\x09-\x0D]') AS worded
  FROM counted),
per_doc AS (
  SELECT r, count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup_lines,
    length(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT fails), '')) AS n_chars_kept
  FROM judged GROUP BY r),
figures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, length(t) AS n_chars, CAST(n_chars_kept AS BIGINT) AS n_chars_kept
  FROM docs JOIN per_doc USING (r) LEFT JOIN repeats USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_chars_kept >= 0.5 * n_chars AS kept, n_chars_kept
FROM figures
"""

# Cuts by units of each text; forms by joining its three parts in their order.
OP12 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM docs),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
# Scores of all documents that share a term with an item.
OP13 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM texts WHERE len(w) > 0),
corpus AS (SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS terms FROM docs),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, corpus GROUP BY term),
items AS (
  SELECT DISTINCT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wanted AS (SELECT item_id, w, term, count(*) AS times FROM (SELECT item_id, w, unnest(w) AS term FROM items) GROUP BY item_id, w, term),
scored AS (
  SELECT item_id, w.w, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // terms)))) AS BIGINT) AS score
  FROM wanted w JOIN postings USING (term) JOIN weights USING (term) JOIN docs USING (r), corpus GROUP BY item_id, w.w, r),
placed AS (
  SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id, s.w ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored s JOIN docs USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

ORACLE_SQL = {"op2_suffix_dedup": OP2, "op4_winnowing": OP4, "op8_quality_rules": OP8, "op12_fill_in_middle": OP12, "op13_lexical_search": OP13}
