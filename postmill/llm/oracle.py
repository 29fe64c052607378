"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH split AS (
  SELECT page_id, url, html,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parts) p
  JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
  GROUP BY page_id
), junk AS (
  SELECT DISTINCT host || path AS key FROM parts WHERE len(regexp_extract_all(html, '[#*$%]{3}')) >= 20
)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.rule_verdict, CASE WHEN j.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  j.key IS NOT NULL AS listed
FROM parts p LEFT JOIN fits f USING (page_id) LEFT JOIN junk j ON j.key = p.host || p.path
"""

OP3 = r"""
WITH d AS (
  SELECT source, lang, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM documents
), kept AS (
  SELECT source, lang, regexp_replace(text, '[#*$%&|<>]+', ' ', 'g') AS text FROM d WHERE w >= 20
)
SELECT source, lang, 'words-1' AS tokenizer, count(*) AS n_docs,
  CAST(sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens
FROM kept GROUP BY source, lang
UNION ALL
SELECT source, lang, 'pieces-1', count(*),
  CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))) AS BIGINT)
FROM kept GROUP BY source, lang
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT doc_id, sum(n - 1) AS n_dup_lines, sum(n) AS n_lines FROM (
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line
  ) GROUP BY doc_id
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(8) t(k) GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, d.source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN inside USING (doc_id)
), judged AS (
  SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repeats, 10 * n_symbols > n_words AS symbols,
    100 * n_dup_lines > 30 * n_lines AS lines, word_chars < 3 * n_words OR word_chars > 10 * n_words AS lengths FROM measured
), failures AS (
  SELECT source, rule, count(*) AS n, sum(CAST(failed AS INT)) AS f FROM (
    SELECT source, unnest(['short', 'repeats', 'symbols', 'lines', 'lengths']) AS rule,
      unnest([short, repeats, symbols, lines, lengths]) AS failed FROM judged
  ) GROUP BY source, rule
), fitted AS (
  SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v, sum(n) AS total FROM failures GROUP BY rule
), prior AS (
  SELECT rule, m, greatest(1.0, least(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE total END, total)) AS s FROM fitted
), posterior AS (
  SELECT source, rule, m, s, n, (f + m * s) / (n + s) AS p FROM failures JOIN prior USING (rule)
), verdicts AS (
  SELECT source, bool_or(p - 2 * sqrt(p * (1 - p) / (n + s + 1)) > m + 2 * sqrt(m * (1 - m) / (s + 1))) AS host_failed,
    max(p) FILTER (rule = 'short') AS rate_short, max(p) FILTER (rule = 'repeats') AS rate_repeats,
    max(p) FILTER (rule = 'symbols') AS rate_symbols, max(p) FILTER (rule = 'lines') AS rate_lines,
    max(p) FILTER (rule = 'lengths') AS rate_lengths
  FROM posterior GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT host_failed AS kept, host_failed, round(rate_short, 9) AS rate_short,
  round(rate_repeats, 9) AS rate_repeats, round(rate_symbols, 9) AS rate_symbols, round(rate_lines, 9) AS rate_lines,
  round(rate_lengths, 9) AS rate_lengths
FROM judged j JOIN verdicts h ON j.source IS NOT DISTINCT FROM h.source
"""

OP13 = r"""
WITH lists AS (
  SELECT doc_id, list_transform(
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents
), size AS (
  SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM lists
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(list_transform(
      regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
    FROM benchmark) GROUP BY item_id, term
), pairs AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row_number() OVER () AS row, doc_id, len(w) AS n, unnest(w) AS term FROM lists)
  WHERE term IN (SELECT term FROM wanted) GROUP BY row, doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight
  FROM pairs, size GROUP BY term, n_docs
), impacts AS (
  SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS impact
  FROM pairs, size
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(times * weight * impact) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0
) WHERE rank <= 20
"""

STATEMENTS = {"op2_url_filter": OP2, "op3_token_rollup": OP3, "op8_quality_rules": OP8, "op13_ranked_search": OP13}
