"""SQL, for DuckDB, that gives the rows of those queries of the corpus operators that SQL can express."""

FILTER_AUDIT = r"""
WITH read AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM read),
failing AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM words),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
marked AS (
  SELECT part, fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n
  FROM failing LEFT JOIN told USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS l, left(filter_order, step - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)),
met AS (
  SELECT part, filter_order, step, l, n, good, toxic, fails = l AS only_own, contains(fails, l) AS own,
    len(list_filter(string_split(before, ''), lambda x: x <> '' AND contains(fails, x))) > 0 AS gone
  FROM marked, steps),
counted AS (
  SELECT part, filter_order, step, l,
    coalesce(sum(n) FILTER (WHERE NOT own AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE own AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE own AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE only_own), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (WHERE own AND NOT gone AND good), 0)::BIGINT AS good_lost,
    coalesce(sum(n) FILTER (WHERE own AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM counted
"""

SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
spread AS (SELECT k, lang, source, unnest(w) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM spread GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT DISTINCT k, lang, term FROM spread) GROUP BY ALL HAVING count(*) >= 3),
langs AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
given AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n FROM groups g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v))::BIGINT AS p
  FROM given JOIN langs USING (lang)),
whole AS (SELECT lang, term, sum(n) AS n FROM given GROUP BY ALL),
base AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v))::BIGINT AS q
  FROM whole JOIN langs USING (lang)),
summed AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM shares JOIN base USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
