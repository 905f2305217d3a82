"""SQL for the line dedup query."""

# leaf and template are written out where the operator has hashes of them
DROPPED_LINES = r"""
WITH written AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS written,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
  FROM documents),
parsed AS (
  SELECT doc_id, text, line, list_filter(string_split(translate(written, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' '),
    lambda x: x <> '') AS tokens FROM written),
masked AS (
  SELECT doc_id, text, line, list_transform(tokens, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens
  FROM parsed WHERE len(tokens) >= 1),
leafed AS (
  SELECT *, concat_ws(' ', len(tokens), tokens[1], tokens[2], tokens[3]) AS leaf FROM masked),
fields AS (
  SELECT doc_id, line, leaf, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM leafed),
leaves AS (SELECT leaf, count(*) AS n FROM leafed GROUP BY leaf),
common AS (
  SELECT f.leaf, f.place, f.token, 100 * count(*) >= 10 * any_value(l.n) AS wide
  FROM fields f JOIN leaves l ON f.leaf = l.leaf WHERE f.token <> '<*>' GROUP BY f.leaf, f.place, f.token HAVING count(*) >= 5),
templates AS (
  SELECT f.doc_id, f.line, r.rule,
    string_agg(CASE WHEN c.wide IS NULL OR r.rule = 'wide' AND NOT c.wide THEN '<*>' ELSE f.token END, ' ' ORDER BY f.place) AS template,
    count(*) FILTER (WHERE c.wide OR r.rule = 'known' AND c.wide IS NOT NULL) AS constants, count(*) AS n
  FROM fields f LEFT JOIN common c ON f.leaf = c.leaf AND f.place = c.place AND f.token = c.token
    CROSS JOIN (VALUES ('known'), ('wide')) r(rule)
  GROUP BY f.doc_id, f.line, r.rule),
placed AS (
  SELECT DISTINCT l.doc_id, l.line, l.text, l.leaf, t.template
  FROM leafed l JOIN templates t ON l.doc_id = t.doc_id AND l.line = t.line WHERE t.constants >= 0.5 * t.n),
again AS (
  SELECT leaf, template, min(struct_pack(doc_id := doc_id, line := line)) AS first
  FROM placed GROUP BY leaf, template HAVING count(DISTINCT text) >= 5),
gone AS (
  SELECT p.doc_id, list(DISTINCT p.line) AS lines FROM placed p JOIN again a ON p.leaf = a.leaf AND p.template = a.template
  WHERE struct_pack(doc_id := p.doc_id, line := p.line) <> a.first GROUP BY p.doc_id),
kept AS (
  SELECT w.doc_id, string_agg(w.written, chr(10) ORDER BY w.line) AS text
  FROM written w LEFT JOIN gone g ON w.doc_id = g.doc_id
  WHERE g.lines IS NULL OR NOT list_contains(g.lines, w.line) GROUP BY w.doc_id)
SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, CAST(coalesce(len(g.lines), 0) AS BIGINT) AS n_dropped,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
