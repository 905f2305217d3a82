"""SQL for the chat formatting query."""

WINDOWS = r"""
WITH base AS (
  SELECT coalesce(conv_id, 0) AS conv, conv_id IS NOT NULL AS known, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    coalesce(CAST(floor(turn / 256) AS BIGINT), -4611686018427387904) AS block
  FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) t),
shaped AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) + 22 AS chars,
    len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9 \t-\r]')) + 8 AS tokens
  FROM base),
heads AS (
  SELECT conv, known, block AS first_block, turn AS system_turn, CASE WHEN role = 'system' THEN text END AS system, CASE WHEN role = 'system' THEN tokens END AS system_tokens,
    CASE WHEN role = 'system' THEN chars END AS system_chars
  FROM shaped QUALIFY row_number() OVER (PARTITION BY conv, known ORDER BY turn NULLS FIRST, role, text) = 1),
dealt AS (
  SELECT conv, known, block, turn, role, text, chars, tokens, true AS own FROM shaped
  UNION ALL
  SELECT conv, known, block + 1, turn, role, text, chars, tokens, false FROM shaped s
  WHERE ((turn % 256) + 256) % 256 >= 248
    AND EXISTS (SELECT 1 FROM shaped o WHERE o.conv = s.conv AND o.known = s.known AND o.block = s.block + 1)),
summed AS (
  SELECT d.*, h.system_chars, h.first_block,
    coalesce(role = 'system' AND text = h.system AND d.turn IS NOT DISTINCT FROM h.system_turn, false) AS is_system, greatest(1024 - 192 - coalesce(h.system_tokens, 0), 2) // 2 AS width,
    CAST(coalesce(sum(tokens) OVER (PARTITION BY d.conv, d.known, block ORDER BY turn NULLS FIRST, role, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p
  FROM dealt d JOIN heads h ON h.conv = d.conv AND h.known = d.known),
spanned AS (
  SELECT *, system_chars IS NOT NULL AND block = first_block AND p = 0 AS opens,
    2 * (p // width) + CAST(tokens > width AS BIGINT) AS span FROM summed),
spans AS (
  SELECT conv, known, block, span, min(p) AS p, arg_min(turn, p) AS turn, arg_min(opens, p) AS opens,
    any_value(system_chars) AS system_chars, sum(chars) AS chars
  FROM spanned WHERE own GROUP BY conv, known, block, span),
history AS (
  SELECT s.conv, s.known, s.block, s.span, sum(h.chars) AS chars
  FROM spans s JOIN spanned h ON h.conv = s.conv AND h.known = s.known AND h.block = s.block
    AND h.p >= s.p - 192 AND h.p < s.p AND NOT h.is_system AND coalesce(h.turn >= s.turn - 8, true)
  GROUP BY ALL),
formatted AS (
  SELECT s.conv, s.known,
    sum(s.chars + coalesce(h.chars, 0) + CASE WHEN s.opens THEN 0 ELSE coalesce(s.system_chars, 0) END) AS chars
  FROM spans s LEFT JOIN history h ON h.conv = s.conv AND h.known = s.known AND h.block = s.block AND h.span = s.span
  GROUP BY s.conv, s.known),
whole AS (
  SELECT conv, known, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS targets
  FROM base GROUP BY conv, known)
SELECT CASE WHEN w.known THEN w.conv END AS conv_id, w.n_turns, w.turns_sha256, length(w.targets) AS loss_chars,
  sha256(w.targets) AS loss_sha256, CAST(f.chars AS BIGINT) AS formatted_chars
FROM whole w JOIN formatted f ON f.conv = w.conv AND f.known = w.known
"""
