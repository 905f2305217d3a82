"""SQL for the collocation query."""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece
  FROM documents),
worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces),
spans AS (
  SELECT w.lang, w.words, s.size, unnest(range(1, len(w.words) - s.size + 2)) AS spot
  FROM worded w CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS size) s WHERE len(w.words) >= s.size),
counts AS (
  SELECT lang, size, words[spot:spot + size - 1] AS phrase, count(*) AS f FROM spans GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE size > 1 AND f >= 30),
cuts AS (
  SELECT lang, size, phrase, f, unnest(range(1, size)) AS k FROM candidates),
scores AS (
  SELECT c.lang, c.phrase, c.f AS a, c.k, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.f) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.phrase[:c.k]
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.phrase[c.k + 1:]),
lowest AS (
  SELECT lang, phrase, a, l, r, score FROM scores
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT c.lang, c.f, c.phrase[p.spot:p.spot + p.size - 1] AS phrase
  FROM candidates c JOIN (SELECT * FROM (VALUES (2), (3)) s(size), (VALUES (1), (2), (3)) t(spot)) p
    ON p.size < c.size AND p.spot + p.size - 1 <= c.size),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase),
kept AS (
  SELECT s.lang, array_to_string(s.phrase, ' ') AS phrase, s.a, s.l, s.r, s.score
  FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
  WHERE g.f IS NULL OR 100 * g.f < 80 * s.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank,
  k.phrase, k.a, k.l, k.r, z.n, k.score
FROM kept k JOIN sizes z ON z.lang = k.lang
QUALIFY rank <= 2000
"""
