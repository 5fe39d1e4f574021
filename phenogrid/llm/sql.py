"""DuckDB texts of the longer corpus queries."""

MANIFEST = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) AS crc
  FROM documents),
versions AS (
  SELECT doc_id, lang, 0 AS harmed, source, n_chars, text FROM docs
  UNION ALL
  SELECT doc_id, lang, 1, source, n_chars, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END FROM docs),
hashed AS (
  SELECT doc_id, lang, harmed, sha256(array_to_string(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text],
    lambda v: CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END), '')) AS leaf
  FROM versions),
leaves AS (SELECT doc_id, lang, leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM hashed WHERE harmed = 0),
depths AS (SELECT lang, (SELECT min(k) FROM range(12) t(k) WHERE 8 ** k >= n) AS depth FROM (SELECT lang, count(*) AS n FROM leaves GROUP BY lang)),
tree AS (
  SELECT lang, 0 AS level, pos, leaf AS node FROM leaves
  UNION ALL
  SELECT t.lang, t.level + 1, t.pos // 8, sha256(string_agg(t.node, '' ORDER BY t.pos))
  FROM tree t JOIN depths d ON t.lang IS NOT DISTINCT FROM d.lang WHERE t.level < d.depth GROUP BY t.lang, t.level, t.pos // 8),
subroots AS (
  SELECT t.lang, t.node AS subroot, d.depth, row_number() OVER (ORDER BY t.lang IS NOT NULL, encode(t.lang)) - 1 AS pos
  FROM tree t JOIN depths d ON t.lang IS NOT DISTINCT FROM d.lang AND t.level = d.depth),
crown AS (
  SELECT 0 AS level, pos, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM crown
  WHERE level < (SELECT min(k) FROM range(12) t(k) WHERE 8 ** k >= (SELECT count(*) FROM subroots)) GROUP BY level, pos // 8),
nodes AS (
  SELECT s.pos AS tree, t.level, t.pos, t.node FROM tree t JOIN subroots s ON t.lang IS NOT DISTINCT FROM s.lang WHERE t.level < s.depth
  UNION ALL
  SELECT -1, level, pos, node FROM crown WHERE level < (SELECT max(level) FROM crown)),
steps AS (
  SELECT l.doc_id, s.pos AS tree, k AS level, l.pos // CAST(8 ** k AS BIGINT) AS pos, k AS step FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, range(12) t(k) WHERE k < s.depth
  UNION ALL
  SELECT l.doc_id, -1, k, s.pos // CAST(8 ** k AS BIGINT), s.depth + k FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang, range(12) t(k) WHERE k < (SELECT max(level) FROM crown)),
runs AS (
  SELECT p.doc_id, p.step, coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (WHERE n.pos < p.pos), '') AS before,
    coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (WHERE n.pos > p.pos), '') AS after
  FROM steps p JOIN nodes n ON n.tree = p.tree AND n.level = p.level AND n.pos // 8 = p.pos // 8 GROUP BY p.doc_id, p.step),
fold AS (
  SELECT doc_id, 0 AS step, leaf AS node FROM hashed WHERE harmed = 1
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(r.before || f.node || r.after) FROM fold f JOIN runs r ON r.doc_id = f.doc_id AND r.step = f.step)
SELECT l.doc_id, l.leaf, s.subroot, c.node AS root, sha256(coalesce(string_agg(r.before || r.after, '' ORDER BY r.step), '')) AS proof_sha256,
  arg_max(f.node, f.step) AS folded_root, arg_max(f.node, f.step) = c.node AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN (SELECT node FROM crown ORDER BY level DESC LIMIT 1) c ON true
JOIN fold f ON f.doc_id = l.doc_id LEFT JOIN runs r ON r.doc_id = l.doc_id AND r.step = f.step
GROUP BY l.doc_id, l.leaf, s.subroot, c.node"""

REPAIR = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
drawn AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS draw
  FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, (VALUES (1), (2)) t(copy) WHERE draw <> 0 AND (copy = 1 OR draw = 3)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS time FROM ordered),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN time > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id),
added(st, to_st, cost, edits) AS (VALUES (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 2, 0, ''), (2, 3, 2, 'I'), (2, 2, 4, 'II'), (3, 3, 0, ''), (3, 2, 2, 'I'), (3, 3, 4, 'II')),
edited(st, initial, to_st, cost, edit) AS (
  VALUES (0, '', 0, 3, 'D'), (1, '', 1, 3, 'D'), (2, '', 2, 3, 'D'), (3, '', 3, 3, 'D'), (0, '*', 2, 2, 'R'), (1, '*', 2, 2, 'R'), (2, '*', 3, 2, 'R'), (3, '*', 2, 2, 'R'),
    (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (3, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K')),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, '000000000' AS best FROM facts
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.to_st,
    min(printf('%09d', CAST(substr(w.best, 1, 9) AS INTEGER) + a.cost + e.cost + CASE WHEN e.edit <> 'D' AND j.fault = 'truncated' THEN 1 ELSE 0 END) || substr(w.best, 10) || a.edits || e.edit)
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
  JOIN added a ON a.st = w.st JOIN edited e ON e.st = a.to_st AND (e.edit = 'D' OR j.fault NOT IN ('blank', 'duplicate') AND e.initial IN ('*', j.initial))
  GROUP BY w.conv_id, w.i, e.to_st),
solved AS (
  SELECT f.conv_id, min(printf('%09d', CAST(substr(w.best, 1, 9) AS INTEGER) + a.cost) || substr(w.best, 10) || a.edits) AS best
  FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = f.n JOIN added a ON a.st = w.st AND a.to_st IN (0, 3) GROUP BY f.conv_id),
play AS (
  SELECT conv_id, 0 AS p, 0::BIGINT AS i, 0 AS st, CAST(NULL AS VARCHAR) AS line, substr(best, 10) AS audit FROM solved
  UNION ALL
  SELECT y.conv_id, y.p + 1, y.i + CASE WHEN y.edit = 'I' THEN 0 ELSE 1 END, y.then_st,
    CASE y.edit WHEN 'K' THEN j.role || ':' || j.text WHEN 'R' THEN y.then_role || ':' || j.text WHEN 'I' THEN y.then_role || ':' END, y.audit
  FROM (SELECT x.*, CASE WHEN x.edit = 'D' THEN x.st WHEN x.edit = 'K' AND x.initial = 's' THEN 1 WHEN x.edit = 'K' AND x.initial = 'u' THEN 2 WHEN x.edit = 'K' THEN 3 WHEN x.st = 2 THEN 3 ELSE 2 END AS then_st, CASE WHEN x.st = 2 THEN 'assistant' ELSE 'user' END AS then_role
    FROM (SELECT p.*, substr(p.audit, p.p + 1, 1) AS edit, r.initial FROM play p LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 WHERE p.p < length(p.audit)) x) y
  LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM y.conv_id AND j.i = y.i + 1),
texts AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY p), '')) AS repaired_sha256 FROM play GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
  CAST(coalesce(CAST(substr(s.best, 1, 9) AS BIGINT), 0) AS BIGINT) AS cost, coalesce(substr(s.best, 10), '') AS audit, coalesce(t.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""
