"""DuckDB twins of the registered queries that SQL can express."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL: dict[str, str] = {}

SQL["op9_ngram_jaccard_join"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(ws) >= 4
         THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], chr(1)))
         WHEN len(ws) > 0 THEN [array_to_string(ws, chr(1))] ELSE [] END) AS g
  FROM w
), n AS (
  SELECT d.doc_id, count(g) AS n_shingles FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * i >= 85 * (p.n_shingles + q.n_shingles - i)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r
)
SELECT n.doc_id, n.n_shingles, min(r) AS component_id
FROM n JOIN reach USING (doc_id) GROUP BY ALL
"""

SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
RULES = [  # verdict, host, path
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
_GLOBS = [  # glob, the same as a pattern over ".host/path"
    ("*casino*/**", "[^/]*casino[^/]*/.*"),
    ("*bets*/**", "[^/]*bets[^/]*/.*"),
    ("*poker*/**", "[^/]*poker[^/]*/.*"),
    ("*jackpot*/**", "[^/]*jackpot[^/]*/.*"),
    ("**/wp-login*", ".*/wp-login[^/]*"),
    ("**/cgi-bin/**", ".*/cgi-bin/.*"),
    ("**.exe", ".*\\.exe"),
    ("**.zip", ".*\\.zip"),
    ("**/tag/?*/page/**", ".*/tag/.[^/]*/page/.*"),
]
_GLOB_ROWS = ", ".join(f"({i}, '{g}', '{p}')" for i, (g, p) in enumerate(_GLOBS))
SQL["op1_url_filters"] = f"""
WITH rules(verdict, h, p) AS (VALUES {', '.join(str(r) for r in RULES)}),
globs(i, gl, pattern) AS (VALUES {_GLOB_ROWS}),
parts AS (
  SELECT page_id, coalesce(contains(url, '://'), false) AS ok,
         regexp_replace(url, '^.*?://', '', 's') AS rest FROM pages
), urls AS (
  SELECT page_id,
    CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') ELSE '' END AS host,
    CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM parts
), found AS (
  SELECT u.*,
    (SELECT arg_min({{'rule': h || p, 'verdict': verdict}}, (-length(h || p), verdict <> 'block', h || p)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r,
    (SELECT arg_min(gl, i) FROM globs WHERE regexp_full_match('.' || host || path, pattern, 's')) AS g
  FROM urls u
)
SELECT page_id, host, path, r.rule AS rule,
       CASE WHEN r IS NOT NULL THEN r.verdict WHEN g IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN r IS NULL THEN g END AS "glob"
FROM found
"""

SQL["op3_mixing_sources"] = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS total,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), k AS (  -- the level is the largest that any set of stopped sources allows
  SELECT *, sum(3 * total) OVER w - 3 * total AS capped, (SELECT sum(weight) FROM s) - sum(weight) OVER w + weight AS free
  FROM s WINDOW w AS (ORDER BY 3 * total / weight, source IS NULL, source)
), level AS (SELECT max(((SELECT sum(total) FROM s) - capped) / free) AS l FROM k),
t AS (
  SELECT source, total::BIGINT AS source_size, least(3 * total, weight * l) AS target FROM s, level
), p AS (
  SELECT d.*, source_size, target,
         (sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS served,
         CASE WHEN source_size > 0 THEN floor(floor(target) / source_size)::BIGINT ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, floor(target)::BIGINT - passes * source_size - served))::BIGINT AS part FROM p
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + part)::BIGINT AS taken, served,
       CASE WHEN passes * size + part > 0 THEN
         (CASE WHEN part > 0 THEN passes * source_size + served + part
               ELSE (passes - 1) * source_size + served + size END) / target END AS finish
FROM q
"""

SQL["op7_quality_rules"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents
), grams AS (
  SELECT rid, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), hits AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + o) AS n FROM hits, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid
), lines AS (
  SELECT rid, source, family, line, count(*) AS times
  FROM (SELECT rid, source, list_max(list_transform(ws, lambda w: {{'n': length(w), 'w': w}})).w AS family,
               unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE len(regexp_extract_all(line, '{WORD}')) > 0 GROUP BY ALL
), own AS (SELECT rid, sum(times) - count(*) AS dup FROM lines GROUP BY rid),
normal AS (
  SELECT DISTINCT rid, source, family,
    translate(trim(regexp_replace(translate(line, '{UPPER}', '{UPPER.lower()}'), '[\\x20\\x09-\\x0D]+', ' ', 'g')), '123456789', '000000000') AS line
  FROM lines
), furniture AS (
  SELECT source, line FROM normal GROUP BY source, line
  HAVING count(*) > 20 AND 2 * count(DISTINCT family) >= count(*)
), lost AS (
  SELECT rid, sum(CASE WHEN f.line IS NOT NULL THEN len(string_split(n.line, ' ')) ELSE 0 END)::DOUBLE
            / sum(len(string_split(n.line, ' '))) AS removed
  FROM normal n LEFT JOIN furniture f ON n.line = f.line AND n.source IS NOT DISTINCT FROM f.source GROUP BY rid
), s AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(t, {SPACES}, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM d LEFT JOIN repeats USING (rid) LEFT JOIN own USING (rid) LEFT JOIN lost USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 - removed >= 0.5 AS kept
FROM s
"""

SQL["op8_chat_formatting"] = """
WITH RECURSIVE m AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (
  SELECT conv_id, min(turn) AS turn, conv_id || '-' || turn AS call_id FROM m WHERE role = 'user' GROUP BY conv_id, m.turn
), results AS (
  SELECT conv_id, min(turn) AS turn, conv_id || '-' || (turn - 1) AS call_id FROM m WHERE role = 'assistant' GROUP BY conv_id, m.turn
), needs AS (
  SELECT c.conv_id, c.call_id, c.conv_id || '-' || (c.turn - 2) AS need_id FROM calls c WHERE c.turn >= 2
), lost AS (
  SELECT n.* FROM needs n LEFT JOIN calls c ON c.conv_id = n.conv_id AND c.call_id = n.need_id WHERE c.call_id IS NULL
), levels AS (
  SELECT c.conv_id, c.call_id, 0 AS level FROM calls c
  LEFT JOIN (SELECT * FROM needs EXCEPT SELECT * FROM lost) n ON n.conv_id = c.conv_id AND n.call_id = c.call_id
  WHERE n.need_id IS NULL
  UNION ALL
  SELECT n.conv_id, n.call_id, l.level + 2 FROM levels l JOIN needs n ON n.conv_id = l.conv_id AND n.need_id = l.call_id
)
SELECT m.conv_id, m.turn, 'call' AS kind, m.conv_id || '-' || m.turn AS call_id,
  CASE WHEN lost.call_id IS NOT NULL THEN 'unresolved' WHEN r.call_id IS NULL THEN 'open' ELSE 'linked' END AS status,
  m.text IS NOT NULL AS valid, l.level,
  '{"arguments":{' || CASE WHEN m.turn >= 2 THEN '"after":' || to_json('$' || m.conv_id || '-' || (m.turn - 2)) || ',' ELSE '' END
    || CASE WHEN m.text IS NOT NULL THEN '"prompt":' || to_json(m.text) || ',' ELSE '' END
    || '"turn":' || m.turn || '},"id":' || to_json(m.conv_id || '-' || m.turn) || ',"name":"answer","type":"call"}' AS json
FROM m LEFT JOIN lost ON lost.conv_id = m.conv_id AND lost.call_id = m.conv_id || '-' || m.turn
LEFT JOIN results r ON r.conv_id = m.conv_id AND r.call_id = m.conv_id || '-' || m.turn
LEFT JOIN levels l ON l.conv_id = m.conv_id AND l.call_id = m.conv_id || '-' || m.turn
WHERE m.role = 'user'
UNION ALL
SELECT m.conv_id, m.turn, 'result', m.conv_id || '-' || (m.turn - 1),
  CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'linked' END, true, l.level + 1,
  '{"content":' || coalesce(to_json(m.text), 'null') || ',"id":' || to_json(m.conv_id || '-' || (m.turn - 1)) || ',"type":"result"}'
FROM m LEFT JOIN calls c ON c.conv_id = m.conv_id AND c.call_id = m.conv_id || '-' || (m.turn - 1)
LEFT JOIN levels l ON l.conv_id = m.conv_id AND l.call_id = m.conv_id || '-' || (m.turn - 1)
WHERE m.role = 'assistant'
UNION ALL
SELECT conv_id, turn, 'message', NULL, 'plain', true, 0,
  '{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || ',"type":"message"}'
FROM m WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

_UNIT = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
SQL["op11_fill_in_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u,
         list_transform(range(4), lambda i:
           ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1 + 8 * i, 8))::BIGINT) AS h
  FROM documents
), c AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a,
         greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
              ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

SQL["op12_filter_interaction_audit"] = f"""
WITH m AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY 1
), t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS e
  FROM documents
), d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN e THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN m USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM d GROUP BY 1, 2
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, i AS step, filter_order[i] AS f, filter_order[:i - 1] AS before, filter_order[:i] AS upto
  FROM o, range(1, 6) r(i)
), g AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN translate(fails, upto, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN bad ELSE 0 END) AS toxic_lost
  FROM cells, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM g
"""
