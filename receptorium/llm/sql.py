"""SQL for the queries of this subpackage that SQL can express."""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key")
#: kind, expression, group, least length of the group
_SECRETS = (
    ("assign", rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 0, 1), ("github", "gh[opsur]_[A-Za-z0-9]{36}", 0, 40),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15), ("google", "AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 36))


def _kind(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: a running sum over what stands between the matches and the matches themselves."""
    return f"""
SELECT doc_id, {order} AS kind_order, '{kind}' AS kind, first_ + 1 - 1 AS start_, first_ + len(m) AS end_ FROM (
  SELECT doc_id, m, g, sum(len(p) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) - len(m) AS first_ FROM (
    SELECT doc_id, unnest(parts[:len(ms)]) AS p, unnest(ms) AS m, unnest(gs) AS g, unnest(range(len(ms))) AS i FROM (
      SELECT doc_id, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}', 0) AS ms, regexp_extract_all(text, '{pattern}', {group}) AS gs
      FROM documents WHERE text IS NOT NULL))) WHERE len(g) >= {least}"""


_SPANS = " UNION ALL ".join(_kind(i, *rule) for i, rule in enumerate(_SECRETS))

ORACLES = {
    "op2_trigram_secrets": f"""
WITH span AS ({_SPANS}),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start_ AS BIGINT) || ':' || CAST(end_ AS BIGINT), ',' ORDER BY start_, kind_order) FILTER (kind_order < 3) AS base,
         string_agg(kind || ':' || CAST(start_ AS BIGINT) || ':' || CAST(end_ AS BIGINT), ',' ORDER BY start_, kind_order) AS spans
  FROM span GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM documents d LEFT JOIN listed USING (doc_id)""",
    "op4_fm_decontaminate": r"""
WITH fold AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM fold),
phrase AS (
  SELECT DISTINCT id AS item_id, least(len(w), 10) AS size, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS p
  FROM words WHERE side = 'b' AND len(w) > 0),
place AS (
  SELECT d.id AS doc_id, s.size, s.pos, array_to_string(d.w[s.pos:s.pos + s.size - 1], ' ') AS p
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM words, (SELECT DISTINCT size FROM phrase) WHERE side = 'd' AND len(w) >= size) s
  JOIN words d ON d.id = s.id AND d.side = 'd'),
hit AS (SELECT doc_id, pos, size, item_id FROM place JOIN phrase USING (size, p)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS x FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON c.doc_id = w.id LEFT JOIN named n ON n.doc_id = w.id WHERE w.side = 'd'""",
    "op5_rule_ledger": r"""
WITH word AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([array_to_string(w[j:j + 2], ' ') FOR j IN range(1, len(w) - 1)]) AS t FROM word WHERE len(w) > 2),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM place) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT x) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS x FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
         FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM word) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([len(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '[0-9]')) AS n_digits
      FROM word LEFT JOIN cover USING (doc_id) LEFT JOIN line USING (doc_id)),
f AS (SELECT *, CAST(n_words < 50 AS BIGINT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS BIGINT) + 4 * CAST(10 * n_symbols > n_words AS BIGINT)
                + 8 * CAST(10 * n_upper > 3 * word_chars AS BIGINT) + 16 * CAST(100 * n_dup_lines > 50 * n_lines AS BIGINT)
                + 32 * CAST(word_chars > 20 * n_words AS BIGINT) + 64 * CAST(2 * n_digits > word_chars AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f""",
    "op12_set_relation_join": r"""
WITH RECURSIVE word AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT r, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) AS s FROM word WHERE len(w) > 0),
size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
pair AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
way AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT r, r AS m FROM word UNION SELECT reach.r, way.y FROM reach JOIN way ON way.x = reach.m)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN word w ON w.r = reach.r JOIN word o ON o.r = reach.m LEFT JOIN size ON size.r = w.r GROUP BY w.r, w.doc_id""",
    "op13_ida_repair": r"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')]),
                     lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda x, bit: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM conversations),
kind AS (SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS k FROM told),
live AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kind WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM live),
noted AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
         regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') AS open_end, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS last_initial,
         count(*) OVER (PARTITION BY conv_id) AS size FROM placed),
fault AS (SELECT *, blank OR again AS gone, CAST(open_end AND NOT again AS BIGINT) AS cut FROM noted),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         CAST(sum(cut) AS BIGINT) AS truncated, count(*) FILTER (last_initial || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM fault GROUP BY conv_id),
-- cheapest (cost, edits, lines) from every role state (0 start, 1 after system, 2 after user, 3 after assistant) to the end, from the last row backward
walk AS (
  SELECT conv_id, size AS i, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS s0, {'c': CAST(4 AS BIGINT), 'a': 'II', 't': E'\nuser:\nassistant:'} AS s1,
         {'c': CAST(2 AS BIGINT), 'a': 'I', 't': E'\nassistant:'} AS s2, {'c': CAST(0 AS BIGINT), 'a': '', 't': ''} AS s3 FROM (SELECT DISTINCT conv_id, size FROM fault)
  UNION ALL
  SELECT conv_id, i - 1, least(b0, {'c': b2.c + 2, 'a': 'I' || b2.a, 't': E'\nuser:' || b2.t}, {'c': b3.c + 4, 'a': 'II' || b3.a, 't': E'\nuser:\nassistant:' || b3.t}),
         least(b1, {'c': b2.c + 2, 'a': 'I' || b2.a, 't': E'\nuser:' || b2.t}, {'c': b3.c + 4, 'a': 'II' || b3.a, 't': E'\nuser:\nassistant:' || b3.t}),
         least(b2, {'c': b3.c + 2, 'a': 'I' || b3.a, 't': E'\nassistant:' || b3.t}),
         least(b3, {'c': b2.c + 2, 'a': 'I' || b2.a, 't': E'\nuser:' || b2.t})
  FROM (
    SELECT w.conv_id, w.i,
      least({'c': s0.c + 3, 'a': 'D' || s0.a, 't': s0.t}, {'c': s1.c + CASE WHEN NOT gone AND initial = 's' THEN cut ELSE big END, 'a': 'K' || s1.a, 't': line || s1.t},
            {'c': s2.c + CASE WHEN NOT gone AND initial = 'u' THEN cut ELSE big END, 'a': 'K' || s2.a, 't': line || s2.t}, {'c': s2.c + 2 + CASE WHEN gone THEN big ELSE cut END, 'a': 'R' || s2.a, 't': as_user || s2.t}) AS b0,
      least({'c': s1.c + 3, 'a': 'D' || s1.a, 't': s1.t}, {'c': s2.c + CASE WHEN NOT gone AND initial = 'u' THEN cut ELSE big END, 'a': 'K' || s2.a, 't': line || s2.t},
            {'c': s2.c + 2 + CASE WHEN gone THEN big ELSE cut END, 'a': 'R' || s2.a, 't': as_user || s2.t}) AS b1,
      least({'c': s2.c + 3, 'a': 'D' || s2.a, 't': s2.t}, {'c': s3.c + CASE WHEN NOT gone AND initial = 'a' THEN cut ELSE big END, 'a': 'K' || s3.a, 't': line || s3.t},
            {'c': s3.c + 2 + CASE WHEN gone THEN big ELSE cut END, 'a': 'R' || s3.a, 't': as_assistant || s3.t}) AS b2,
      least({'c': s3.c + 3, 'a': 'D' || s3.a, 't': s3.t}, {'c': s2.c + CASE WHEN NOT gone AND initial = 'u' THEN cut ELSE big END, 'a': 'K' || s2.a, 't': line || s2.t},
            {'c': s2.c + 2 + CASE WHEN gone THEN big ELSE cut END, 'a': 'R' || s2.a, 't': as_user || s2.t}) AS b3
    FROM walk w JOIN (SELECT conv_id, place, gone, cut, initial, CAST(1000000000 AS BIGINT) AS big, E'\n' || role || ':' || text AS line, E'\nuser:' || text AS as_user,
                             E'\nassistant:' || text AS as_assistant FROM fault) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.i)),
best AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, substr(s0.t, 2) AS lines FROM walk WHERE i = 0)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op11_pipelined_search": r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
item AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
word AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM doc),
posting AS (SELECT r, doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
size AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY r),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM posting, total GROUP BY term),
measure AS (SELECT r, 100 - 50 + ((50 * n * docs) // words) AS m FROM size, total),
asked AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM item),
scored AS (SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
           FROM asked JOIN weight USING (term) JOIN posting USING (term) JOIN measure USING (r) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
