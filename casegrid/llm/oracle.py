"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from casegrid.llm.line_rules import BOILERPLATE, NAVIGATION, Rules

#: Fixed value: words, as the operators take them.
WORDS = r"'[^ \t\n\x0B\f\r]+'"

_R = Rules()
_QUOTED = lambda text: "'" + text.replace("'", "''") + "'"
_NAV = ", ".join(map(_QUOTED, NAVIGATION))
_BOILER = " OR ".join(f"contains(lower(line), {_QUOTED(p)})" for p in BOILERPLATE)

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row_id, doc_id, text, regexp_extract_all(text, {WORDS}) AS ws FROM d),
grams AS (SELECT row_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
again AS (SELECT row_id, g FROM grams GROUP BY row_id, g HAVING count(*) > 1),
covered AS (SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest(range(i, i + 5)) AS j FROM grams JOIN again USING (row_id, g)) GROUP BY row_id),
lines AS (SELECT row_id, line, regexp_extract_all(line, {WORDS}) AS lw FROM (SELECT row_id, unnest(string_split(text, chr(10))) AS line FROM d)),
held AS (SELECT row_id, line, lw, len(lw) AS n FROM lines WHERE len(lw) > 0),
dups AS (SELECT row_id, sum(c - 1) AS n FROM (SELECT row_id, line, count(*) AS c FROM held GROUP BY row_id, line) GROUP BY row_id),
judged AS (SELECT row_id, list_sum(list_transform(lw, lambda x: length(x))) AS size,
   len(list_filter(lw, lambda x: x IN ('|', '>', '»', '•', '·'))) >= greatest(2, {_R.max_separators}::DOUBLE * n)
   OR (n <= 12 AND 2 * len(list_filter(lw, lambda x: lower(trim(x, '|>:,.')) IN ({_NAV}))) > n)
   OR (regexp_matches(line, '[!#*$%&|<>]') AND len(list_filter(lw, lambda x: regexp_matches(x, '[#*$%&|<>!?]{{2,}}|^[#*$%&|<>]+$'))) > {_R.max_noisy}::DOUBLE * n)
   OR (n > {_R.unpunctuated_words} AND NOT regexp_matches(line, '[.!?;:,"'')…»。]'))
   OR (n >= 8 AND len(list_filter(range(1, n), lambda i: lw[i] = lw[i + 1])) > {_R.max_stutter}::DOUBLE * n)
   OR ({_BOILER}) AS bad FROM held),
lost AS (SELECT row_id, sum(CASE WHEN bad THEN size ELSE 0 END) AS lost, count(*) AS n_lines, sum(bad::INT) AS n_bad FROM judged GROUP BY row_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
   coalesce(lost, 0) AS lost_chars, coalesce(n_lines, 0) AS n_lines, coalesce(n_bad, 0) AS n_bad_lines
   FROM w LEFT JOIN covered USING (row_id) LEFT JOIN dups USING (row_id) LEFT JOIN lost USING (row_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
   (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words) AS base_failed,
   NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words) AND lost_chars <= {_R.max_lost} * word_chars AS kept,
   lost_chars::BIGINT AS lost_chars, n_lines::BIGINT AS n_lines, n_bad_lines::BIGINT AS n_bad_lines FROM m
"""

OP9 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT node, min(seen) AS m FROM r GROUP BY 1) c ON c.node = w.doc_id
"""

_LETTERS = ", ".join(f"('{c}', {k})" for k, c in enumerate("ABCDE"))
OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS ws FROM documents),
k AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT text, min(doc_id) AS first FROM d GROUP BY 1),
v AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
   [len(ws) < 50, 100 * list_unique(ws) < 65 * len(ws), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > first OR (d.doc_id IS NULL AND first IS NOT NULL), false)] AS fails
   FROM d JOIN f USING (text) LEFT JOIN k ON k.doc_id = d.doc_id),
c AS (SELECT part, fails, good, toxic, count(*) AS n FROM v GROUP BY ALL),
l(letter, i) AS (VALUES {_LETTERS}),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS o
   FROM l a JOIN l b ON b.i <> a.i JOIN l c ON c.i NOT IN (a.i, b.i) JOIN l d ON d.i NOT IN (a.i, b.i, c.i) JOIN l e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
steps AS (SELECT filter_order, o, unnest(range(1, 6))::INT AS step FROM orders),
counted AS (SELECT part, filter_order, step, o[step] AS filter,
   sum(n) FILTER (NOT gone AND NOT f) AS kept, sum(n) FILTER (NOT gone AND f) AS removed, sum(n) FILTER (gone AND f) AS redundant,
   sum(n) FILTER (f AND fs = 1) AS unique_fails, sum(n) FILTER (NOT gone AND f AND good = 1) AS good_lost, sum(n) FILTER (NOT gone AND f AND toxic = 1) AS toxic_lost
   FROM (SELECT part, n, good, toxic, filter_order, step, o, fails[o[step] + 1] AS f, len(list_filter(fails, lambda x: x)) AS fs,
      len(list_filter(o[1:step - 1], lambda i: fails[i + 1])) > 0 AS gone FROM c, steps) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
   coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
   coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley FROM counted
"""

ORACLE = {"op11_filter_audit": OP11, "op3_line_rules": OP3, "op9_jaccard_join": OP9}
