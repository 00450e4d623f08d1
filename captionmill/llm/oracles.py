"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dwin AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, dwin.k, i, item_id FROM dwin JOIN win ON dwin.k = win.k AND dwin.t = win.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
  SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, source, cast(len(ws) AS BIGINT) AS n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    cast(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, cast(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
h AS (SELECT source, cast(count(*) AS DOUBLE) AS n, cast(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS k, sum(f * f / n) AS q, (sum(f) + 0.5) / (sum(n) + 1) AS m FROM h),
v AS (SELECT *, (q - f * f / n) / n - (k - 1) / n * m * (1 - m) AS between_hosts FROM p),
z AS (SELECT m, CASE WHEN k <= 1 THEN 2.0 WHEN between_hosts <= 0 THEN 1000.0 ELSE least(greatest(m * (1 - m) / between_hosts - 1, 2.0), 1000.0) END AS strength FROM v),
ok AS (SELECT source, (f + m * strength) / (n + strength) <= 0.5 AS host_ok FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(host_ok, true) AS kept
FROM b LEFT JOIN ok USING (source)
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS g FROM (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM both_ JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
c AS (SELECT u AS doc_id, min(least(u, v)) AS c FROM reach GROUP BY u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, w.doc_id = coalesce(c.c, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP11 = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) AS s(k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY lang, k, g),
n AS (SELECT lang, cast(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS MATERIALIZED (SELECT *, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS tail FROM (SELECT lang, k, g, a, w, unnest(range(1, k)) AS cut FROM cand)),
heads AS MATERIALIZED (SELECT c.*, f.a AS l FROM cuts c JOIN f ON f.lang = c.lang AND f.g = c.head),
scored AS MATERIALIZED (
  SELECT c.*, f.a AS r, cast(1000000 * c.a::HUGEINT * c.a // (l::HUGEINT * f.a) AS BIGINT) AS score FROM heads c JOIN f ON f.lang = c.lang AND f.g = c.tail),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, g ORDER BY score, cut) = 1),
around AS (SELECT lang, g, max(a) AS most FROM (
  SELECT lang, a, array_to_string(w[1:2], ' ') AS g FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) GROUP BY lang, g),
kept AS (SELECT least.* FROM least LEFT JOIN around ON least.k = 2 AND least.lang = around.lang AND least.g = around.g WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""

# The shortest path as a recursion over a conversation's rows: the least (cost, labels) of each
# state of the role grammar, s0 at the start, s1 behind a system turn, s2 and s3 behind user and assistant.
_STEP = "struct_pack(c := {0}.c + {1}, l := {0}.l || '{2}')"
_FAR = "CASE WHEN {} THEN {} ELSE struct_pack(c := CAST(1000000000 AS BIGINT), l := '') END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _edit(state: str, cost: str, label: str, when: str) -> str:
    return _FAR.format(when, _STEP.format(state, cost, label))


_KEPT = {r: f"fault IN ('', 'truncated') AND initial = '{r}'" for r in "sua"}
_MADE, _LATE = "fault IN ('', 'truncated')", "(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END)"
_TO_USER = [_edit(s, *e) for s in ("i0", "i1", "i3") for e in ((_LATE, "K", _KEPT["u"]), (f"2 + {_LATE}", "R", _MADE))]
_I2 = _least("s2", *[_STEP.format(s, 2, "I") for s in ("s0", "s1", "s3")])
_I3 = _least("s3", _STEP.format("s2", 2, "I"), *[_STEP.format(s, 4, "II") for s in ("s0", "s1")])
_CRC = "xor(list_reduce(list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: list_reduce(range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(h, c)), CAST(4294967295 AS BIGINT)), 4294967295)"

OP13 = rf"""
WITH RECURSIVE h AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations),
d AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM d),
r AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(core, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
w(conv_id, n, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), struct_pack(c := CAST(0 AS BIGINT), l := ''), z, z, z FROM (SELECT DISTINCT conv_id, struct_pack(c := CAST(1000000000 AS BIGINT), l := '') AS z FROM r)
  UNION ALL SELECT conv_id, n, {_STEP.format("i0", 3, "D")}, {_least(_STEP.format("i1", 3, "D"), _edit("i0", _LATE, "K", _KEPT["s"]))}, {_least(_STEP.format("i2", 3, "D"), *_TO_USER)},
    {_least(_STEP.format("i3", 3, "D"), _edit("i2", _LATE, "K", _KEPT["a"]), _edit("i2", "2 + " + _LATE, "R", _MADE))}
  FROM (SELECT w.conv_id, r.n, r.initial, r.fault, s0 AS i0, s1 AS i1, {_I2} AS i2, {_I3} AS i3 FROM w JOIN r ON r.conv_id = w.conv_id AND r.n = w.n + 1)),
e AS MATERIALIZED (SELECT conv_id, {_least("s0", _I3)} AS best FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
p AS MATERIALIZED (SELECT conv_id, best.l AS audit, unnest(string_split(best.l, '')) AS label, unnest(range(length(best.l))) AS pos FROM e WHERE best.l <> ''),
q AS (SELECT conv_id, label, pos, sum(CASE WHEN label <> 'I' THEN 1 ELSE 0 END) OVER v AS n, sum(CASE WHEN label <> 'D' THEN 1 ELSE 0 END) OVER v - 1 AS place, (length(audit) - length(replace(audit, 'D', ''))) AS gone, length(audit) AS size FROM p WINDOW v AS (PARTITION BY conv_id ORDER BY pos)),
t AS (SELECT q.conv_id, string_agg(CASE WHEN label = 'K' THEN role ELSE CASE WHEN (place + (size - gone) % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN label = 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS said FROM q LEFT JOIN r ON r.conv_id = q.conv_id AND r.n = q.n WHERE label <> 'D' GROUP BY q.conv_id),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.l, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f USING (conv_id) LEFT JOIN e USING (conv_id) LEFT JOIN t USING (conv_id)
"""
