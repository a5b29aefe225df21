"""The corpus queries again as SQL, where SQL can express them. No statement calls anything of the operators."""

from __future__ import annotations

BLANK = r"[\x20\x09-\x0D]+"

_CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")


def _escaped_length(x: str) -> str:
    found = " + ".join(f"(length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in _CONTROL)
    return f"(length({x}) + length({x}) - length(replace({x}, chr(8291), '')) + 2 * ({found}))"


CHAT = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(12 + {_escaped_length("role")} + length(role) - length(replace(role, chr(10), '')) + 1 + {_escaped_length("text")} + 11) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

#: Which templates of the two kinds recur, from all lines; a line's fields are numbered from 1.
LINES = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
t AS (
  SELECT doc_id, i, list_transform(list_filter(string_split_regex(line, '{BLANK}'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
  FROM l),
f AS (
  SELECT doc_id, i, len(t) AS n, len(t) || ' ' || array_to_string(t[1:4], ' ') AS head, CASE WHEN len(t) > 4 THEN len(t) || ' tail ' || array_to_string(t[len(t) - 3:], ' ') END AS tail,
    list_transform(range(0, 9), lambda k: CAST(floor(k * len(t) / 8.0) AS INT)) AS b,
    list_transform(range(0, 8), lambda k: array_to_string(t[CAST(floor(k * len(t) / 8.0) AS INT) + 1 : CAST(floor((k + 1) * len(t) / 8.0) AS INT)], ' ')) AS fields
  FROM t WHERE len(t) > 0),
m AS (SELECT [a, b] AS mask FROM (SELECT unnest(range(1, 9)) AS a) x, (SELECT unnest(range(1, 9)) AS b) y WHERE a < b),
z AS (SELECT *, list_filter(range(1, 9), lambda k: b[k + 1] > 4 AND b[k + 1] > b[k]) AS free FROM f),
v AS (
  SELECT z.*, mask FROM z JOIN m ON len(free) > 2 AND list_contains(free, mask[1]) AND list_contains(free, mask[2])
  UNION ALL SELECT z.*, free FROM z WHERE len(free) <= 2),
o AS (
  SELECT doc_id, i, n, n - list_sum(list_transform(mask, lambda k: b[k + 1] - b[k])) AS fixed,
    md5(head || chr(10) || array_to_string(mask, ',') || chr(10) || array_to_string(list_transform(range(1, 9), lambda k: CASE WHEN list_contains(mask, k) THEN '' ELSE fields[k] END), chr(10))) AS template
  FROM v),
e AS (SELECT doc_id, i, n, b, fields, head AS leaf FROM f UNION ALL SELECT doc_id, i, n, b, fields, tail FROM f WHERE tail IS NOT NULL),
u AS (SELECT doc_id, i, leaf, n, unnest(range(1, 9)) AS k, unnest(fields) AS content, unnest(list_transform(range(1, 9), lambda k: b[k + 1] - b[k])) AS size FROM e),
c AS (SELECT leaf, k, content FROM u WHERE size > 0 GROUP BY leaf, k, content HAVING count(DISTINCT doc_id) >= 10),
p AS (
  SELECT doc_id, i, any_value(n) AS n, sum(u.size) AS fixed, md5(leaf || chr(10) || 'learned' || chr(10) || string_agg(k || ' ' || content, chr(10) ORDER BY k)) AS template
  FROM u JOIN c USING (leaf, k, content) GROUP BY doc_id, i, leaf),
n AS (SELECT doc_id, i, template FROM (SELECT * FROM o UNION ALL SELECT * FROM p) WHERE coalesce(fixed, n) = n OR fixed >= 8 AND 2 * fixed >= n),
g AS (SELECT DISTINCT doc_id, i FROM n WHERE template IN (SELECT template FROM n GROUP BY template HAVING count(DISTINCT doc_id) >= 10))
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_dropped, sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""

TOPK = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_PLAIN = f"list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]+', '', 'g'), '{BLANK}'), lambda x: x <> '')"

#: By windows alone: no mask stands in it. Two texts that agree in four of five words of a window share two neighbouring words there.
OVERLAPS = f"""
WITH d AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
dp AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] AS p FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
bp AS (SELECT item_id, i, w[i] || ' ' || w[i + 1] AS p FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM b)),
h AS (
  SELECT DISTINCT doc_id, item_id, dp.i - bp.i AS shift FROM dp JOIN bp USING (p)
  UNION SELECT doc_id, item_id, u.i - 1 FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM d) u JOIN b ON len(b.w) = 1 AND b.w[1] = u.x),
v AS (
  SELECT h.doc_id, h.item_id, shift, d.w AS dw, b.w AS bw, least(12, len(b.w)) AS wide, unnest(range(0, len(b.w) - least(12, len(b.w)) + 1)) AS st
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id)),
c AS (
  SELECT doc_id, item_id, wide, shift + st AS doc_word, st AS item_word,
    len(list_filter(range(0, wide), lambda k: shift + st + k >= 0 AND dw[shift + st + k + 1] = bw[st + k + 1])) AS matched
  FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, doc_word, item_word) AS n FROM c WHERE matched >= ceil(wide * 0.8))
SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, CAST(doc_word AS INTEGER) AS doc_word, CAST(item_word AS INTEGER) AS item_word FROM r WHERE n = 1
"""

REPEATS = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d)
SELECT d.doc_id, any_value(len(d.w)) AS n_words, count(g.k) AS n_removed,
  sha256(coalesce(string_agg(t.x, ' ' ORDER BY t.k) FILTER (g.k IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN g ON t.doc_id = g.doc_id AND t.k = g.k GROUP BY d.doc_id
"""

_BYTE = "strpos('123456789ABCDEF', h[2 * i + 1]) * 16 + strpos('123456789ABCDEF', h[2 * i + 2])"

#: CRC-32 spelled out: a table of 256 entries by its rule, then one step per byte of each distinct word.
RESAMPLE = f"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
f AS (SELECT doc_id, unnest(w) AS x FROM d),
u AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM b)),
y AS (SELECT x, list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST({_BYTE} AS BIGINT))) AS bytes FROM u),
k AS (SELECT x, xor(list_reduce(bytes, lambda c, v: xor(c // 256, t[CAST(xor(c % 256, v) AS INT) + 1])), 4294967295) % 10000 AS bucket FROM y, tab),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (x) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f) AS S, (SELECT count(*) FROM b) AS T),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (n.S + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (n.T + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM f JOIN k USING (x) JOIN g USING (bucket) GROUP BY doc_id),
h AS (SELECT doc_id, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT::DOUBLE AS h FROM d),
r AS (
  SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h.h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (doc_id) JOIN h ON d.doc_id = h.doc_id),
z AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN z.rank <= z.n * 10 // 100 THEN z.rank END AS rank FROM r LEFT JOIN z ON r.doc_id = z.doc_id
"""

#: By first failing filter of each order; no coalitions and no least squares.
AUDIT = f"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '{BLANK}'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > c.first THEN 'E' ELSE '' END AS fails
  FROM d JOIN c USING (text) LEFT JOIN l USING (doc_id)),
q AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE a.f <> b.f AND a.f <> c.f AND a.f <> d.f AND a.f <> e.f AND b.f <> c.f AND b.f <> d.f AND b.f <> e.f AND c.f <> d.f AND c.f <> e.f AND d.f <> e.f),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
p AS (
  SELECT part, filter_order, step, filter_order[step] AS f, n, good, toxic, fails = filter_order[step] AS sole,
    contains(fails, filter_order[step]) AS fail, len(list_filter(range(1, step), lambda i: contains(fails, filter_order[i]))) > 0 AS gone
  FROM q, s),
y AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND fail THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN sole THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND fail THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fail THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM p GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM y
"""

ORACLES = {
    "op4_chat": CHAT, "op6_lines": LINES, "op7_topk": TOPK, "op8_decontaminate": OVERLAPS, "op9_repeats": REPEATS,
    "op11_resample": RESAMPLE, "op13_filter_audit": AUDIT,
}
