"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from . import bottom_k, divergence, dual_tree, imatch, licenses

_LOWER = "translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def words(text: str) -> str:
    return _WORDS.format(t=text)


def op1() -> str:
    subs = ", ".join(f"CASE WHEN len(list_filter(k, lambda t: substr(md5(t), {i}, 1) >= '5')) > 0 THEN substr(md5(array_to_string(list_filter(k, lambda t: substr(md5(t), {i}, 1) >= '5'), ' ')), 1, 16) ELSE substr(md5(array_to_string(k, ' ')), 1, 16) END" for i in range(1, imatch.LEXICONS + 1))
    kept = "list_sort(list_distinct(CASE WHEN len(list_intersect(w, lex)) > 0 THEN list_intersect(w, lex) ELSE w END))"
    same = f"len(list_filter(range(1, {imatch.LEXICONS} + 1), lambda i: {{a}}[i] = {{b}}[i])) / {float(imatch.LEXICONS)}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT d.*, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after FROM d),
e AS (SELECT *, length(text) // 2 AS half FROM n),
x AS (SELECT *, left(text, length(text) - half) || left(after, half) AS edited FROM e),
df AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct({words("text")})) AS w FROM d) GROUP BY w),
lx AS (SELECT coalesce(list(w), CAST([] AS VARCHAR[])) AS lex FROM df WHERE n >= (SELECT count(*) FROM d) * CAST({imatch.RARE} AS DOUBLE) AND n <= (SELECT count(*) FROM d) * CAST({imatch.COMMON} AS DOUBLE)),
t AS (SELECT text, {words("text")} AS w FROM (SELECT text FROM d UNION SELECT edited FROM x)),
k AS (SELECT text, {kept} AS k FROM t, lx),
f AS (SELECT text, [{subs}] AS fp FROM k)
SELECT x.doc_id, CAST(length(x.text) AS BIGINT) AS n_chars, sha256(x.edited) AS edited_sha256, array_to_string(a.fp, '-') AS fingerprint,
 array_to_string(b.fp, '-') AS edited_fingerprint, {same.format(a="a.fp", b="b.fp")} AS near_edited, {same.format(a="a.fp", b="c.fp")} AS near_next
FROM x JOIN f a ON a.text = x.text JOIN f b ON b.text = x.edited JOIN f c ON c.text = x.after"""


OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
   (((strpos('0123456789abcdef', substr(p.h, CAST(i * 5 // 4 AS INTEGER) + 1, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(p.h || '0', CAST(i * 5 // 4 AS INTEGER) + 2, 1)) - 1, 0)) >> (3 - i * 5 % 4)) % 32 + 1, 1)), '') AS payload_digest,
 CASE WHEN p.page_id IS DISTINCT FROM g.last AND g.last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN p.page_id IS DISTINCT FROM g.last THEN g.last END AS refers_to
FROM p JOIN g USING (h)"""


def op3() -> str:
    base = [f"list_filter(range(0, greatest(len(w) - {len(p.split()) - 1}, 0)), lambda i: array_to_string(list_slice(w, i + 1, i + {len(p.split())}), ' ') = '{p}')" for _, p in licenses.PHRASES]
    own = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(licenses.PHRASES))
    templates = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')))" for label, t in licenses.TEMPLATES)
    return f"""
WITH t(label, ws) AS (VALUES {templates}),
d AS (SELECT doc_id, text, {words("text")} AS w FROM documents),
p AS (SELECT *, {", ".join(f"{b} AS p{k}" for k, b in enumerate(base))} FROM d),
b AS (SELECT doc_id, text, w, list_concat(p0, p1, p2) AS pl, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM p),
l AS (SELECT doc_id, list_distinct({words("line")}) AS lw FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
m AS (SELECT l.doc_id, t.label, len(list_intersect(l.lw, t.ws)) / CAST(len(t.ws) AS DOUBLE) AS score FROM l, t WHERE len(list_intersect(l.lw, t.ws)) >= ceil({licenses.CONTAINMENT} * len(t.ws) - 1e-9)),
g AS (SELECT doc_id, list(DISTINCT label) AS more, max(score) AS best FROM m GROUP BY doc_id)
SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(pl) AS BIGINT) AS n_base, CAST(list_min(pl) AS BIGINT) AS first_word, CAST(list_max(pl) AS BIGINT) AS last_word,
 array_to_string(list_sort(own), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(own, coalesce(more, [])))), ',') AS labels,
 CASE WHEN len(pl) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM b LEFT JOIN g ON b.doc_id = g.doc_id"""


OP8 = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS k FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i, source_size * 2 AS cap FROM t),
x AS (SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS wt FROM w),
y AS (SELECT *, row_number() OVER o AS o, coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  coalesce(sum(wt) OVER (ORDER BY CAST(cap AS DOUBLE) / wt, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM x WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / wt, i)),
z AS (SELECT *, (CAST((SELECT sum(source_size) FROM t) AS DOUBLE) * CAST(1.5 AS DOUBLE) - CAST(capped AS DOUBLE)) / CAST((SELECT sum(wt) FROM x) - used AS DOUBLE) AS level FROM y),
l AS (SELECT arg_min(level, o) AS level FROM z WHERE wt * level < cap),
g AS (SELECT source, source_size, CASE WHEN l.level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), wt * l.level) END AS target FROM z, l),
h AS (SELECT *, least(CAST(floor(target / greatest(source_size, 1)) AS BIGINT), 2) AS whole FROM g),
c AS (SELECT source, k, sum(size) AS n FROM s GROUP BY source, k),
b AS (SELECT source, k, n, sum(n) OVER (PARTITION BY source ORDER BY k) - n AS before FROM c)
SELECT s.doc_id, s.size, h.source_size, h.target,
  s.size * least(h.whole + CASE WHEN h.target - h.whole * h.source_size > 0 AND b.before + b.n / 2.0 <= h.target - h.whole * h.source_size THEN 1 ELSE 0 END, 2) AS taken
FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source JOIN b ON s.source IS NOT DISTINCT FROM b.source AND s.k = b.k"""



def op11() -> str:
    return f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {dual_tree.POSITIVES}),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {dual_tree.LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {dual_tree.MOST} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {dual_tree.NEGATIVES}"""


def op12() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format(t="text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS s FROM d),
k AS (SELECT s, row_number() OVER () AS k FROM (SELECT DISTINCT s FROM s WHERE len(s) > 0)),
e AS (SELECT k, len(s) AS n, unnest(s) AS t FROM k),
l AS (SELECT a.k AS u, b.k AS v FROM e a JOIN e b ON a.t = b.t AND a.k < b.k AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {bottom_k.SIMILARITY} GROUP BY a.k, b.k, a.n, b.n
  HAVING count(*) * 100 >= (a.n + b.n - count(*)) * {bottom_k.SIMILARITY}),
b AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT k AS u, k AS v FROM k UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u),
i AS (SELECT k.k, min(s.doc_id) AS id FROM k JOIN s ON k.s = s.s GROUP BY k.k),
c AS (SELECT r.u AS k, min(i.id) AS component_id FROM r JOIN i ON i.k = r.v GROUP BY r.u),
o AS (SELECT s.doc_id, len(s.s) AS n, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component_id END AS component_id FROM s LEFT JOIN k ON k.s = s.s LEFT JOIN c ON c.k = k.k)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o"""


def op13() -> str:
    p = "1 + CAST({n} + " + str(divergence.ADDED) + " AS HUGEINT) * " + str(divergence.SCALE) + " // ({t} + " + str(divergence.ADDED) + " * {v})"
    return rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row, {_LOWER.format(t="text")} AS text FROM documents),
t AS (SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.LEAST_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n) AS t FROM k GROUP BY lang),
c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, source, t.term),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS t FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format(n="coalesce(c.n, 0)", t="g.t", v="l.v")} AS p, {p.format(n="k.n", t="l.t", v="l.v")} AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM f WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= {divergence.TERMS}"""


ORACLE_SQL = {"op1_fingerprints": op1(), "op2_warc": OP2, "op3_licenses": op3(), "op8_mixing": OP8, "op11_hard_negatives": op11(), "op12_minhash": op12(), "op13_divergence": op13()}
