"""Glossary matches, seams of overlapping transcripts, short texts found in long ones, and alignment by sound, over the driver's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glossary, transcripts
from .bindings import CUES, cues, spread, table
from .registry import query

#: Longest word that is spelled letter by letter.
_SPELLED = 3


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of turns as units; a word of three Latin letters at most is spoken letter by letter."""
    words = cues(spark, sf_dir).select("doc_id", "idx", "speaker", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("pos", "word"))
    letters = F.when(F.col("word").rlike(f"^[A-Za-z]{{1,{_SPELLED}}}$"), F.regexp_extract_all("word", F.lit("."), F.lit(0))).otherwise(F.array("word"))
    units = words.select("doc_id", "idx", "speaker", "pos", F.posexplode(letters).alias("letter", "text"))
    return units.select("doc_id", "idx", "speaker", (F.col("pos") * (_SPELLED + 1) + F.col("letter")).cast("long").alias("n"), "text")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary of the benchmark's words and pairs of neighbouring words, of two to eight letters, in their order."""
    w = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    both = F.expr("concat(w, transform(if(size(w) > 1, sequence(1, size(w) - 1), cast(array() AS array<int>)), k -> concat(w[k - 1], ' ', w[k])))")
    form = w.select(F.explode(both).alias("source")).distinct().where("length(replace(source, ' ', '')) BETWEEN 2 AND 8")
    return form.select(F.col("source").alias("place"), "source", F.upper("source").alias("standard"), F.array(F.regexp_replace("source", " ", "-")).alias("aliases"), F.lit(True).alias("enabled"))


@query(rf"""
WITH RECURSIVE {CUES},
u AS (SELECT doc_id, idx, speaker, CAST(pos * {_SPELLED + 1} + unnest(range(len(t))) AS BIGINT) AS n, unnest(t) AS text FROM (SELECT *, CASE WHEN regexp_matches(word, '^[A-Za-z]{{1,{_SPELLED}}}$') THEN regexp_extract_all(word, '.') ELSE [word] END AS t
  FROM (SELECT doc_id, idx, speaker, unnest(regexp_extract_all(text, '[^\s]+')) AS word, unnest(range(len(regexp_extract_all(text, '[^\s]+')))) AS pos FROM cues))),
b AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
f AS (SELECT DISTINCT source FROM (SELECT unnest(w) AS source FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM b) WHERE length(replace(source, ' ', '')) BETWEEN 2 AND 8),
a AS (SELECT replace(source, ' ', '') AS alias, upper(min(source)) AS canonical FROM f GROUP BY alias),
l AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^[A-Za-z]$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, idx, speaker ORDER BY n) AS run FROM u),
r AS (SELECT doc_id, idx, speaker, run, string_agg(text, '' ORDER BY n) AS said, list(n ORDER BY n) AS ns FROM l WHERE regexp_matches(text, '^[A-Za-z]$') GROUP BY doc_id, idx, speaker, run),
m(doc_id, idx, speaker, run, said, ns, k, size, canonical) AS (
  SELECT doc_id, idx, speaker, run, said, ns, CAST(1 AS BIGINT), CAST(0 AS BIGINT), '' FROM r
  UNION ALL
  SELECT doc_id, idx, speaker, run, said, ns, k + size, len, hit FROM (SELECT m.*, length(a.alias) AS len, a.canonical AS hit, row_number() OVER (PARTITION BY doc_id, idx, speaker, run ORDER BY length(a.alias) DESC) AS best
    FROM m JOIN a ON substr(lower(said), k + size, length(a.alias)) = a.alias) WHERE best = 1)
SELECT doc_id, idx, speaker, ns[k] AS first_n, ns[k + size - 1] AS last_n, canonical, array_to_string(string_split(substr(said, k, size), ''), ' ') AS source FROM m WHERE size > 0""")
def join_glossary_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.longest_matches(spelled(spark, sf_dir), glossary.alias_map(entries(spark, sf_dir)), ["doc_id", "idx", "speaker"])


#: Words of a chunk of a recording, and of the overlap of two neighbours.
_CHUNK, _OVERLAP = 60, 20


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring chunks of each document's words; the right one repeats the left one's last words."""
    w = spread(table(spark, sf_dir, "documents"), "doc_id").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)).alias("w"))
    step = _CHUNK - _OVERLAP
    k = w.withColumn("k", F.explode(F.expr(f"sequence(0, greatest(0, (size(w) - {_OVERLAP} - 1) div {step} - 1))")))
    part = lambda at: F.array_join(F.slice("w", at * step + 1, _CHUNK), " ")
    return k.select("doc_id", F.col("k").cast("long").alias("k"), part(F.col("k")).alias("left"), part(F.col("k") + 1).alias("right"))


_TOKEN = transcripts.TOKEN.replace("'", "''")


@query(rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, k, array_to_string(w[k * {_CHUNK - _OVERLAP} + 1 : k * {_CHUNK - _OVERLAP} + {_CHUNK}], ' ') AS l, array_to_string(w[(k + 1) * {_CHUNK - _OVERLAP} + 1 : (k + 1) * {_CHUNK - _OVERLAP} + {_CHUNK}], ' ') AS r
  FROM (SELECT *, unnest(range(0, greatest(0, (len(w) - {_OVERLAP} - 1) // {_CHUNK - _OVERLAP} - 1) + 1)) AS k FROM w)),
t AS (SELECT doc_id, k, list_transform(regexp_extract_all(l, '{_TOKEN}'), lambda x: lower(replace(x, '’', ''''))) AS l, list_transform(regexp_extract_all(r, '{_TOKEN}'), lambda x: lower(replace(x, '’', ''''))) AS r FROM c),
a AS (SELECT doc_id, k, unnest(l) AS x, unnest(range(len(l))) AS i FROM t), b AS (SELECT doc_id, k, unnest(r) AS x, unnest(range(len(r))) AS j FROM t),
s AS (SELECT a.doc_id, a.k, i, j FROM a JOIN b ON a.doc_id = b.doc_id AND a.k = b.k AND a.x = b.x),
h AS (SELECT s.* FROM s ANTI JOIN s p ON s.doc_id = p.doc_id AND s.k = p.k AND s.i = p.i + 1 AND s.j = p.j + 1),
e AS (SELECT s.* FROM s ANTI JOIN s q ON s.doc_id = q.doc_id AND s.k = q.k AND s.i = q.i - 1 AND s.j = q.j - 1),
g AS (SELECT h.doc_id, h.k, h.i, h.j, min(e.i) - h.i + 1 AS size FROM h JOIN e ON h.doc_id = e.doc_id AND h.k = e.k AND h.i - h.j = e.i - e.j AND e.i >= h.i GROUP BY h.doc_id, h.k, h.i, h.j),
o AS (SELECT g.*, len(l) + len(r) AS n, len(l) - i - size + j AS away, len(l) - i - size AS rest FROM g JOIN t ON t.doc_id = g.doc_id AND t.k = g.k),
p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY size * n - 3 * away DESC, i, j) = 1),
f AS (SELECT t.doc_id, t.k, len(l) AS nl, len(r) AS nr, p.*, CASE WHEN len(l) = 0 OR len(r) = 0 THEN 10000 WHEN p.size IS NULL THEN 0 ELSE CAST(floor(least(1.0::DOUBLE, size / 8::DOUBLE * 0.65::DOUBLE + greatest(0, n - away) / n::DOUBLE * 0.35::DOUBLE) * 10000 + 0.5::DOUBLE) AS BIGINT) END AS confidence FROM t LEFT JOIN p ON p.doc_id = t.doc_id AND p.k = t.k)
SELECT doc_id, k, CASE WHEN nl = 0 THEN 'right_only' WHEN nr = 0 THEN 'left_only' WHEN size IS NULL THEN 'no_anchor' WHEN size >= 3 AND confidence >= 4500 THEN 'merged' ELSE 'weak_anchor' END AS status,
  confidence, coalesce(size, 0) AS matched, i AS left_at, j AS right_at, rest AS left_rest, j AS right_rest FROM f""")
def aln_merge_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.seams(chunks(spark, sf_dir), ["doc_id", "k"])


@query(None)
def aln_merged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the texts that neighbouring chunks make."""
    return transcripts.merged(chunks(spark, sf_dir), ["doc_id", "k"]).select("doc_id", "k", "status", F.sha2("text", 256).alias("text_sha256"))


def recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as recordings of 400 ms a word, and locators: of every 50 words those from the sixth to the 35th."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"]).withColumn("w", F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0)))
    k = docs.where(F.size("w") > 0).select("doc_id", "w", F.explode(F.expr("sequence(0, (size(w) - 1) div 50)")).alias("part"))
    text = F.array_join(F.slice("w", F.col("part") * 50 + 6, 30), " ")
    parts = k.select("doc_id", F.col("part").cast("long").alias("part"), text.alias("text"), (F.col("part") * 20_000).cast("long").alias("start_ms"), F.least((F.col("part") + 1) * 20_000, F.size("w") * 400).cast("long").alias("end_ms"))
    return docs.select("doc_id", "text", (F.size("w") * 400).cast("long").alias("total_ms")), parts


@query(None)
def aln_locate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = transcripts.located(*recordings(spark, sf_dir), ["doc_id"])
    return transcripts.with_cuts(got, ["doc_id"]).drop("n", "expected_end")


_KEY = "translate(lower({0}), '" + transcripts.TONED + "', '" + transcripts.TONELESS + "')"


@query(rf"WITH {CUES}, w AS (SELECT doc_id, idx, speaker, unnest(regexp_extract_all(text, '[^\s]+')) AS word, CAST(unnest(range(len(regexp_extract_all(text, '[^\s]+')))) AS BIGINT) AS pos FROM cues) SELECT doc_id, idx, speaker, pos, CASE WHEN regexp_matches({_KEY.format('word')}, '^[a-zçêëâîïôûœæñß]+$') THEN {_KEY.format('word')} END AS sound FROM w")
def fn_phonetic_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = cues(spark, sf_dir).select("doc_id", "idx", "speaker", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("pos", "word"))
    return words.select("doc_id", "idx", "speaker", F.col("pos").cast("long").alias("pos"), transcripts.sound_key(F.col("word")).alias("sound"))


#: Tokens of a span that is aligned by sound.
_SPAN = 12


@query(rf"""
WITH RECURSIVE {CUES},
s AS (SELECT doc_id, idx, speaker, unnest(list_filter(string_split_regex(text, '[.!?\n]+'), lambda x: regexp_matches(x, '[^\s]'))) AS sentence, unnest(range(len(list_filter(string_split_regex(text, '[.!?\n]+'), lambda x: regexp_matches(x, '[^\s]'))))) AS k FROM cues),
w AS (SELECT doc_id, idx, speaker, k, regexp_extract_all(sentence, '[^\s,;:]+')[1:{_SPAN}] AS a, lead(regexp_extract_all(sentence, '[^\s,;:]+')[1:{_SPAN}]) OVER (PARTITION BY doc_id, idx, speaker ORDER BY k) AS b FROM s),
p AS (SELECT *, [CASE WHEN regexp_matches({_KEY.format('x')}, '^[a-zçêëâîïôûœæñß]+$') THEN {_KEY.format('x')} END FOR x IN a] AS sa, [CASE WHEN regexp_matches({_KEY.format('x')}, '^[a-zçêëâîïôûœæñß]+$') THEN {_KEY.format('x')} END FOR x IN b] AS sb FROM w WHERE b IS NOT NULL),
d(doc_id, idx, speaker, k, a, b, sa, sb, c, cost, steps) AS (
  SELECT doc_id, idx, speaker, k, a, b, sa, sb, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) FROM p
  UNION ALL
  SELECT doc_id, idx, speaker, k, a, b, sa, sb, c + 1, list_append(cost, CASE WHEN i = 0 THEN 4 * j WHEN j = 0 THEN 4 * i ELSE least(x, y, z) END),
    list_append(steps, CASE WHEN i = 0 THEN repeat('i', j) WHEN j = 0 THEN repeat('d', i) WHEN x <= y AND x <= z THEN steps[c - m] || CASE WHEN a[i] = b[j] THEN 'e' ELSE 'r' END WHEN y <= z THEN steps[c - m + 1] || 'd' ELSE steps[c] || 'i' END)
  FROM (SELECT *, cost[c - m] + CASE WHEN a[i] = b[j] THEN 0 WHEN sa[i] = sb[j] THEN 1 ELSE 4 END AS x, cost[c - m + 1] + 4 AS y, cost[c] + 4 AS z FROM (SELECT *, len(b) + 1 AS m, c // (len(b) + 1) AS i, c % (len(b) + 1) AS j FROM d) WHERE c < (len(a) + 1) * m))
SELECT doc_id, idx, speaker, CAST(k AS BIGINT) AS k, cost[-1] AS cost, steps[-1] AS steps FROM d WHERE c = (len(a) + 1) * (len(b) + 1)""")
def aln_phonetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of each sentence of a turn against those of the next one."""
    key = ["doc_id", "idx", "speaker"]
    sentences = F.filter(F.split("text", r"[.!?\n]+"), lambda x: x.rlike(r"[^\s]"))
    words = lambda c: F.transform(F.slice(F.regexp_extract_all(c, F.lit(r"[^\s,;:]+"), F.lit(0)), 1, _SPAN), lambda x: F.struct(x.alias("text"), transcripts.sound_key(x).alias("sound")))
    pairs = cues(spark, sf_dir).select(*key, sentences.alias("s")).where(F.size("s") > 1).select(*key, F.explode(F.expr("transform(sequence(1, size(s) - 1), k -> named_struct('k', cast(k - 1 AS bigint), 'a', s[k - 1], 'b', s[k]))")).alias("p"))
    spans = pairs.select(*key, "p.k", words(F.col("p.a")).alias("a"), words(F.col("p.b")).alias("b"))
    return transcripts.aligned(spans).select(*key, "k", "cost", "steps")


@query(r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS term FROM benchmark), t AS (SELECT term, regexp_matches(term, '^[A-Z]') AS exact FROM w)
SELECT DISTINCT d.doc_id, t.term, t.exact FROM documents d JOIN t ON CASE WHEN t.exact THEN contains(d.text, t.term) ELSE contains(lower(d.text), lower(t.term)) END""")
def filter_glossary_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's longer words that stand in a document's text; capitalised ones as they are written."""
    words = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)))
    terms = table(spark, sf_dir, "benchmark").select(words.alias("term")).distinct().withColumn("exact", F.col("term").rlike("^[A-Z]"))
    return glossary.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), terms, ["doc_id"])
