"""Queries over joins: as-of, intervals, grids, lexica, consensus, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import matching as M
from folioscope.plans.metrics import BOX, boxes
from folioscope.plans.registry import query, table
from folioscope.plans.text import lines, vocabulary

WORDS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents)"
LEXICON = f"lex AS (SELECT word, count(*) AS freq FROM {WORDS} GROUP BY word HAVING count(*) >= 3)"


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).where("freq >= 3")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS anchor FROM events
""")
def j25_last_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.last_before(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "signup", F.col("value")).select("event_id", "anchor")


@query("""
WITH i AS (SELECT s_suppkey AS id, s_acctbal AS start, s_acctbal + 150 AS "end" FROM supplier)
SELECT c_custkey, id FROM customer JOIN i ON start <= c_acctbal AND c_acctbal < "end"
""")
def j26_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("start"), (F.col("s_acctbal") + 150).alias("end"))
    return M.in_interval(table(spark, sf_dir, "customer"), "c_acctbal", spans, 100.0).select("c_custkey", "id")


@query(f"""
WITH {BOX}, c AS (SELECT page, pos, unnest(range(CAST(floor(x1 / 10) AS BIGINT), CAST(floor(x2 / 10) AS BIGINT) + 1)) AS cx, y1, y2 FROM ref),
d AS (SELECT page, pos, cx, unnest(range(CAST(floor(y1 / 10) AS BIGINT), CAST(floor(y2 / 10) AS BIGINT) + 1)) AS cy FROM c)
SELECT DISTINCT a.page, a.pos AS a, b.pos AS b FROM d a JOIN d b ON a.page = b.page AND a.cx = b.cx AND a.cy = b.cy AND a.pos < b.pos
""")
def j8_grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.grid_neighbours(boxes(spark, sf_dir)[0], "page", 10.0)


@query(f"""
WITH {BOX} SELECT p.page, p.pos AS point, arg_min(r.pos, ((r.x2 - r.x1) * (r.y2 - r.y1), r.pos)) AS box FROM pred p
JOIN ref r ON p.page = r.page AND p.x1 BETWEEN r.x1 AND r.x2 AND p.y1 BETWEEN r.y1 AND r.y2 GROUP BY p.page, p.pos
""")
def j37_smallest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, pred = boxes(spark, sf_dir)
    return M.smallest_containing(pred.select("page", F.col("pos").alias("point"), F.col("x1").alias("x"), F.col("y1").alias("y")), ref, "page")


@query(f"""
WITH {BOX}, m AS (SELECT b.page, b.pos AS board, n.pos AS line, CASE WHEN n.y1 >= b.y2 THEN 'below' WHEN n.y2 <= b.y1 THEN 'above' END AS side,
  CASE WHEN n.y1 >= b.y2 THEN n.y1 - b.y2 ELSE b.y1 - n.y2 END AS gap FROM ref b JOIN pred n ON b.page = n.page AND least(b.x2, n.x2) - greatest(b.x1, n.x1) > 0.25 * (b.x2 - b.x1)
  WHERE (n.y1 >= b.y2 OR n.y2 <= b.y1) AND CASE WHEN n.y1 >= b.y2 THEN n.y1 - b.y2 ELSE b.y1 - n.y2 END <= 0.35 * (b.y2 - b.y1))
SELECT page, board, side, arg_min(line, (gap, line)) AS line FROM m GROUP BY page, board, side
""")
def j24_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.captions(*boxes(spark, sf_dir), "page")


@query(f"WITH {LEXICON} SELECT doc_id, count(*) AS unknown FROM {WORDS} w WHERE NOT EXISTS (SELECT 1 FROM lex WHERE lex.word = w.word) GROUP BY doc_id")
def j15_unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))).alias("word"))
    # each document's words once, with their number: the lexicon comes of the same rows, so texts are split once
    counted = words.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    known = counted.groupBy("word").agg(F.sum("n").alias("freq")).where("freq >= 3")
    return M.unknown_words(counted, known).groupBy("doc_id").agg(F.sum("n").alias("unknown"))


@query(f"""
WITH {LEXICON}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
l AS (SELECT doc_id, word, regexp_replace(word, '[^\\p{{L}}]', '', 'g') AS x FROM w),
r AS (SELECT doc_id, CASE WHEN length(x) >= 3 AND x <> lower(x) AND x <> upper(x) AND NOT regexp_matches(x, '^\\p{{Lu}}[^\\p{{Lu}}]*$') THEN 'strange_case' WHEN lex.word IS NULL THEN 'unknown' END AS reason
  FROM l LEFT JOIN lex ON lower(l.word) = lex.word)
SELECT doc_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL
""")
def j16_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("word"))
    return M.suspects(words, lexicon(spark, sf_dir)).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH b AS (SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS word FROM part) GROUP BY 1),
n AS (SELECT 'x' || substr(word, 2) AS word FROM b UNION SELECT substr(word, 2) FROM b UNION SELECT word || 's' FROM b UNION SELECT substr(word, 1, length(word) - 2) FROM b UNION SELECT substr(word, 1, 1) FROM b),
u AS (SELECT word FROM n WHERE word NOT IN (SELECT word FROM b)),
c AS (SELECT u.word, b.word AS candidate, freq, levenshtein(u.word, b.word) AS d FROM u JOIN b ON levenshtein(u.word, b.word) <= greatest(1, length(u.word) // 3))
SELECT word, CAST(row_number() OVER (PARTITION BY word ORDER BY d, freq DESC, candidate) AS INT) AS place, candidate, CAST(d AS INT) AS distance FROM c QUALIFY place <= 3
""")
def j18_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the part types as lexicon; asked for are words that lack or change their initial, go on or end early."""
    known = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    w = F.col("word")
    made = F.array(F.concat(F.lit("x"), F.substring(w, F.lit(2), F.length(w))), F.substring(w, F.lit(2), F.length(w)), F.concat(w, F.lit("s")), F.substring(w, F.lit(1), F.length(w) - 2), F.substring(w, 1, 1))
    asked = known.select(F.explode(made).alias("word")).distinct()
    return M.suggestions(M.unknown_words(asked, known), known, 3)


@query(f"""
WITH {LEXICON.replace('lex AS (', 'lex AS MATERIALIZED (')}, u AS MATERIALIZED (SELECT DISTINCT w.word FROM {WORDS} w LEFT JOIN lex ON lex.word = w.word WHERE length(w.word) >= 4 AND lex.word IS NULL),
c AS MATERIALIZED (SELECT word, "at", substr(word, 1, "at") AS "left", substr(word, "at" + 1) AS "right" FROM (SELECT word, unnest(range(2, length(word) - 1)) AS "at" FROM u))
SELECT c.word, CAST("at" AS INT) AS "at", "left", "right" FROM c JOIN lex a ON a.word = "left" JOIN lex b ON b.word = "right"
""")
def j20_split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))).alias("word")).distinct()
    return M.split_words(words, lexicon(spark, sf_dir))


#: Lines of the documents broken after every fourth word; the last of these words, if long, in its middle with one of three hyphens.
BROKEN = """(SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, line FROM (
  SELECT doc_id, i, coalesce(substr(ws[4 * i], length(ws[4 * i]) // 2 + 1) || ' ', '') || array_to_string(ws[4 * i + 1:4 * i + 3], ' ')
    || CASE WHEN length(ws[4 * i + 4]) > 0 THEN ' ' || substr(ws[4 * i + 4], 1, length(ws[4 * i + 4]) // 2) || (['-', '‐', '‑'])[i % 3 + 1] ELSE '' END AS line
  FROM (SELECT doc_id, ws, unnest(range((len(ws) + 3) // 4)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS ws FROM documents))))"""


@query(f"""
WITH {LEXICON}, l AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM {BROKEN}),
j AS (SELECT doc_id, pos, regexp_extract(regexp_extract(line, '(\\S+)\\s*$', 1), '^(.*\\p{{L}})[{T.HYPHENS[1:]}-]+$', 1) AS a, regexp_extract(next, '^\\s*(\\S+)', 1) AS b FROM l),
w AS (SELECT doc_id, pos, lower(regexp_extract(a, '^[^\\p{{L}}]*(.*?)[^\\p{{L}}]*$', 1) || regexp_extract(b, '^[^\\p{{L}}]*(.*?)[^\\p{{L}}]*$', 1)) AS word FROM j WHERE a <> '' AND regexp_matches(b, '^\\p{{L}}'))
SELECT doc_id, pos, w.word FROM w JOIN lex ON lex.word = w.word
""")
def j19_joined_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the documents in lines of four, every long fourth word broken by one of the hyphens."""
    ws = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("ws"))
    word = lambda i: F.get("ws", i - 1)
    half = lambda w: F.floor(F.length(w) / 2).cast("int")
    i = F.col("i")
    rest = F.coalesce(F.concat(F.substring(word(4 * i), half(word(4 * i)) + 1, F.length(word(4 * i))), F.lit(" ")), F.lit(""))
    hyphen = F.element_at(F.array(*(F.lit(h) for h in T.HYPHENS)), (i % 3 + 1).cast("int"))
    end = F.when(F.length(word(4 * i + 4)) > 0, F.concat(F.lit(" "), F.substring(word(4 * i + 4), F.lit(1), half(word(4 * i + 4))), hyphen)).otherwise(F.lit(""))
    cut = ws.where(F.size("ws") > 0).select("doc_id", "ws", F.explode(F.sequence(F.lit(0), F.floor((F.size("ws") + 3) / 4).cast("int") - 1)).alias("i"))
    broken = cut.select("doc_id", i.alias("pos"), F.concat(rest, F.array_join(F.slice("ws", 4 * i + 1, F.lit(3)), " "), end).alias("line"))
    return M.joined_hyphens(broken, lexicon(spark, sf_dir), "doc_id")


@query("""
WITH h AS (SELECT conv_id AS region, role AS source, CAST(length(text) % 7 AS VARCHAR) AS text, (length(text) % 101) / 100::DOUBLE AS confidence FROM conversations),
g AS (SELECT region, text, count(DISTINCT source) AS support, avg(confidence) AS m, max(confidence) AS x FROM h GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, lead(support) OVER w AS next FROM g WINDOW w AS (PARTITION BY region ORDER BY support DESC, m DESC, x DESC, text DESC))
SELECT region, text, support, coalesce(next = support AND support >= 2, false) AS conflict, support >= 2 AND NOT coalesce(next = support AND support >= 2, false) AS accepted FROM r WHERE place = 1
""")
def j33_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.consensus(hypotheses(spark, sf_dir), 2, "turn")


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as sources, a digit of the length as reading, another as confidence."""
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("region"), F.col("role").alias("source"), "turn", (n % 7).cast("string").alias("text"), ((n % 101) / F.lit(100.0)).alias("confidence"))


@query(f"""
WITH {LEXICON}, h AS (SELECT conv_id AS region, turn AS source, text, (length(text) % 101) / 100::DOUBLE AS confidence FROM conversations),
w AS (SELECT region, source, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda x: regexp_matches(x, '\\p{{L}}')), lambda x: lower(regexp_extract(x, '^[^\\p{{L}}]*(.*?)[^\\p{{L}}]*$', 1))))) AS word FROM h),
s AS (SELECT region, source, sum(CASE WHEN lex.word IS NULL THEN 0 ELSE 1 END) / count(*) AS share FROM w LEFT JOIN lex ON w.word = lex.word GROUP BY ALL),
g AS (SELECT h.*, round(confidence + least(0.08::DOUBLE, 0.04::DOUBLE * (count(*) OVER (PARTITION BY h.region, text) - 1)) + 0.1::DOUBLE * coalesce(share, 0), 9) AS score FROM h LEFT JOIN s USING (region, source)),
r AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM g WINDOW w AS (PARTITION BY region ORDER BY score DESC, source))
SELECT region, source, sha256(text) AS digest, round(score, 6) AS score, coalesce(score - second < 0.02, false) AS review FROM r WHERE place = 1
""")
def j34_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("region"), F.col("turn").alias("source"), "text", ((F.length("text") % 101) / F.lit(100.0)).alias("confidence"))
    out = M.fused(rows, lexicon(spark, sf_dir), 0.02)
    return out.select("region", "source", F.sha2("text", 256).alias("digest"), F.round("score", 6).alias("score"), "review")


@query("""
WITH l AS (SELECT page_id, url AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages), t AS (SELECT DISTINCT '/' || lang AS target FROM documents UNION SELECT '/the' UNION SELECT '/der')
SELECT 'error' AS severity, 'no target' AS kind, source, target FROM l WHERE target NOT IN (SELECT target FROM t)
UNION ALL SELECT 'warning', 'not linked', NULL, target FROM t WHERE target NOT IN (SELECT target FROM l)
""")
def j27_broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.broken_links(links(spark, sf_dir), targets(spark, sf_dir))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("url").alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), "lang").alias("target")).distinct()
    return named.unionByName(spark.createDataFrame([("/the",), ("/der",)], "target string"))


@query("""
WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS name FROM pages), d(name) AS (VALUES ('p'), ('div'), ('table'), ('nav'))
SELECT name, CASE WHEN d.name IS NULL THEN 'not defined' ELSE 'not used' END AS problem FROM u FULL JOIN d USING (name) WHERE u.name IS NULL OR d.name IS NULL
""")
def j28_used_and_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("name"))
    return M.used_and_defined(used, spark.createDataFrame([("p",), ("div",), ("table",), ("nav",)], "name string"), "name")


@query("""
SELECT 'duplicate' AS kind, CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
UNION ALL SELECT 'dangling', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey
""")
def j29_foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in debt count as missing parents."""
    parents = table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return M.foreign_key_violations(table(spark, sf_dir, "lineitem"), "l_suppkey", parents, "s_suppkey", "l_orderkey")


@query("""
SELECT n_name AS name, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS used_by, count(DISTINCT c_mktsegment) AS files FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_name
""")
def j35_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation")
    uses = table(spark, sf_dir, "customer").where("c_acctbal > 9000").join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.col("c_mktsegment").alias("file"))
    return M.inventory(names.select(F.col("n_name").alias("name")), uses)


@query("""
SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN upper(lang) END, lang) AS lang FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1
""")
def j36_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents of low quality are rejected, of high quality reviewed with another value."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    marks = table(spark, sf_dir, "labels").join(docs, "doc_id")
    reviews = marks.select("doc_id", F.when(F.col("quality") == 1, "reviewed").otherwise("rejected").alias("status"), F.upper("lang").alias("lang"))
    return M.reviewed(docs, reviews, "doc_id", "lang")


@query("""
SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'pending' WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS decision FROM documents d LEFT JOIN labels USING (doc_id)
""")
def j30_label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("decision"))
    return M.label_join(table(spark, sf_dir, "documents").select("doc_id"), decisions, "doc_id", all_required=False)


@query("""
WITH m AS (SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text))
SELECT source, count(DISTINCT doc_id) AS docs, count(*) AS pairs FROM m JOIN documents USING (doc_id) GROUP BY source
""")
def j32_contained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a whole benchmark passage."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    met = M.containing(docs, items).join(docs.select("doc_id", "source"), "doc_id")
    return met.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("pairs"))
