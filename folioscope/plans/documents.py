"""Queries over document structure: queues, numbering, nesting, editing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import documents as D
from folioscope.plans.metrics import LINE_ITEMS, boxes, line_items
from folioscope.plans.registry import query, table
from folioscope.plans.text import LINES, lines

KIND = "CASE lang WHEN 'en' THEN 'diagram' WHEN 'de' THEN 'paragraph' WHEN 'fr' THEN 'table' ELSE 'unknown' END"
QUEUE = f"""(SELECT doc_id AS id, source AS page, {KIND} AS kind, CASE WHEN toxic = 1 THEN 'unresolved' WHEN doc_id % 5 = 0 THEN 'reviewed' ELSE 'automatic' END AS status,
  quality = 0 AS flagged, (length(text) % 101) / 100::DOUBLE AS confidence, CASE WHEN length(text) < 300 THEN ['low_confidence'] ELSE ['short_line'] END AS reasons FROM documents JOIN labels USING (doc_id))"""
SEVERITY = f"""(SELECT *, 100 - 10 * CASE kind WHEN 'diagram' THEN 0 WHEN 'paragraph' THEN 2 WHEN 'table' THEN 3 ELSE 5 END + CASE WHEN confidence >= 0.8 THEN 0 ELSE 20 END
  + CASE WHEN reasons[1] = 'low_confidence' THEN 10 ELSE 0 END + CASE WHEN status = 'unresolved' THEN 15 ELSE 0 END + CASE WHEN reasons[1] = 'short_line' THEN 12 ELSE 0 END AS severity
  FROM {QUEUE} WHERE status <> 'reviewed' AND (status = 'unresolved' OR flagged OR reasons[1] = 'low_confidence'))"""


def queue_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    lang, n = F.col("lang"), F.length("text")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("page"),
        F.when(lang == "en", "diagram").when(lang == "de", "paragraph").when(lang == "fr", "table").otherwise("unknown").alias("kind"),
        F.when(F.col("toxic") == 1, "unresolved").when(F.col("doc_id") % 5 == 0, "reviewed").otherwise("automatic").alias("status"),
        (F.col("quality") == 0).alias("flagged"), ((n % 101) / F.lit(100.0)).alias("confidence"),
        F.array(F.when(n < 300, "low_confidence").otherwise("short_line")).alias("reason_codes"), F.array().cast("array<string>").alias("warnings"),
    )


@query(f"SELECT id, page, kind, CAST(severity AS INT) AS severity FROM {SEVERITY}")
def w1_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.review_queue(queue_blocks(spark, sf_dir), weights={"short_line": 0.25}).select("id", "page", "kind", "severity")


@query(f"SELECT id, page, CAST(severity AS INT) AS severity FROM {SEVERITY} QUALIFY row_number() OVER (PARTITION BY page ORDER BY severity DESC, id) <= 3")
def w2_queue_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.review_queue(queue_blocks(spark, sf_dir), per_page=3, weights={"short_line": 0.25}).select("id", "page", "severity")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS INT) AS number FROM orders")
def w9_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer by priority, in the order of their days and keys."""
    orders = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return D.numbered(orders, "o_custkey", "o_orderpriority", "at").select("o_orderkey", "number")


@query(f"""
WITH n AS (SELECT l_orderkey, pos, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY pos) AS number, l_returnflag FROM {LINE_ITEMS})
SELECT o_orderkey, coalesce('Item ' || number, o_orderpriority) AS text FROM orders LEFT JOIN n ON o_orderkey = l_orderkey AND l_returnflag = 'A' AND pos = 2
""")
def d6_reference_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = D.numbered(line_items(spark, sf_dir), "l_orderkey", "l_returnflag", "pos").where("l_returnflag = 'A' and pos = 2").select(F.col("l_orderkey").alias("target"), "number")
    refs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("target"), F.col("o_orderpriority").alias("text"))
    return D.reference_texts(refs, n, "target", "Item").select("o_orderkey", "text")


@query("SELECT l_orderkey, CAST(coalesce(min(l_linenumber) FILTER (WHERE l_linenumber >= 3), min(l_linenumber)) AS INT) AS next FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey")
def w10_next_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.next_or_first(table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'"), "l_orderkey", "l_linenumber", F.lit(3))


@query("""
WITH h AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS level FROM events)
SELECT a.doc, a.pos, a.level, max(b.pos) AS parent FROM h a LEFT JOIN h b ON a.doc = b.doc AND b.pos < a.pos AND b.level < a.level GROUP BY ALL
""")
def w17_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.nesting(heads(spark, sf_dir)).select("doc", "pos", "level", "parent")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as headings of three levels."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), pos.alias("pos"), F.when(kind == "signup", 1).when(kind == "purchase", 2).otherwise(3).alias("level"))


@query("""
WITH h AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type = 'signup' AS s FROM events)
SELECT doc, chapter, count(*) AS blocks FROM (SELECT doc, sum(CAST(s AS INT)) OVER (PARTITION BY doc ORDER BY pos) AS chapter FROM h) GROUP BY ALL
""")
def w18_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.chapters(heads(spark, sf_dir), "doc", F.col("level") == 1).groupBy("doc", "chapter").agg(F.count(F.lit(1)).alias("blocks"))


@query("""
WITH w AS (SELECT DISTINCT c_mktsegment AS key, c_nationkey AS place FROM customer) SELECT key AS c_mktsegment, string_agg(place, ',' ORDER BY place) AS places FROM w GROUP BY key
""")
def a41_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.index_entries(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query("""
WITH m(old, new) AS (VALUES ('BUILDING', 'MACHINERY'), ('MACHINERY', 'BUILDING'), ('HOUSEHOLD', 'HOME')) SELECT c_custkey, coalesce(new, c_mktsegment) AS target FROM customer LEFT JOIN m ON c_mktsegment = old
""")
def d1_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("BUILDING", "MACHINERY"), ("MACHINERY", "BUILDING"), ("HOUSEHOLD", "HOME")], "old string, new string")
    return D.renamed(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("target")), names, "target")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def d2_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of nations that would be deleted."""
    n = table(spark, sf_dir, "nation")
    files, links = n.select(F.col("n_nationkey").alias("name")), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("target"))
    _, referrers = D.deleted(files, links, n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("name")))
    return referrers.select("c_custkey", F.col("target").alias("c_nationkey"))


@query("""
WITH a AS (SELECT 'f' || n_nationkey || '.html' AS name, n_regionkey AS digest FROM nation), b AS (SELECT 'f' || (n_nationkey + 20) || '.html' AS name, n_regionkey AS digest FROM nation)
SELECT name, digest FROM a UNION ALL SELECT CASE WHEN a.name IS NULL THEN b.name ELSE replace(b.name, '.html', '-1.html') END, b.digest FROM b LEFT JOIN a USING (name) WHERE a.name IS NULL OR a.digest <> b.digest
""")
def d3_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    named = lambda k: n.select(F.concat(F.lit("f"), k.cast("string"), F.lit(".html")).alias("name"), F.col("n_regionkey").alias("digest"))
    return D.appended(named(F.col("n_nationkey")), named(F.col("n_nationkey") + 20))


@query(f"""
WITH b AS (SELECT l_orderkey, pos, l_quantity AS x1, l_quantity + 12 AS x2 FROM {LINE_ITEMS}),
g AS (SELECT *, max(x2) OVER (PARTITION BY l_orderkey ORDER BY x1, x2, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b)
SELECT l_orderkey AS page, pos, CAST(sum(CASE WHEN x1 - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x1, x2, pos) AS BIGINT) AS "column" FROM g
""")
def w19_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.columns_of_lines(boxes(spark, sf_dir)[0], "page", 3.0).select("page", "pos", "column")


@query(f"""
WITH b AS (SELECT l_orderkey, pos, l_quantity AS x1, l_quantity + 12 AS x2, l_discount * 100 AS y1 FROM {LINE_ITEMS}),
g AS (SELECT *, max(x2) OVER (PARTITION BY l_orderkey ORDER BY x1, x2, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
c AS (SELECT *, sum(CASE WHEN x1 - reach >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x1, x2, pos) AS k FROM g)
SELECT l_orderkey AS page, pos, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY k, y1, x1, pos) AS INT) AS place FROM c
""")
def w8_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reading_order(boxes(spark, sf_dir)[0], "page", 3.0).select("page", "pos", "place")


@query(f"""
WITH b AS (SELECT l_orderkey, pos, l_quantity AS x1, l_quantity < lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY pos) AS cut FROM {LINE_ITEMS})
SELECT l_orderkey AS page, pos, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS BIGINT) AS line FROM b
""")
def w20_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.line_breaks(boxes(spark, sf_dir)[0], "page").select("page", "pos", "line")


@query(f"""
WITH b AS (SELECT l_orderkey, pos, l_quantity AS x1, l_quantity + 12 AS x2 FROM {LINE_ITEMS}),
g AS (SELECT *, x1 - max(x2) OVER (PARTITION BY l_orderkey ORDER BY x1, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM b)
SELECT l_orderkey AS page, pos, CAST(sum(CASE WHEN gap > 0.2 * 12 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x1, pos) AS BIGINT) AS word FROM g
""")
def w7_words_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.words_by_gap(boxes(spark, sf_dir)[0], ["page"], 0.2).select("page", "pos", "word")


@query(None)
def w6_lines_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.lines_of_boxes(boxes(spark, sf_dir)[0])


@query(f"""
WITH b AS (SELECT source AS doc, doc_id AS page, pos, line AS text FROM {LINES} WHERE trim(line) <> ''),
e AS (SELECT doc, page, count(*) AS n, arg_min(text, pos) AS a, arg_max(text, pos) AS z FROM b GROUP BY ALL),
p AS (SELECT *, lead(a) OVER w AS next, lag(n) OVER w AS into_ FROM e WINDOW w AS (PARTITION BY doc ORDER BY page))
SELECT doc, page, z || ' ' || next AS joined FROM p WHERE NOT regexp_matches(z, '[.!?:;]\\s*$') AND regexp_matches(next, '^\\s*\\p{{Ll}}') AND NOT (n = 1 AND into_ IS NOT NULL)
""")
def w5_merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as pages in order of their ids."""
    blocks = lines(spark, sf_dir).where(F.trim("line") != "").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "pos", F.lit("paragraph").alias("kind"), F.col("line").alias("text"))
    return D.merged_paragraphs(blocks)


@query("""
WITH c AS (SELECT item_id, unnest(range(1, length(text) + 1)) AS pos, text FROM benchmark), d AS (SELECT item_id, pos, text[pos] AS ch, regexp_matches(text[pos], '\\p{Lu}') AS bold FROM c),
r AS (SELECT *, sum(CASE WHEN bold = b THEN 0 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM (SELECT *, lag(bold) OVER (PARTITION BY item_id ORDER BY pos) AS b FROM d))
SELECT item_id, CAST(run AS BIGINT) AS run, bold, CAST(min(pos) - 1 AS INT) AS start, string_agg(ch, '' ORDER BY pos) AS text FROM r GROUP BY item_id, run, bold
""")
def p19_style_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitals of the benchmark passages as bold."""
    chars = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("pos", "char")).where("char <> ''").withColumn("bold", F.col("char").rlike(r"\p{Lu}"))
    return D.style_runs(chars, "item_id", "bold")
