"""Queries of routing, suspicion, provenance, datasets, markup and notation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import markup as K
from folioscope.functions import notation as N
from folioscope.operators import review as R
from folioscope.plans.metrics import LINE_ITEMS, boxes, line_items
from folioscope.plans.registry import query, table
from folioscope.plans.text import LINES, lines, vocabulary


@query("""
WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'body' WHEN 'view' THEN 'notation' WHEN 'signup' THEN 'diagram' ELSE event_type END AS t, CASE WHEN value > 90 THEN 'prose' ELSE '' END AS f FROM events),
k AS (SELECT event_id, CASE WHEN f <> '' THEN f ELSE t END AS k FROM r)
SELECT event_id, CASE WHEN k IN ('prose', 'body') THEN 'prose' WHEN k IN ('notation', 'diagram') THEN k ELSE 'unknown' END AS domain,
  CASE WHEN k IN ('prose', 'body') THEN 'line' WHEN k = 'diagram' THEN 'special' ELSE 'glyph' END AS "primary",
  CASE k WHEN 'prose' THEN 0.95 WHEN 'body' THEN 0.9 WHEN 'notation' THEN 0.95 WHEN 'diagram' THEN 0.85 ELSE 0.35 END::DOUBLE AS confidence FROM k
""")
def p13_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    regions = table(spark, sf_dir, "events").select(
        "event_id", F.when(kind == "click", "body").when(kind == "view", "notation").when(kind == "signup", "diagram").otherwise(kind).alias("type"), F.when(F.col("value") > 90, "prose").otherwise("").alias("forced")
    )
    return R.routed(regions).select("event_id", "domain", "primary", "confidence")


@query(f"""
WITH w AS (SELECT l_orderkey AS page, l_returnflag AS block, pos, l_linestatus || l_linenumber AS text, l_discount AS c, l_quantity AS x1, l_quantity + 9 AS x2 FROM {LINE_ITEMS})
SELECT page, block, string_agg(text, ' ' ORDER BY pos) AS text, round(avg(c), 9) AS confidence, min(x1) AS x1, max(x2) AS x2 FROM w GROUP BY page, block
""")
def a43_words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as words, return flags as blocks."""
    q = F.col("l_quantity")
    words = line_items(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("block"), F.lit(0).alias("par"), F.lit(0).alias("line"), "pos", F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("text"),
        F.col("l_discount").alias("confidence"), q.alias("x1"), F.lit(0.0).alias("y1"), (q + 9).alias("x2"), F.lit(9.0).alias("y2"),
    )
    return R.words_to_lines(words).select("page", "block", "text", F.round("confidence", 9).alias("confidence"), "x1", "x2")


@query("SELECT 'c' || c_custkey || '-p' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 3, '0') AS id, c_custkey FROM customer")
def p29_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("document"), (F.col("c_nationkey") + 1).alias("page_index"), F.array().cast("array<string>").alias("families"))
    return R.candidates(pages).select("id", F.substring("document", 2, 20).cast("bigint").alias("c_custkey"))


@query("""
SELECT c_custkey AS candidate_id, CASE WHEN c_custkey % 7 = 0 THEN 'no candidate' WHEN c_nationkey = 3 THEN 'candidate already reviewed' WHEN c_acctbal < 0 THEN 'not reviewed' WHEN c_nationkey = 4 THEN 'other page' ELSE 'other source' END AS violation
FROM customer WHERE c_custkey % 7 = 0 OR c_nationkey IN (3, 4, 5) OR c_acctbal < 0
""")
def j31_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    found = c.where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("document"), n.alias("page_index"), n.cast("string").alias("sha256"), F.when(n == 3, "reviewed").otherwise("unreviewed").alias("status"))
    reviews = c.select(F.col("c_custkey").alias("candidate_id"), F.col("c_mktsegment").alias("document"), F.when(n == 4, 99).otherwise(n).alias("page_index"), F.when(n == 5, "x").otherwise(n.cast("string")).alias("sha256"), F.when(F.col("c_acctbal") < 0, "open").otherwise("reviewed").alias("status"))
    return R.provenance_violations(reviews, found)


@query("""
WITH c AS (SELECT p_type AS folder, CASE WHEN p_type LIKE '%1' THEN NULL ELSE split_part(p_type, ' ', 1) END AS char, count(*) AS samples, count(*) FILTER (WHERE p_size > 1) AS readable FROM part GROUP BY p_type)
SELECT 'invalid name' AS problem, folder AS "where", true AS grave FROM c WHERE char IS NULL
UNION ALL SELECT 'few samples', folder, false FROM c WHERE char IS NOT NULL AND samples BETWEEN 1 AND 9
UNION ALL SELECT 'unreadable', folder, true FROM c WHERE char IS NOT NULL AND readable < samples
UNION ALL SELECT 'collision', string_agg(folder, ', ' ORDER BY folder), true FROM c WHERE char IS NOT NULL GROUP BY char HAVING count(*) > 1
""")
def a35_dataset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_type")
    classes = table(spark, sf_dir, "part").groupBy(t.alias("folder")).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("p_size") > 1).alias("readable"))
    named = classes.withColumn("char", F.when(~F.col("folder").endswith("1"), F.split("folder", " ")[0]))
    return R.dataset_problems(named, 10)


@query("""
WITH b AS (SELECT p_type, percentile_cont(0.02) WITHIN GROUP (ORDER BY p_retailprice) AS low, percentile_cont(0.98) WITHIN GROUP (ORDER BY p_retailprice) AS high FROM part GROUP BY p_type)
SELECT p_partkey FROM part JOIN b USING (p_type) WHERE p_retailprice < low OR p_retailprice > high
""")
def x5_outside_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    return R.outside_bounds(part, R.bounds_by_class(part, "p_type", "p_retailprice", 0.02, 0.98), "p_type", "p_retailprice").select("p_partkey")


@query(f"""
WITH m AS (SELECT doc_id, len(regexp_extract_all(line, '\\b[a-h][1-8]-[a-h][1-8]\\b')) AS arrows, length(line) AS n FROM {LINES})
SELECT doc_id, CAST(sum(arrows) AS BIGINT) AS arrows FROM m GROUP BY doc_id
""")
def f17_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.size(F.regexp_extract_all("line", F.lit(N.ARROW), F.lit(0)))
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.sum(named).cast("bigint").alias("arrows"))


@query("""
SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)))[1] AS first_tag, len(regexp_extract_all(html, '<([a-z][a-z0-9]*)')) AS tags FROM pages
""")
def a40_tag_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.array_min(names).alias("first_tag"), F.size(names).cast("bigint").alias("tags"))


@query(None)
def p22_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = table(spark, sf_dir, "pages").select("page_id", K.repaired("html").alias("r"))
    return fixed.select("page_id", F.sha2("r.html", 256).alias("digest"), F.size("r.changes").alias("changes"))


@query(None)
def p21_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "pages").select("page_id", K.cleaned("html").alias("c"))
    return out.select("page_id", F.length("c.html").alias("chars"), F.size("c.report").alias("kinds"))


@query(r"""
WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<style>(.*?)</style>', 1)) AS css FROM pages), b AS (SELECT page_id, css FROM s WHERE contains(css, '{'))
SELECT page_id, trim(split_part(css, '{', 1)) AS selector, trim(split_part(split_part(split_part(css, '{', 2), '}', 1), ':', 1)) AS name, trim(split_part(split_part(split_part(css, '{', 2), '}', 1), ':', 2)) AS value FROM b
""")
def p31_css_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    styles = F.explode(F.regexp_extract_all("html", F.lit(r"(?s)<style>(.*?)</style>"), F.lit(1))).alias("css")
    sheets = table(spark, sf_dir, "pages").select("page_id", styles).select("page_id", K.css_rules(F.col("css")).alias("r"))
    return sheets.select("page_id", F.explode("r").alias("r")).select("page_id", "r.selector", "r.name", "r.value")


@query(None)
def j17_fuzzy_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark passages that the documents hardly know, against the words they know well."""
    freq = vocabulary(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")).distinct()
    rare = asked.join(freq.where("freq >= 20").select("word"), "word", "left_anti").where(F.length("word") > 5)
    return R.fuzzy_suggestions(rare, freq.where("freq >= 100"), 2)


@query(None)
def j23_line_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.line_matches(*boxes(spark, sf_dir))


@query(None)
def g11_spatial_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one brand whose size and price lie within a step of each other."""
    points = table(spark, sf_dir, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"))
    return R.spatial_groups(points, "page", 1.0)


PROMOTION = """q AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'confirmed' ELSE 'open' END AS decision, o_totalprice > 1000 AS readable FROM orders WHERE o_orderkey % 3 > 0),
base AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 1)"""


def quarantine(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two orders of three in quarantine, the rest and some of those in the base already."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    held = orders.where(k % 3 > 0).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("open").alias("decision"), (F.col("o_totalprice") > 1000).alias("readable"))
    return held, orders.where((k % 3 == 0) | (k % 5 == 1)).select("o_orderkey")


@query(f"WITH {PROMOTION} SELECT o_orderkey, CASE WHEN decision <> 'confirmed' THEN 'refused' ELSE 'unreadable' END AS reason FROM q WHERE NOT (decision = 'confirmed' AND readable)")
def t9_not_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.promoted(*quarantine(spark, sf_dir), "o_orderkey")[1]


@query(f"WITH {PROMOTION} SELECT o_orderkey FROM base UNION SELECT o_orderkey FROM q WHERE decision = 'confirmed' AND readable")
def t9_promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.promoted(*quarantine(spark, sf_dir), "o_orderkey")[0]


@query("""
WITH e AS (SELECT event_id, value IS NULL OR value < 5 AS bad, value FROM events) SELECT event_id, CASE WHEN NOT bad THEN round(100 / value, 6) END AS value, CASE WHEN bad THEN 'too small' END AS error FROM e
""")
def t6_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("value").isNull() | (F.col("value") < 5)
    out = table(spark, sf_dir, "events").select("event_id", R.isolated(F.round(F.try_divide(F.lit(100.0), "value"), 6), bad, F.lit("too small")).alias("r"))
    return out.select("event_id", "r.value", "r.error")


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey <> 3 AND s_acctbal < 0 THEN 'schema,config_hash' WHEN s_nationkey <> 3 THEN 'schema' WHEN s_acctbal < 0 THEN 'config_hash' ELSE '' END AS reasons FROM supplier
""")
def h4_incompatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("schema"), F.lit("v1").alias("pipeline_version"), F.when(F.col("s_acctbal") < 0, "old").otherwise("new").alias("config_hash"))
    return R.incompatibilities(packages, "3", "v1", "new").select("s_suppkey", F.concat_ws(",", "reasons").alias("reasons"))


@query("""
WITH t(code, template) AS (VALUES ('F', 'order {n} is filled'), ('O', 'order {n} is open'))
SELECT o_orderkey, coalesce(replace(template, '{n}', CAST(o_orderkey AS VARCHAR)), o_orderstatus) AS sentence FROM orders LEFT JOIN t ON code = o_orderstatus
""")
def p27_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    codes = table(spark, sf_dir, "orders").select(key.alias("key"), F.col("o_orderstatus").alias("code"), F.create_map(F.lit("n"), key.cast("string")).alias("values"))
    templates = spark.createDataFrame([("F", "order {n} is filled"), ("O", "order {n} is open")], "code string, template string")
    return R.described(codes, templates).select(F.col("key").alias("o_orderkey"), "sentence")


@query("""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents)
SELECT length(word) AS len, count(DISTINCT word) AS words, count(*) AS uses FROM w GROUP BY 1
""")
def a31_word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).groupBy(F.length("word").cast("bigint").alias("len")).agg(F.count(F.lit(1)).alias("words"), F.sum("freq").cast("bigint").alias("uses"))
