"""Queries over pairs and runs: error rates, aggregates, gates, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import metrics as M
from folioscope.plans.registry import query, table

# DuckDB's levenshtein counts bytes, so its texts have every character beyond ASCII replaced by a control character of its own.
PAIRS = """(SELECT u.conv_id, u.turn, translate(u.text, f.chars, f.signs) AS reference, translate(a.text, f.chars, f.signs) AS prediction
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1,
  (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS chars, chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7) || chr(8) || chr(11) || chr(12) || chr(14) || chr(15) || chr(16) || chr(17)
    || chr(18) || chr(19) || chr(20) || chr(21) || chr(22) || chr(23) || chr(24) || chr(25) || chr(26) || chr(27) || chr(28) || chr(29) || chr(30) || chr(31) || chr(127) AS signs
   FROM (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS c FROM conversations) WHERE c <> '') f
  WHERE u.role = 'user' AND a.role = 'assistant')"""
#: lineitem repeats line numbers within an order, so the place of a line is its rank.
LINE_ITEMS = "(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pos FROM lineitem)"
RATE = "CASE WHEN length(reference) > 0 THEN levenshtein(reference, prediction) / length(reference) WHEN length(prediction) = 0 THEN 0.0 ELSE 1.0 END"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of each user turn (reference) and the answer to it (prediction)."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reference"))
    given = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return asked.join(given, ["conv_id", "turn"])


@query(f"SELECT conv_id, turn, CAST(levenshtein(reference, prediction) AS INT) AS errors, CAST(length(reference) AS INT) AS total, round({RATE}, 9) AS cer FROM {PAIRS}")
def a2_text_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.text_errors(pairs(spark, sf_dir)).select("conv_id", "turn", "errors", "total", F.round("cer", 9).alias("cer"))


@query(f"""
SELECT turn, count(*) AS pages, CAST(sum(levenshtein(reference, prediction)) AS BIGINT) AS errors, CAST(sum(length(reference)) AS BIGINT) AS total,
  round(sum(levenshtein(reference, prediction)) / sum(length(reference)), 9) AS micro_cer, round(avg({RATE}), 9) AS macro_cer
FROM {PAIRS} GROUP BY turn
""")
def a7_micro_and_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.micro(M.text_errors(pairs(spark, sf_dir)), "turn")
    return out.withColumn("micro_cer", F.round("micro_cer", 9)).withColumn("macro_cer", F.round("macro_cer", 9))


@query(None)
def a8_word_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word sequences of every pair: edit distance over tokens, exact items, exact sequences."""
    rows = pairs(spark, sf_dir).withColumn("reference", T.tokens(F.col("reference"))).withColumn("prediction", T.tokens(F.col("prediction")))
    return M.sequence_errors(rows).select("conv_id", "turn", "errors", "total", "error_rate", "exact_items", "exact")


@query(None)
def a5_errors_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned words of every part's name and type, errors by domain."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", r"\s+").alias("reference"), F.split("p_type", r"\s+").alias("prediction"))
    return M.errors_by_domain(M.aligned_tokens(parts, "p_partkey"), "p_partkey")


TYPES = f"""(SELECT l_orderkey, list(CASE l_returnflag WHEN 'N' THEN 'open' ELSE 'done' END ORDER BY pos) AS reference,
  list(CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'done' END ORDER BY pos) AS prediction FROM {LINE_ITEMS} GROUP BY l_orderkey)"""


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order))


@query(f"""
SELECT l_orderkey, CAST(len(list_filter(list_zip(reference, prediction), lambda p: p[1] = p[2])) AS INT) AS types_right,
  round(100.0 * len(list_filter(list_zip(reference, prediction), lambda p: p[1] = p[2])) / len(reference), 9) AS type_accuracy, reference = prediction AS order_right FROM {TYPES}
""")
def a10_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = lambda c, x: F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col(c) == x, "open").otherwise("done").alias("t")))), lambda s: s["t"])
    orders = line_items(spark, sf_dir).groupBy("l_orderkey").agg(types("l_returnflag", "N").alias("reference"), types("l_linestatus", "O").alias("prediction"))
    return M.layout(orders).select("l_orderkey", "types_right", F.round("type_accuracy", 9).alias("type_accuracy"), "order_right")


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference and predicted boxes: every order is a page, its lines are boxes; predictions are shifted by the tax."""
    line = line_items(spark, sf_dir).select(
        F.col("l_orderkey").alias("page"), "pos", F.col("l_returnflag").alias("char"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("shift"),
    )
    box = lambda c, dx, size: line.select("page", "pos", c.alias("char"), (F.col("x") + dx).alias("x1"), (F.col("y") + dx).alias("y1"), (F.col("x") + dx + size).alias("x2"), (F.col("y") + dx + size).alias("y2"))
    return box(F.col("char"), F.lit(0.0), 12.0), box(F.when(F.col("status") == "O", "N").otherwise("R"), F.col("shift"), 10.0)


BOX = f"""li AS {LINE_ITEMS}, ref AS (SELECT l_orderkey AS page, pos, l_quantity AS x1, l_discount * 100 AS y1, l_quantity + 12 AS x2, l_discount * 100 + 12 AS y2 FROM li),
pred AS (SELECT l_orderkey AS page, pos, l_quantity + l_tax * 100 AS x1, l_discount * 100 + l_tax * 100 AS y1, l_quantity + l_tax * 100 + 10 AS x2, l_discount * 100 + l_tax * 100 + 10 AS y2 FROM li)"""


@query(f"""
WITH {BOX}, j AS (SELECT r.page, r.pos AS ref, p.pos AS pred,
  greatest(least(r.x2, p.x2) - greatest(r.x1, p.x1), 0) * greatest(least(r.y2, p.y2) - greatest(r.y1, p.y1), 0) AS cut, (r.x2 - r.x1) * (r.y2 - r.y1) AS a, (p.x2 - p.x1) * (p.y2 - p.y1) AS b
  FROM ref r JOIN pred p ON r.page = p.page AND (p.x1 + p.x2) / 2 BETWEEN r.x1 AND r.x2 AND (p.y1 + p.y2) / 2 BETWEEN r.y1 AND r.y2)
SELECT page, ref, pred, round(cut / (a + b - cut), 6) AS iou FROM j
""")
def j5_centre_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.centre_in_box(*boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 6))


@query(f"""
WITH {BOX} SELECT r.page, r.pos AS ref, count(p.pos) AS inside FROM ref r
LEFT JOIN pred p ON r.page = p.page AND (p.x1 + p.x2) / 2 BETWEEN r.x1 AND r.x2 AND (p.y1 + p.y2) / 2 BETWEEN r.y1 AND r.y2 GROUP BY ALL
""")
def j7_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, pred = boxes(spark, sf_dir)
    counts = M.centre_in_box(ref, pred).groupBy("page", "ref").agg(F.count(F.lit(1)).alias("inside"))
    return ref.select("page", F.col("pos").alias("ref")).join(counts, ["page", "ref"], "left").select("page", "ref", F.coalesce("inside", F.lit(0)).alias("inside"))


@query(None)
def j6_greedy_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_boxes(*boxes(spark, sf_dir))


@query(None)
def a9_box_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.boxes_summary(M.match_boxes(*boxes(spark, sf_dir)).withColumn("part", F.pmod("page", F.lit(10))), "part")


LIMITS = [("docs", 10.0), ("mean_chars", 500.0), ("longest", 1e9), ("absent", 0.5)]


@query(f"""
WITH m(metric, value) AS (SELECT 'docs', CAST(count(*) AS DOUBLE) FROM documents UNION ALL SELECT 'mean_chars', avg(length(text)) FROM documents
  UNION ALL SELECT 'longest', CAST(max(length(text)) AS DOUBLE) FROM documents),
l(metric, "limit") AS (VALUES {', '.join(f"('{m}', CAST({v} AS DOUBLE))" for m, v in LIMITS)})
SELECT metric, round(value, 9) AS value, "limit" FROM l LEFT JOIN m USING (metric) WHERE value IS NULL OR value < "limit"
""")
def a13_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).cast("double").alias("docs"), F.avg(F.length("text")).alias("mean_chars"), F.max(F.length("text")).cast("double").alias("longest"))
    values = d.unpivot([], ["docs", "mean_chars", "longest"], "metric", "value")
    return M.gate(values, spark.createDataFrame(LIMITS, "metric string, limit double")).withColumn("value", F.round("value", 9))


@query("""
WITH now AS (SELECT c_mktsegment AS segment, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT a.segment, a.y, round(b.v, 4) AS before, round(a.v, 4) AS now FROM now a JOIN now b ON a.segment = b.segment AND a.y = b.y + 1 WHERE a.v > b.v + 100
""")
def j4_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = sold.groupBy(F.col("c_mktsegment").alias("segment"), F.year("o_orderdate").cast("bigint").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    key = lambda df, shift: df.select(F.struct("segment", (F.col("y") + shift).alias("y")).alias("k"), "v")
    found = M.regressions(key(runs, 0), key(runs, 1), "k", "v", 100.0)
    return found.select("k.segment", "k.y", F.round("before", 4).alias("before"), F.round("now", 4).alias("now"))


@query("""
WITH v AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY user_id)
SELECT user_id, round(a, 6) AS baseline, round(b, 6) AS candidate, round(b - a, 6) AS delta FROM v WHERE a IS NOT NULL AND b IS NOT NULL
""")
def j2_two_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    out = M.compared(cases, "user_id", "event_type", "v", "click", "purchase")
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")))


@query("""
WITH m AS (SELECT event_type AS e, avg(value) AS v, avg(length(props)) AS n FROM events GROUP BY 1)
SELECT a.e AS "left", b.e AS "right", round(b.v - a.v, 6) AS value_delta, round(b.n - a.n, 6) AS cost_delta FROM m a JOIN m b ON a.e < b.e
""")
def j3_engine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select("event_type", "value", F.length("props").alias("cost"))
    return M.engine_pairs(runs, "event_type", "value", "cost").withColumn("value_delta", F.round("value_delta", 6)).withColumn("cost_delta", F.round("cost_delta", 6))


@query("""
SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def j1_reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""
SELECT l_returnflag AS expected, CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END AS got, count(*) AS n FROM lineitem
WHERE l_returnflag <> CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END GROUP BY ALL
""")
def a24_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(read_classes(spark, sf_dir), "expected", "got")


def read_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("expected"), F.when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("got"))


@query("""
SELECT l_returnflag AS expected, count(*) AS total, CAST(sum(CAST(l_returnflag = CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END AS INT)) AS BIGINT) AS hits,
  round(100.0 * sum(CAST(l_returnflag = CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'R' END AS INT)) / count(*), 9) AS recall FROM lineitem GROUP BY 1
""")
def a22_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recall_by_class(read_classes(spark, sf_dir), "expected", "got").withColumn("recall", F.round("recall", 9))


@query("""
SELECT p_type, count(*) AS total FROM part GROUP BY p_type ORDER BY count(*), p_type LIMIT 10
""")
def a23_worst_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("total")).orderBy("total", "p_type").limit(10)


@query("""
WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, l_quantity FROM r WHERE k = n // 2 + 1
""")
def a39_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.operators.documents import upper_median

    return upper_median(table(spark, sf_dir, "lineitem"), "l_quantity", "l_orderkey")


@query("""
SELECT n_name, count(*) FILTER (WHERE s_acctbal < 0) AS errors, count(*) FILTER (WHERE s_acctbal >= 0) AS others, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def a44_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return met.groupBy("n_name").agg(F.count_if(F.col("s_acctbal") < 0).alias("errors"), F.count_if(F.col("s_acctbal") >= 0).alias("others"), F.count(F.lit(1)).alias("n"))


@query("""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders)
SELECT round(avg(o_totalprice) FILTER (WHERE k = 1), 4) AS before, round(avg(o_totalprice) FILTER (WHERE k = 2), 4) AS after FROM o
""")
def a37_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    ranked = table(spark, sf_dir, "orders").withColumn("k", k)
    mean = lambda n: F.round(F.avg(F.when(F.col("k") == n, F.col("o_totalprice"))), 4)
    return ranked.agg(mean(1).alias("before"), mean(2).alias("after"))
