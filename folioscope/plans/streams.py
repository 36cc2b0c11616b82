"""Queries over event logs: batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import documents as D
from folioscope.plans.registry import query, table
from folioscope.streaming import journal as J


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, count(*) AS events FROM events GROUP BY user_id")
def w13_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latest_state(table(spark, sf_dir, "events"), "user_id", F.struct("ts", "event_id"), "event_type")


@query("""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 86400000000 THEN 0 ELSE 1 END AS cut FROM events),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, min(ts) AS start, max(ts) AS "end", arg_min(event_type, (ts, event_id)) AS before, arg_max(event_type, (ts, event_id)) AS after, count(*) AS n FROM i GROUP BY user_id, island
""")
def w14_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("b"), F.col("event_type").alias("a"))
    return D.coalesced(events, "user_id", "ts", 86400.0, "b", "a")


@query("""
WITH l AS (SELECT user_id, event_type AS value, max((ts, event_id)) AS o FROM events GROUP BY ALL)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY o DESC, value) AS INT) AS place, value FROM l QUALIFY place <= 3
""")
def w15_recent_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("value"))
    return D.recent_distinct(events, "user_id", "value", ["ts", "event_id"], 3)


@query("""
WITH t AS (SELECT l_partkey, l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept_bytes FROM lineitem)
SELECT * FROM t WHERE kept_bytes > 200
""")
def w16_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]
    return D.evicted(table(spark, sf_dir, "lineitem"), "l_partkey", "l_quantity", newest, 200).select("l_partkey", "l_orderkey", "l_linenumber", "kept_bytes")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as a review log: views undo, one value in ten starts a batch."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "undo").otherwise("edit")
    return e.select(
        F.col("user_id").cast("string").alias("document"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), F.col("event_type").alias("target"),
        F.lit(None).cast("string").alias("before"), F.floor("value").cast("string").alias("after"), kind.alias("kind"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("b"), F.floor(F.col("event_id") / 9).cast("string"))).alias("batch"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
    )


@query(None)
def t1_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.projected(log(spark, sf_dir))


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type = 'view' AS undo FROM events),
s AS (SELECT *, CASE WHEN undo THEN -1 ELSE 1 END AS d FROM e), r AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS h FROM s),
m AS (SELECT user_id, last(h ORDER BY ts, event_id) AS h, min(h) AS low FROM r GROUP BY user_id)
SELECT user_id, CAST(h - least(low, 0) AS INT) AS standing FROM m
""")
def w12_standing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-event steps; the height of the stack left is the walk's height over its lowest point, as undo of nothing is free."""
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("o"), (F.col("event_type") == "view").alias("undo"), F.col("event_id").cast("string").alias("batch"))
    steps = D.standing_steps(e, "user_id", "o").select("user_id", F.size("steps").alias("standing"))
    return steps


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, CASE WHEN value > 50 THEN event_type ELSE 'view' END AS before FROM events) WHERE was IS NOT NULL AND was IS DISTINCT FROM before
""")
def t3_stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("before", F.when(F.col("value") > 50, F.col("event_type")).otherwise("view"))
    return D.stale_events(e, "user_id", ["ts", "event_id"], "before", "event_type").select("user_id", "event_id")


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type IN ('view', 'click') AS ok FROM events),
r AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e),
f AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 2 AS "off" FROM r)
SELECT event_id, coalesce(bool_or("off") OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS skipped FROM f
""")
def t7_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), F.col("event_type").isin("view", "click").alias("ok"))
    return J.breaker(e, "user_id", "o").select("event_id", "skipped")


@query("SELECT count(*) AS events, count(DISTINCT event_id) AS ids FROM events")
def t3_replayed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log read twice keeps every event once."""
    e = table(spark, sf_dir, "events")
    return e.unionByName(e).dropDuplicates(["event_id"]).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"))
