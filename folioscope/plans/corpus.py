"""Queries over corpora: copies, coverage, splits, components, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import corpus as C
from folioscope.operators import graph as G
from folioscope.plans.registry import query, table


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def a33_first_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_of_copies(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("""
WITH s AS (SELECT list_sort(list(DISTINCT source)) AS labels FROM documents GROUP BY sha256(text) HAVING count(DISTINCT source) > 1)
SELECT array_to_string(labels, ',') AS labels, count(*) AS contents FROM s GROUP BY 1
""")
def a34_contradictory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts under several sources."""
    return C.contradictory(table(spark, sf_dir, "documents"), F.col("text"), "source")


FAMILIES = ["table", "loud", "foreign", "long", "short"]
FAMILY_SQL = """(SELECT doc_id, source, list_filter([CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'loud' END,
  CASE WHEN length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) > 0 THEN 'foreign' END, CASE WHEN length(text) > 10000 THEN 'long' END, CASE WHEN length(text) < 200 THEN 'short' END, 'other'], lambda f: f IS NOT NULL) AS families FROM documents)"""


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    tags = F.array_compact(F.array(F.when(t.contains(" | "), "table"), F.when(t.contains("!!"), "loud"), F.when(t.rlike(r"[^\x00-\x7F]"), "foreign"), F.when(F.length(t) > 10_000, "long"), F.when(F.length(t) < 200, "short"), F.lit("other")))
    return table(spark, sf_dir, "documents").select("doc_id", "source", tags.alias("families"))


@query(f"SELECT doc_id, array_to_string(families, ',') AS families, coalesce(list_filter(['table', 'loud', 'foreign', 'long', 'short'], lambda f: list_contains(families, f))[1], 'other') AS principal FROM {FAMILY_SQL}")
def p14_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families(spark, sf_dir).select("doc_id", F.concat_ws(",", "families").alias("families"), C.principal(F.col("families"), FAMILIES, "other").alias("principal"))


@query(f"SELECT coalesce(list_filter(['table', 'loud', 'foreign', 'long', 'short'], lambda f: list_contains(families, f))[1], 'other') AS principal, count(*) AS pages FROM {FAMILY_SQL} GROUP BY 1")
def p15_principal_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest family of every page, by the order of the fixed list, and how many pages have it."""
    return families(spark, sf_dir).groupBy(C.principal(F.col("families"), FAMILIES, "other").alias("principal")).agg(F.count(F.lit(1)).alias("pages"))


GRID = f"g AS (SELECT source, unnest(['table', 'loud', 'foreign', 'long', 'short']) AS family FROM (SELECT DISTINCT source FROM documents)), n AS (SELECT source, family, count(*) AS n FROM (SELECT source, unnest(families) AS family FROM {FAMILY_SQL}) GROUP BY ALL)"


@query(f"WITH {GRID} SELECT source, family, coalesce(n, 0) AS pages FROM g LEFT JOIN n USING (source, family)")
def a27_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coverage(families(spark, sf_dir), "families", FAMILIES, "source")


@query(f"""
WITH {GRID}, c AS (SELECT source, family, coalesce(n, 0) AS pages FROM g LEFT JOIN n USING (source, family))
SELECT source, string_agg(family, ',' ORDER BY list_position(['table', 'loud', 'foreign', 'long', 'short'], family)) AS missing FROM c WHERE pages < 3 GROUP BY source
""")
def a28_deficits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.deficits(C.coverage(families(spark, sf_dir), "families", FAMILIES, "source"), FAMILIES, 3, "source")


@query(None)
def w11_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents are measured, the others candidates."""
    rows = families(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("document"), "families")
    marked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    out = C.planned(rows.join(marked, "id", "left_semi"), rows.join(marked, "id", "left_anti"), FAMILIES, 3)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(out)], "place int, id bigint, document string, met int")


@query("""
WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(vec_id || ':7'), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN n < 10 THEN 'train' WHEN k <= greatest(1, round_even(n * 0.05::DOUBLE, 0)) THEN 'test'
  WHEN k <= greatest(1, round_even(n * 0.05::DOUBLE, 0)) + greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM r
""")
def g4_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stratified(table(spark, sf_dir, "embeddings"), "vec_id", "label", 0.15, 0.05, 10, 7)


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS a, CAST(o_custkey AS VARCHAR) AS k FROM orders UNION ALL SELECT l_orderkey, 'p' || l_partkey FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 49),
least_of AS (SELECT k, min(a) AS m FROM e GROUP BY k), edges AS (SELECT a, m AS b FROM e JOIN least_of USING (k) WHERE a <> m),
both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM e) UNION SELECT b.b, r.root FROM reach r JOIN both_ b ON b.a = r.node AND r.root < b.b)
SELECT node AS item, min(root) AS root FROM reach GROUP BY node
""")
def g1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a customer or, in large first lines, a part."""
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_quantity > 49")
    return G.components_by_pairs(_customers_and_parts(table(spark, sf_dir, "orders"), first), "item", "key")


def _customers_and_parts(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """All rows (item, key) of orders: their customer and every part of ``lines``."""
    customers = orders.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").cast("string").alias("key"))
    return customers.unionByName(lines.select(F.col("l_orderkey").alias("item"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("key")))


@query(None)
def g1_components_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a customer or a part, by all lines; without SQL, held against union-find in the tests."""
    return G.components_by_pairs(_customers_and_parts(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")), "item", "key")


@query("""
WITH d AS (SELECT DISTINCT o_custkey AS root, sha256(o_custkey || ':3') AS h FROM orders), n AS (SELECT count(*) AS n FROM d),
r AS (SELECT root, row_number() OVER (ORDER BY h) AS k FROM d)
SELECT root, CASE WHEN k <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'test' WHEN k <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) + greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM r, n
""")
def g2_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_groups(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root")).distinct(), "root", 0.2, 0.1, 3)


@query("""
WITH s AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'test' ELSE 'train' END AS split, o_custkey, o_orderpriority FROM orders),
k AS (SELECT split, 'o_custkey' AS key, CAST(o_custkey AS VARCHAR) AS value FROM s UNION ALL SELECT split, 'o_orderpriority', o_orderpriority FROM s)
SELECT key, value, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*) AS n FROM k GROUP BY key, value HAVING count(DISTINCT split) > 1
""")
def g5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("split", F.when(F.col("o_orderkey") % 2 == 0, "test").otherwise("train"))
    return C.leaks(rows, ["o_custkey", "o_orderpriority"])


@query("""
WITH a AS (SELECT c_custkey, c_mktsegment AS v FROM customer WHERE c_nationkey <> 3), b AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'closed' ELSE c_mktsegment END AS v FROM customer WHERE c_nationkey <> 4)
SELECT c_custkey, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (c_custkey) WHERE a.v IS DISTINCT FROM b.v
""")
def g8_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    after = c.where("c_nationkey <> 4").withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "closed").otherwise(F.col("c_mktsegment")))
    return C.difference(c.where("c_nationkey <> 3"), after, "c_custkey", F.col("c_mktsegment"))


@query("""
SELECT n_name, 'order' AS side FROM nation WHERE n_nationkey >= 24 UNION ALL SELECT n_name, 'current' FROM nation WHERE n_nationkey < 1
""")
def d5_not_a_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return C.not_a_permutation(n.where("n_nationkey >= 1").select("n_name"), n.where("n_nationkey < 24").select("n_name"))


@query("""
SELECT p_partkey AS id, round(0.65::DOUBLE * (1 - p_size / 50::DOUBLE) + 0.35::DOUBLE * least(1.0, p_retailprice / 100), 9) AS score FROM part ORDER BY score DESC, id LIMIT 50
""")
def w3_active_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / F.lit(50.0)).alias("confidence"), F.col("p_retailprice").alias("impact"))
    return C.active_sample(items, 50).select("id", F.round("score", 9).alias("score"))


@query("""
WITH d AS (SELECT lang, sha256(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY ALL)
SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || ':5'), doc_id) AS INT) AS place FROM d QUALIFY place <= 20
""")
def t8_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reservoir(table(spark, sf_dir, "documents"), F.col("text"), "lang", "doc_id", 20, 5)


@query("""
WITH l AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END, (o_orderdate, o_orderkey)) AS v0, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY o_custkey)
SELECT c_custkey AS id, CASE WHEN o_custkey IS NULL THEN c_mktsegment WHEN s = 'F' THEN NULL ELSE p END AS value FROM customer LEFT JOIN l ON c_custkey = o_custkey
WHERE CASE WHEN o_custkey IS NULL THEN c_mktsegment WHEN s = 'F' THEN NULL ELSE p END IS NOT NULL
""")
def s11_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers take the priority of their last order and leave if it is filled."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"))
    o = table(spark, sf_dir, "orders")
    # the status rides along with the value, as a discarded value is null
    last = o.groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority")).alias("x"))
    changes = last.select("id", F.when(F.col("x.o_orderstatus") != "F", F.struct(F.col("x.o_orderpriority").alias("v"))).alias("s"), F.lit(1).alias("order"))
    boxed = base.select("id", F.struct(F.col("value").alias("v")).alias("s"))
    return C.upsert(boxed, changes, "id", "s", "order").select("id", F.col("s.v").alias("value"))
