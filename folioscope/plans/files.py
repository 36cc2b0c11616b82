"""Queries through files: tables written in a format in the shared folder and read back by its reader; streams over such files."""

from __future__ import annotations

from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import notation as N
from folioscope.operators import matching as M
from folioscope.operators import pages as P
from folioscope.operators import review as V
from folioscope.operators.graph import shared_folder
from folioscope.plans.registry import query, table
from folioscope.plans.streams import log
from folioscope.sources import pdf
from folioscope.sources import readers as R
from folioscope.sources import writers as W
from folioscope.streaming import journal as J


def scratch(spark: SparkSession) -> str:
    """A folder of its own beside the checkpoints."""
    return f"{shared_folder(spark)}/files-{uuid4().hex}"


def written(df: DataFrame, value, per_file: int = 1_000_000) -> str:
    """The folder of text files that hold one value a line."""
    path = scratch(df.sparkSession)
    df.select(value.alias("value")).write.option("maxRecordsPerFile", per_file).text(path)
    return path


def one_each(df: DataFrame, value, partitions: int | None = None) -> str:
    """The folder of text files of one row each."""
    return written(df, value, 1)


@query("SELECT n_name AS name, n_nationkey AS key FROM nation")
def s1_json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation as a file with one object."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return R.json_objects(spark, one_each(nation, F.to_json(F.struct("name", "key"), {"pretty": "true"})), "name string, key bigint")


@query("SELECT n_name AS text, CAST(n_regionkey AS VARCHAR) AS fen FROM nation UNION ALL SELECT r_name || chr(10), NULL FROM region")
def s2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as page objects (.json), regions as plain text."""
    page = F.struct(F.col("n_name").alias("text"), F.array(F.struct(F.col("n_regionkey").cast("string").alias("fen"))).alias("diagrams"))
    folder = scratch(spark)
    table(spark, sf_dir, "nation").select(page.alias("p")).select("p.*").write.option("maxRecordsPerFile", 1).json(f"{folder}/a")  # files end with .json
    table(spark, sf_dir, "region").select("r_name").write.option("maxRecordsPerFile", 1).text(f"{folder}/b")
    found = R.pages(spark, f"{folder}/[ab]/part-*")
    return found.select(F.when(F.col("path").endswith(".json"), F.rtrim("page.text")).otherwise(F.col("page.text")).alias("text"), F.get("page.diagrams", F.lit(0))["fen"].alias("fen"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)
SELECT CAST(r_regionkey AS VARCHAR) AS document_id, CASE WHEN r_regionkey = 1 THEN 'unsplit' ELSE 'train' END AS split, CAST(k AS INT) AS page_pos, CAST(n_nationkey AS VARCHAR) AS page_id, CAST(n_nationkey AS INT) AS page_index, n_name AS reference FROM n JOIN region ON n_regionkey = r_regionkey
""")
def s3_corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest whose documents are regions and whose pages are nations."""
    n = table(spark, sf_dir, "nation")
    pages = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_nationkey"].cast("string").alias("id"), x["n_nationkey"].alias("page_index"), x["n_name"].alias("reference")))
    docs = n.groupBy("n_regionkey").agg(pages.alias("pages")).select(F.struct(F.col("n_regionkey").cast("string").alias("id"), F.lit("en").alias("language"), F.when(F.col("n_regionkey") != 1, "train").alias("split"), "pages").alias("d"))
    whole = docs.agg(F.array_sort(F.collect_list("d")).alias("documents")).select(F.to_json(F.struct(F.lit("c").alias("name"), "documents")).alias("j"))
    return R.corpus_pages(spark, written(whole, F.col("j"))).select("document_id", "split", "page_pos", "page_id", "page_index", "reference")


@query("""SELECT n_nationkey, n_name, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS digest FROM nation""")
def s4_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written with a digest of each and read back."""
    path = scratch(spark)
    W.write_manifest(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string, digest string").json(path)


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS pos, n_name AS id, 'r' || n_regionkey AS reference, n_comment AS prediction FROM (SELECT n_nationkey, n_name, n_regionkey, n_name || '!' AS n_comment FROM nation)")
def s5_page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))), lambda x: F.struct(x["n_name"].alias("id"), F.concat(F.lit("r"), x["n_regionkey"].cast("string")).alias("reference"), F.concat(x["n_name"], F.lit("!")).alias("prediction")))
    whole = n.agg(rows.alias("pages")).select(F.to_json(F.struct(F.lit("b").alias("name"), "pages")).alias("j"))
    return R.page_pairs(spark, written(whole, F.col("j"))).select("pos", "id", "reference", "prediction")


@query("SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def s6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as formatted JSON and read back."""
    path = scratch(spark)
    W.write_report(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).coalesce(1), path)
    whole = spark.read.text(path, wholetext=True)
    objects = whole.select(F.explode(F.split("value", r"(?<=\})\s*\n(?=\{)")).alias("o"))
    return objects.select(F.from_json("o", "lang string, n bigint, chars bigint").alias("r")).select("r.*")


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linestatus WHEN 'O' THEN '' ELSE l_returnflag END AS char, CAST(l_quantity AS INT) AS x1, 200 - CAST(l_quantity + 9 AS INT) AS y1, CAST(l_quantity + 5 AS INT) AS x2, 200 - CAST(l_quantity AS INT) AS y2, l_tax > 0.04 AS negative FROM lineitem
""")
def s7_glyph_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as box files; order and line come back as page and angle."""
    q = F.col("l_quantity").cast("int")
    line = F.concat_ws(" ", F.when(F.col("l_linestatus") == "O", "~").otherwise(F.col("l_returnflag")), q, q, q + 5, q + 9, F.col("l_orderkey"), F.col("l_linenumber"), F.when(F.col("l_tax") > 0.04, 1).otherwise(0))
    found = R.glyph_boxes(spark, written(table(spark, sf_dir, "lineitem"), line), height=200)
    return found.select(F.col("page").cast("bigint").alias("l_orderkey"), F.col("angle").cast("int").alias("l_linenumber"), "char", "x1", "y1", "x2", "y2", "negative")


@query("SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS event_id, CAST(user_id AS VARCHAR) AS document_id, event_type AS target_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS after FROM events")
def s8_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended to a journal in two batches, the second twice, and replayed."""
    events = log(spark, sf_dir).select("event_id", F.col("document").alias("document_id"), F.col("target").alias("target_id"), "after")
    path, half = scratch(spark), F.pmod(F.xxhash64("event_id"), F.lit(2))
    write = J.append_to(path)
    for number, part in ((0, 0), (1, 1), (1, 1)):
        write(events.where(half == part), number)
    return R.journal(spark, f"{path}/batch=*").select("event_id", "document_id", "target_id", F.col("after").cast("double").cast("bigint").cast("string").alias("after"))


@query("SELECT doc_id, text, source FROM documents")
def s9_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "source", F.create_map(F.lit("id"), F.col("doc_id").cast("string")).alias("metadata"))
    path = scratch(spark)
    docs.write.json(path)
    return R.samples(spark, path).select(F.col("metadata")["id"].cast("bigint").alias("doc_id"), "text", "source")


@query("SELECT 'img/' || n_nationkey || '.png' AS path, n_name || chr(9) || n_regionkey AS text FROM nation WHERE n_regionkey <> 2 AND n_nationkey % 5 <> 0")
def s10_labelled_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a list; lines without a tab are skipped, and those whose file does not exist."""
    n = table(spark, sf_dir, "nation")
    name = F.concat(F.lit("img/"), F.col("n_nationkey").cast("string"), F.lit(".png"))
    line = F.when(F.col("n_regionkey") == 2, name).otherwise(F.concat(name, F.lit("\t"), "n_name", F.lit("\t"), F.col("n_regionkey").cast("string")))
    return R.labelled_list(spark, written(n, line), n.where("n_nationkey % 5 <> 0").select(name.alias("path")))


@query("SELECT n_nationkey, n_name, list_sort([n_name, CAST(n_regionkey AS VARCHAR)]) AS parts FROM nation")
def s13_editorial_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed objects to canonical JSON and back."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.array_sort(F.array("n_name", F.col("n_regionkey").cast("string"))).alias("parts"))
    return R.json_objects(spark, one_each(rows, W.canonical_json(rows)), "n_nationkey bigint, n_name string, parts array<string>")


@query("SELECT o_orderkey, o_totalprice AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders")
def f21_typed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"))
    return rows.select(F.from_json(W.canonical_json(rows), "o_orderkey bigint, price double, status string").alias("r")).select("r.*")


def region_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book per region with a chapter per nation."""
    n = table(spark, sf_dir, "nation")
    body = F.concat(F.lit("<h1>"), "n_name", F.lit("</h1><p>Nation "), F.col("n_nationkey").cast("string"), F.lit(" &amp; more.</p>"))
    return n.select(F.concat(F.lit("book"), F.col("n_regionkey").cast("string")).alias("book"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("title"), body.alias("html"))


def binary_files(files: DataFrame, suffix: str) -> str:
    """The folder into which executors wrote the column ``content``, a file per row, through Spark's writer."""
    path = scratch(files.sparkSession)
    files.select(F.base64("content").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def container_rows(files: DataFrame) -> DataFrame:
    """Binary rows as a reader of files would give them: path and content."""
    path = binary_files(files, "zip")
    whole = files.sparkSession.read.text(path, wholetext=True)
    return whole.select(F.input_file_name().alias("path"), F.unbase64(F.trim("value")).alias("content"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)
SELECT CAST(k AS INT) AS spine, 'heading' AS kind, n_name AS text FROM n UNION ALL SELECT CAST(k AS INT), 'paragraph', 'Nation ' || n_nationkey || ' & more.' FROM n
""")
def s18_epub_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books written as EPUB and read back to blocks."""
    entries = R.epub_entries(container_rows(W.epub_files(region_chapters(spark, sf_dir), "book")))
    chapters = entries.where("spine is not null").select(F.concat_ws(" ", "path", F.col("spine").cast("string")).alias("chapter"), F.decode("content", "UTF-8").alias("html"))
    return R.html_blocks(chapters, "chapter").select(F.substring_index("chapter", " ", -1).cast("int").alias("spine"), "kind", "text")


@query("SELECT 'sound' AS state, count(*) AS links FROM nation GROUP BY n_regionkey")
def s18_epub_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structural check of every written book, and the links of its navigation."""
    entries = R.epub_entries(container_rows(W.epub_files(region_chapters(spark, sf_dir), "book")))
    nav = entries.where("name = 'nav.xhtml'").select("path", F.regexp_count(F.decode("content", "UTF-8"), F.lit("<a href=")).cast("bigint").alias("links"))
    return nav.join(R.epub_problems(entries), "path", "left").select(F.coalesce("problem", F.lit("sound")).alias("state"), "links")


@query("""
SELECT n_regionkey AS doc, 'heading' AS kind, 1 AS level, 'Region ' || n_regionkey AS text FROM nation GROUP BY n_regionkey
UNION ALL SELECT n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN 'list' ELSE 'paragraph' END, NULL, n_name || ' <' || n_nationkey || '>' FROM nation
""")
def s19_docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as DOCX documents, written and read back."""
    n = table(spark, sf_dir, "nation")
    name = F.concat("n_name", F.lit(" <"), F.col("n_nationkey").cast("string"), F.lit(">"))
    body = n.select(F.col("n_regionkey").alias("doc"), (F.col("n_nationkey") + 1).cast("int").alias("pos"), F.when(F.col("n_nationkey") % 3 == 0, "list").otherwise("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), name.alias("text"))
    heads = n.select(F.col("n_regionkey").alias("doc")).distinct().select("doc", F.lit(0).alias("pos"), F.lit("heading").alias("kind"), F.lit(1).alias("level"), F.concat(F.lit("Region "), F.col("doc").cast("string")).alias("text"))
    blocks = R.docx_rows(container_rows(W.docx_files(body.unionByName(heads), "doc")))
    first = F.first("text").over(Window.partitionBy("path").orderBy("pos"))
    return blocks.select(F.regexp_extract(first, r"(\d+)", 1).cast("bigint").alias("doc"), "kind", "level", "text")


@query("""
WITH l AS (SELECT c_nationkey AS doc, c_name || ' (' || c_mktsegment || ') \\ é' AS text, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer)
SELECT CAST(pos // 50 + 1 AS INT) AS page, CAST(pos % 50 AS INT) AS pos, text FROM l
""")
def s20_s22_pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of every nation as lines of a paginated PDF, and the text layer read back."""
    name = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") \\ é"))
    lines = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("pos"), name.alias("text"))
    return pdf.text_rows(container_rows(pdf.pdf_files(lines, "doc"))).select("page", "pos", "text")


@query("SELECT CAST(l_linenumber AS INT) AS page, l_returnflag || l_linestatus AS text, round(CAST(l_quantity AS DOUBLE), 3) AS x, round(842 - (l_discount * 100 + 12), 3) AS y, 12.0::DOUBLE AS size FROM lineitem")
def s22_searchable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words at their places as invisible text: every day of shipping is a file, every line number a page."""
    top = F.col("l_discount") * 100
    words = table(spark, sf_dir, "lineitem").select(
        F.dayofmonth("l_shipdate").alias("doc"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_orderkey").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.col("l_quantity").alias("x1"), top.alias("y1"), (F.col("l_quantity") + 20).alias("x2"), (top + 12).alias("y2")
    )
    whole = words.select("doc", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("page")).distinct()  # a page may be empty of words
    rows = whole.join(words, ["doc", "page"], "left")
    out = pdf.text_rows(container_rows(pdf.searchable_files(rows, "doc")))
    return out.where("text <> ''").select("page", "text", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("size", 3).alias("size"))


MOVES = ["e4", "e5", "Nf3", "Nc6", "Bb5"]


@query("SELECT n_nationkey, n_name AS white, 'Rival, A' AS black, '*' AS result, 9 AS lexemes FROM nation")
def s23_s24_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games written as PGN and read back: tags and lexemes."""
    tags = F.create_map(F.lit("Event"), F.col("n_nationkey").cast("string"), F.lit("White"), F.col("n_name"), F.lit("Black"), F.lit("Rival, A"))
    text = N.pgn_text(tags, F.array(*(F.lit(m) for m in MOVES)), F.lit("*"))
    found = R.games(spark, written(table(spark, sf_dir, "nation"), text))
    result = F.filter("lexemes", lambda x: x["kind"] == "result")[0]["text"]
    return found.select(F.col("tags")["Event"].cast("bigint").alias("n_nationkey"), F.col("tags")["White"].alias("white"), F.col("tags")["Black"].alias("black"), result.alias("result"), F.size("lexemes").alias("lexemes"))


@query("SELECT DISTINCT lower(n_name) AS word, 'word' AS kind FROM nation WHERE NOT contains(n_name, ' ') UNION SELECT DISTINCT lower(split_part(n_name, ' ', 1)), 'word' FROM nation UNION ALL SELECT 'fl' || n_nationkey, 'root' FROM nation UNION ALL SELECT 'un', 'prefix' UNION ALL SELECT 'ies', 'suffix'")
def s25_word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word list, roots with flags and an affix file."""
    n = table(spark, sf_dir, "nation")
    words = R.word_list(spark, written(n, F.concat(F.lit(" "), F.col("n_name"), F.lit("\t"), F.col("n_nationkey").cast("string"))))
    roots = R.affix_roots(spark, written(n, F.concat(F.lit("fl"), F.col("n_nationkey").cast("string"), F.lit("/S"))))
    rules = spark.createDataFrame([("SFX S Y 1",), ("SFX S y ies [^aeiou]y",), ("PFX U Y 1",), ("PFX U 0 un .",), ("# SFX",)], "value string")
    affixes = R.affix_rules(spark, written(rules, F.col("value")))
    return words.select("word", F.lit("word").alias("kind")).unionByName(roots.select(F.col("root").alias("word"), F.lit("root").alias("kind"))).unionByName(affixes.select(F.col("add").alias("word"), "kind"))


@query("""
WITH b AS (SELECT n_regionkey AS doc, n_nationkey AS pos, CASE WHEN n_nationkey % 4 = 0 THEN 'header' ELSE 'paragraph' END AS kind, n_name AS text FROM nation)
SELECT doc, 'clean' AS mode, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS value FROM b WHERE kind <> 'header' GROUP BY doc UNION ALL SELECT doc, 'faithful', string_agg(text, chr(10) || chr(10) ORDER BY pos) FROM b GROUP BY doc
""")
def s26_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    blocks = n.select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") % 4 == 0, "header").otherwise("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("n_name").alias("text"))
    both = [W.exported(blocks, "doc", "text", mode).withColumn("mode", F.lit(mode)) for mode in ("clean", "faithful")]
    return both[0].unionByName(both[1]).select("doc", "mode", "value")


@query("SELECT n_regionkey AS name, arg_max(n_name, n_nationkey) AS pattern FROM nation GROUP BY n_regionkey")
def s27_saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches kept as JSON lines; of one name the last counts."""
    path = scratch(spark)
    table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("name"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("pattern")).write.json(path)
    return P.saved_searches(spark.read.schema("name bigint, pos bigint, pattern string").json(path))


@query("SELECT event_id, event_type FROM events")
def t4_streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files that come twice, streamed a bounded number of files at a time, each event once."""
    source, sink, state = scratch(spark), scratch(spark), scratch(spark)
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("target_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    for _ in range(2):
        events.repartition(4, "event_id").write.mode("append").json(source)
    came = J.stream(spark, source, files_per_trigger=2)
    write = J.append_to(sink)
    running = J.once(came, "created_at", "20 years").select("event_id", "target_id").writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("event_id string, target_id string").json(f"{sink}/batch=*").select(F.col("event_id").cast("bigint").alias("event_id"), F.col("target_id").alias("event_type"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, event_type = 'view' AS undo, CAST(floor(value) AS BIGINT) AS v FROM events),
h AS (SELECT *, sum(CASE WHEN undo THEN -1 ELSE 1 END) OVER w AS h FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, h - least(0, min(h) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS g FROM h),
k AS (SELECT *, min(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS low FROM f)
SELECT u.user_id, l.v AS value FROM (SELECT DISTINCT user_id FROM e) u LEFT JOIN (SELECT user_id, arg_max(v, (ts, event_id)) AS v FROM k WHERE NOT undo AND coalesce(low, g) >= g GROUP BY user_id) l USING (user_id)
""")
def t2_value_after_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit sets one target of its user; views undo. What stands is the value of the last edit not undone."""
    rows = log(spark, sf_dir).withColumn("target", F.lit("x")).withColumn("batch", F.lit(None).cast("string"))
    out = J.projected(rows).groupBy("document").agg(F.first("state").alias("s"))
    return out.select(F.col("document").cast("bigint").alias("user_id"), F.get_json_object("s", "$.x").cast("double").cast("bigint").alias("value"))


@query("""
WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'view' THEN 'undo' WHEN 'click' THEN 'redo' ELSE 'save' END AS op, CAST(event_id AS VARCHAR) AS v FROM events),
s(user_id, i, past, future) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM o
  UNION ALL SELECT s.user_id, o.i, CASE WHEN op = 'save' THEN list_append(past, v)[-5:] WHEN op = 'undo' AND len(past) > 1 THEN past[1:len(past) - 1] WHEN op = 'redo' AND len(future) > 0 THEN list_append(past, future[1]) ELSE past END,
    CASE WHEN op = 'save' THEN CAST([] AS VARCHAR[]) WHEN op = 'undo' AND len(past) > 1 THEN list_prepend(past[len(past)], future) WHEN op = 'redo' AND len(future) > 0 THEN future[2:] ELSE future END
  FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
SELECT user_id, past[len(past)] AS value, CAST(len(past) AS INT) AS past, CAST(len(future) AS INT) AS future FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1
""")
def t12_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo and redo over at most five snapshots of every user."""
    kind = F.when(F.col("event_type") == "view", "undo").when(F.col("event_type") == "click", "redo").otherwise("save")
    ops = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("pos"), kind.alias("op"), F.col("event_id").cast("string").alias("value"))
    return V.snapshot_stack(ops, "user_id", 5)


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE upper(p_type) END AS text, CASE WHEN p_size % 7 = 0 THEN NULL ELSE least(p_size / 40, 1.0) END AS confidence, CASE WHEN p_size % 7 = 0 THEN 'ValueError: cannot read' END AS error FROM part")
def u1_recogniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugged-in reader; items it fails on carry their error."""

    def read(item: str) -> tuple[str, float]:
        size, text = item.split("|", 1)
        if int(size) % 7 == 0:
            raise ValueError("cannot read")
        return text.upper(), int(size) / 40

    out = table(spark, sf_dir, "part").select("p_partkey", P.recogniser(read)(F.concat_ws("|", F.col("p_size").cast("string"), "p_type")).alias("r"))
    return out.select("p_partkey", "r.text", "r.confidence", "r.error")


@query("SELECT n_regionkey, CAST(sum(length(n_name)) AS BIGINT) AS chars, count(*) AS n, CAST(len(list_distinct(list(length(n_name)))) AS INT) AS lengths FROM nation GROUP BY n_regionkey")
def u4_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive counters of parts, merged: they are sums and sets, which partial aggregates merge by themselves."""
    parts = table(spark, sf_dir, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 3).alias("part")).agg(F.sum(F.length("n_name")).alias("chars"), F.count(F.lit(1)).alias("n"), F.collect_set(F.length("n_name")).alias("lengths"))
    return parts.groupBy("n_regionkey").agg(F.sum("chars").cast("bigint").alias("chars"), F.sum("n").cast("bigint").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("lengths")))).alias("lengths"))


@query("SELECT event_type AS stage, count(*) AS rows, CAST(sum(CAST(value < 10 AS INT)) AS BIGINT) AS faults FROM events GROUP BY 1")
def s12_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run trace: the observed metrics of a run per stage, kept as JSON lines and read back."""
    path = scratch(spark)
    events = table(spark, sf_dir, "events")
    for stage in [r[0] for r in events.select("event_type").distinct().collect()]:  # the stages of a run: a handful
        W.traced(events.where(F.col("event_type") == stage), path, stage, rows=F.count(F.lit(1)), faults=F.count_if(F.col("value") < 10))
    return R.trace(spark, path).select("stage", F.col("metrics")["rows"].cast("bigint").alias("rows"), F.col("metrics")["faults"].cast("bigint").alias("faults"))
