"""Queries of token shapes, small values, corrections and page metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import markup as K
from folioscope.functions import notation as N
from folioscope.functions import rules
from folioscope.functions import text as T
from folioscope.operators import corpus as C
from folioscope.operators import documents as D
from folioscope.operators import matching as M
from folioscope.operators import metrics as X
from folioscope.operators import pages as P
from folioscope.operators import review as R
from folioscope.operators import search as S
from folioscope.plans.matching import LEXICON, WORDS, lexicon
from folioscope.plans.metrics import LINE_ITEMS, line_items
from folioscope.plans.registry import query, table
from folioscope.plans.text import CANDIDATE, LINES, NOTATION, SIGNATURE, lines


def pick(values: list, number: Column) -> Column:
    """The value at a number (from 0) modulo their count."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (number % len(values) + 1).cast("int"))


def sql_pick(values: list, number: str) -> str:
    return "([" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + f"])[CAST(({number}) % {len(values)} + 1 AS INT)]"


MEN, ENDS = ["", "K", "N", "Q", "z", "O-O", "x"], ["", "+", "!?", ".", "#"]
TOKENS = f"(SELECT l_orderkey, pos, {sql_pick(MEN, 'l_linenumber')} || chr(CAST(97 + l_orderkey % 10 AS INT)) || (l_partkey % 10) || {sql_pick(ENDS, 'l_suppkey')} AS token FROM {LINE_ITEMS})"


def move_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are moves or nearly, one for every line item."""
    made = F.concat(pick(MEN, F.col("l_linenumber")), F.char(97 + F.col("l_orderkey") % 10), (F.col("l_partkey") % 10).cast("string"), pick(ENDS, F.col("l_suppkey")))
    return line_items(spark, sf_dir).select("l_orderkey", "pos", made.alias("token"))


_LOOSE = f"trim(token, '{T.MOVE_SUFFIX}')"


@query(f"""
SELECT l_orderkey, pos, length({_LOOSE}) BETWEEN 1 AND 8 AND (replace(upper({_LOOSE}), '0', 'O') IN ('O-O', 'O-O-O') OR (regexp_matches({_LOOSE}, '^[KQRBNabcdefgh0O]') AND regexp_matches({_LOOSE}, '[a-h][1-8]'))) AS loose,
  {NOTATION.replace('(w,', '(token,')} AS strict FROM {TOKENS}
""")
def p9_move_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return move_tokens(spark, sf_dir).select("l_orderkey", "pos", T.looks_like_move(F.col("token")).alias("loose"), T.is_notation(F.col("token")).alias("strict"))


@query(f"SELECT {SIGNATURE} AS signature, count(*) AS n FROM {LINES} GROUP BY 1")
def p7_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(T.signature(F.col("line")).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, count(*) FILTER (WHERE {CANDIDATE}) AS heads FROM {LINES} GROUP BY doc_id")
def p8_header_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(T.header_candidate(F.col("line"))).alias("heads"))


@query("SELECT doc_id, sha256(translate(replace(text, 'e', '✝'), '✝', '+')) AS digest FROM documents")
def p3_output_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a symbol put in for a letter."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.output_symbols(F.replace("text", F.lit("e"), F.lit("✝"))), 256).alias("digest"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: regexp_matches(w, '\p{L}')) AS ws FROM documents)
SELECT doc_id, CAST(len(ws) AS INT) AS words, sha256(array_to_string(ws, ' ')) AS digest FROM w
""")
def p4_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = table(spark, sf_dir, "documents").select("doc_id", T.words(F.col("text")).alias("ws"))
    return ws.select("doc_id", F.size("ws").alias("words"), F.sha2(F.array_join("ws", " "), 256).alias("digest"))


@query(r"""
SELECT word, replace(lower(strip_accents(word)), 'ß', 'ss') AS key FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word FROM documents)
""")
def p6_sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.sort_key(F.col("word")).alias("key"))


@query(r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INT) AS tokens, sha256(array_to_string(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'), ' ')) AS digest FROM documents
""")
def a3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


_STATUS, _KINDS = ["automatic", "unresolved", "reviewed", "rejected"], ["diagram", "paragraph", "table"]


def reviewed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as blocks under review."""
    k, none = F.col("event_id"), F.array().cast("array<string>")
    return table(spark, sf_dir, "events").select(
        k.alias("id"), (F.col("user_id") % 10).alias("page"), pick(_KINDS, k).alias("kind"), pick(_STATUS, F.col("user_id") + k).alias("status"), (F.col("value") > 90).alias("flagged"),
        F.when(k % 5 == 0, F.array(F.lit("w"))).otherwise(none).alias("warnings"), F.when(k % 7 == 0, F.array(F.lit("low_confidence"), F.lit("other"))).when(k % 7 == 1, F.array(F.lit("other"))).otherwise(none).alias("reason_codes"),
        F.floor("value").cast("int").alias("severity"),
    )


@query(f"""
WITH e AS (SELECT event_id, {sql_pick(_STATUS, 'user_id + event_id')} AS status, coalesce(value > 90, false) AS flagged, event_id % 5 = 0 AS warned, event_id % 7 = 0 AS high FROM events)
SELECT event_id AS id FROM e WHERE status NOT IN ('reviewed', 'rejected') AND (status = 'unresolved' OR flagged OR warned OR high)
""")
def p10_needs_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed_events(spark, sf_dir).where(D.needs_review()).select("id")


@query(f"SELECT event_id AS id FROM events WHERE user_id % 10 = 3 AND {sql_pick(_KINDS, 'event_id')} = 'table' AND {sql_pick(_STATUS, 'user_id + event_id')} = 'unresolved' AND floor(value) >= 20")
def p11_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.queue_filter(reviewed_events(spark, sf_dir), page=3, kind="table", minimum=20, status="unresolved").select("id")


@query("SELECT event_id, round(least(greatest(coalesce(value / 60 - 0.3, 0), 0), 1), 9) AS value FROM events")
def p24_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(T.clamped(F.col("value") / 60 - 0.3), 9).alias("value"))


@query("""
WITH c AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS c FROM documents), l(language) AS (VALUES ('en'), ('pt'), ('xx'))
SELECT language, c AS char, language = 'xx' OR NOT regexp_matches(c, '^\\p{Latin}$') OR (language = 'pt' AND contains('áàâãéêíóôõúüçÁÀÂÃÉÊÍÓÔÕÚÜÇ', c)) AS allowed FROM c, l WHERE c <> ''
""")
def p30_allowed_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split(F.regexp_replace("text", r"[\x00-\x7F]", ""), "")).alias("char")).where("char <> ''").distinct()
    each = chars.withColumn("language", F.explode(F.array(F.lit("en"), F.lit("pt"), F.lit("xx"))))
    kept = R.allowed_letters(F.array(F.struct("char", F.lit(1.0).alias("p"))), F.col("language"))
    return each.select("language", "char", (F.size(kept) == 1).alias("allowed"))


@query("""
SELECT n_nationkey, 'data-key="' || n_nationkey || '" data-name="' || n_name || ' &amp; &quot;co&quot;"' AS attributes, n_name || ' & "co"' AS name FROM nation
""")
def p33_data_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = F.create_map(F.lit("name"), F.concat("n_name", F.lit(' & "co"')), F.lit("key"), F.col("n_nationkey").cast("string"))
    written = table(spark, sf_dir, "nation").select("n_nationkey", K.data_attributes(fields).alias("attributes"))
    return written.select("n_nationkey", "attributes", F.try_element_at(K.from_data_attributes(F.col("attributes")), F.lit("name")).alias("name"))


@query("SELECT n_nationkey, '<b>' || n_name || '</b>' || n_regionkey || '-' || n_nationkey || '|' || n_name AS text FROM nation")
def p34_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array(F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    return table(spark, sf_dir, "nation").select("n_nationkey", K.applied_clip(F.lit("<b>$0</b>$1-$2$3|$0"), F.col("n_name"), groups).alias("text"))


@query("""
SELECT p_partkey, array_to_string(list_filter([substr(p_type, 1, 3) || '**' || ':a', CASE WHEN length(p_type) > 8 THEN substr(p_type, 9, 2) || ':b' END, CASE WHEN length(p_type) > 10 THEN substr(p_type, 11) || ':c' END], lambda x: x IS NOT NULL), ',') AS runs FROM part
""")
def p20_replaced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters 3 to 8 of the type replaced, which stands in runs of 5, 5 and the rest."""
    piece = lambda a, n, f: F.struct(F.substring(F.col("p_type"), F.lit(a), F.lit(n)).alias("text"), F.lit(f).alias("fmt"))
    out = K.replaced_in_runs(F.array(piece(1, 5, "a"), piece(6, 5, "b"), piece(11, 1000, "c")), F.lit(3), F.lit(8), F.lit("**"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(out, lambda r: F.concat_ws(":", r["text"], r["fmt"])), ",").alias("runs"))


@query("""
WITH l AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS word FROM part), m AS (SELECT DISTINCT replace(word, 'e', '*') AS mask FROM l UNION SELECT DISTINCT regexp_replace(word, '[aeiou]', '*', 'g') FROM l UNION SELECT substr(word, 1, 1) || repeat('*', length(word) - 1) FROM l),
j AS (SELECT mask, word FROM m JOIN l ON length(mask) = length(word) AND regexp_matches(word, '^' || replace(mask, '*', '.') || '$') WHERE contains(mask, '*') AND regexp_matches(mask, '[a-z]'))
SELECT mask, min(word) AS word FROM j GROUP BY mask HAVING count(*) = 1
""")
def j21_masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the part types with vowels, or all but the initial, unread."""
    known = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).distinct()
    w = F.col("word")
    masks = known.select(F.explode(F.array(F.replace(w, F.lit("e"), F.lit("*")), F.regexp_replace(w, "[aeiou]", "*"), F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.length(w) - 1)))).alias("mask"))
    return M.masked_words(masks, known)


@query("""
WITH l AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS word FROM part WHERE p_size > 25), p AS (SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS b FROM part),
w AS (SELECT p_partkey, unnest(range(1, least(len(a), len(b)) + 1)) AS i, a, b FROM p), r AS (SELECT p_partkey, i, b[i] AS ref, a[i] AS pred FROM w)
SELECT p_partkey, CAST(i - 1 AS INT) AS pos, CASE WHEN x.word IS NULL AND y.word IS NOT NULL AND lower(ref) <> '' THEN pred ELSE ref END AS word, x.word IS NULL AND y.word IS NOT NULL AND lower(ref) <> '' AS repaired
FROM r LEFT JOIN l x ON x.word = lower(regexp_extract(ref, '^[^\\p{L}]*(.*?)[^\\p{L}]*$', 1)) LEFT JOIN l y ON y.word = lower(pred)
""")
def j22_repaired_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of part names as one reading, of types as the other; types of large parts are the lexicon."""
    part = table(spark, sf_dir, "part")
    known = part.where("p_size > 25").select(F.explode(F.split(F.lower("p_type"), " ")).alias("word")).distinct()
    both = F.arrays_zip(F.split("p_name", " ").alias("ref"), F.split("p_type", " ").alias("pred"))
    rows = part.select("p_partkey", F.posexplode(both).alias("pos", "w")).select("p_partkey", "pos", "w.ref", "w.pred").where("ref is not null and pred is not null")
    return P.repaired_words(rows, known).select("p_partkey", "pos", "word", "repaired")


@query("""
WITH b AS (SELECT n_regionkey AS page, n_name AS text, row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS pos FROM nation), f AS (SELECT min(pos) AS first FROM b WHERE page = 2),
r AS (SELECT CASE WHEN pos < first THEN 0 ELSE 2 END AS g, page, pos, text FROM b, f WHERE page <> 2 UNION ALL SELECT 1, 2, r_regionkey, r_name FROM region)
SELECT CAST(page AS INT) AS page, CAST(row_number() OVER (ORDER BY g, pos) - 1 AS INT) AS pos, text FROM r
""")
def j38_replaced_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as blocks of a document whose pages are regions; page 2 takes the names of the regions."""
    order = Window.orderBy("n_regionkey", "n_nationkey")  # one document
    blocks = table(spark, sf_dir, "nation").select((F.row_number().over(order) - 1).alias("pos"), F.col("n_regionkey").cast("int").alias("page"), F.lit("paragraph").alias("kind"), F.col("n_name").alias("text"))
    new = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("pos"), F.lit("paragraph").alias("kind"), F.col("r_name").alias("text"))
    return M.replaced_page(blocks, 2, new).select("page", "pos", "text")


ALIGNED = f"(SELECT l_orderkey AS line, pos, CASE WHEN l_linenumber % 4 = 1 THEN NULL ELSE l_returnflag END AS ref, CASE WHEN l_linenumber % 4 <> 1 AND l_partkey % 3 = 0 THEN NULL ELSE l_linestatus END AS pred, 1 - l_discount AS confidence FROM {LINE_ITEMS})"


def aligned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flag and line status of every order as aligned characters: some added, some lost."""
    added = F.col("l_linenumber") % 4 == 1
    return line_items(spark, sf_dir).select(
        F.col("l_orderkey").alias("line"), "pos", F.when(~added, F.col("l_returnflag")).alias("ref"), F.when(added | (F.col("l_partkey") % 3 != 0), F.col("l_linestatus")).alias("pred"), (1 - F.col("l_discount")).alias("confidence")
    )


@query(f"""
WITH b AS (SELECT line, pos, greatest(count(ref) OVER (PARTITION BY line ORDER BY pos), 1) - 1 AS box, pred FROM {ALIGNED}), t AS (SELECT line, box, string_agg(coalesce(pred, ''), '' ORDER BY pos) AS text FROM b GROUP BY ALL),
a AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY pos) - 1 AS box FROM {ALIGNED} WHERE ref IS NOT NULL)
SELECT line, CAST(box AS BIGINT) AS box, coalesce(text, '') AS text FROM a LEFT JOIN t USING (line, box)
""")
def j39_spread_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned_items(spark, sf_dir)
    anchors = rows.where("ref is not null").select("line", (F.row_number().over(Window.partitionBy("line").orderBy("pos")) - 1).cast("bigint").alias("box"))
    return R.spread_reading(anchors, rows).select("line", "box", "text")


@query(f"""
SELECT coalesce(pred, '') AS read, coalesce(ref, '') AS expected, CASE WHEN pred IS NULL THEN 'lost' WHEN ref IS NULL THEN 'added' ELSE 'swapped' END AS kind, count(*) AS n
FROM {ALIGNED} WHERE ref IS DISTINCT FROM pred AND confidence >= 0.95 GROUP BY ALL
""")
def a25_mined_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mined_errors(aligned_items(spark, sf_dir), 0.95)


@query(f"SELECT ref AS expected, CAST(count(*) AS BIGINT) AS n FROM {ALIGNED} WHERE ref <> pred AND confidence >= 0.95 GROUP BY ref HAVING count(*) >= 2")
def a26_classes_to_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classes_to_train(R.mined_errors(aligned_items(spark, sf_dir), 0.95))


@query(f"""
WITH a AS (SELECT line, pos, CASE WHEN ref = 'A' THEN 'e4' ELSE ref END AS ref, pred FROM {ALIGNED}),
d AS (SELECT *, coalesce(last_value(CASE WHEN ref IS NOT NULL THEN CASE WHEN ref = 'e4' THEN 'notation' ELSE 'prose' END END IGNORE NULLS) OVER (PARTITION BY line ORDER BY pos), 'prose') AS domain FROM a),
e AS (SELECT *, CASE WHEN ref IS NULL THEN length(pred) WHEN pred IS NULL THEN length(ref) ELSE levenshtein(ref, pred) END AS ce FROM d),
x AS (SELECT line, domain, ref, pred, ce FROM e UNION ALL SELECT line, 'total', ref, pred, ce FROM e)
SELECT line, domain, count(ref) AS tokens, count(*) FILTER (WHERE ref IS DISTINCT FROM pred) AS errors, CAST(coalesce(sum(length(ref)), 0) AS BIGINT) AS chars, CAST(sum(ce) AS BIGINT) AS char_errors FROM x GROUP BY ALL
""")
def w4_errors_by_last_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An added character counts for the domain of the last reference before it."""
    rows = aligned_items(spark, sf_dir).withColumn("ref", F.when(F.col("ref") == "A", "e4").otherwise(F.col("ref")))
    return X.errors_by_domain(rows, "line").select("line", "domain", "tokens", "errors", "chars", "char_errors")


_ITEMS = "list_transform({0}, lambda x: chr(CAST(63 + list_position(list_distinct(list_concat(a, b)), x) AS INT)))"


@query(f"""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)
SELECT p_partkey, CAST(levenshtein(array_to_string({_ITEMS.format('a')}, ''), array_to_string({_ITEMS.format('b')}, '')) AS INT) AS distance FROM p
""")
def a1_item_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance over the words of name and type."""
    return table(spark, sf_dir, "part").select("p_partkey", T.item_distance(F.split("p_name", " "), F.split("p_type", " ")).alias("distance"))


FENS = ["8/8/8/4k3/8/8/8/4K3 w - - 0 1", "8/8/8/4k3/8/8/8/4K3 b", "8/8/8/4k3/8/8/8/4K2 w", "not a position", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"]
#: Of these: whether they are well formed, and what two of them share as a key.
_FORMED = ["true", "true", "false", "false", "true"]


@query(f"""
WITH f AS (SELECT l_orderkey, pos, {sql_pick(FENS, 'l_partkey')} AS a, ({_FORMED})[CAST(l_partkey % 5 + 1 AS INT)] = 'true' AS fa, {sql_pick(FENS, 'l_suppkey')} AS b, ({_FORMED})[CAST(l_suppkey % 5 + 1 AS INT)] = 'true' AS fb FROM {LINE_ITEMS})
SELECT l_orderkey, CAST(count(*) FILTER (WHERE fa AND fb AND a = b) AS INT) AS exact, CAST(count(*) FILTER (WHERE fb) AS INT) AS legal, CAST(count(*) AS INT) AS n_ref, CAST(count(*) AS INT) AS n_pred FROM f GROUP BY l_orderkey
""")
def a11_diagram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of the diagrams of every order."""
    rows = line_items(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", pick(FENS, F.col("l_partkey")).alias("a"), pick(FENS, F.col("l_suppkey")).alias("b")))).alias("f"))
    counts = P.diagram_counts(F.transform("f", lambda x: x["a"]), F.transform("f", lambda x: x["b"]))
    return rows.select("l_orderkey", counts.alias("c")).select("l_orderkey", "c.exact", "c.legal", "c.n_ref", "c.n_pred")


@query(f"SELECT p_partkey, ({_FORMED})[CAST(p_partkey % 5 + 1 AS INT)] = 'true' AS formed FROM part")
def p25_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(N.fen_shape(pick(FENS, F.col("p_partkey"))), F.lit(False)).alias("formed"))


PAGE_PAIRS = """(SELECT conv_id AS page, max(text) FILTER (WHERE role = 'user') AS a, max(text) FILTER (WHERE role = 'assistant') AS b, count(*) FILTER (WHERE role = 'user') AS na, count(*) FILTER (WHERE role = 'assistant') AS nb FROM conversations GROUP BY conv_id HAVING na > 0 AND nb > 0)"""


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of a page for every conversation: a line of each turn, its role as region."""
    c = table(spark, sf_dir, "conversations")
    side = lambda role: c.where(F.col("role") == role).groupBy("conv_id").agg(
        F.lit("").alias("text"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.substring(F.md5(x["text"].cast("binary")), 1, 1)).alias("lines"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 3).cast("string").alias("t")))), lambda x: F.struct(x["t"].alias("type"), x["turn"].cast("int").alias("order"))).alias("regions"),
    )
    page = lambda df, name: df.select("conv_id", F.struct("text", "lines", F.lit(None).cast("array<string>").alias("paragraphs"), "regions", F.lit(None).cast("array<struct<fen:string>>").alias("diagrams"), F.lit(None).cast("array<string>").alias("notation")).alias(name))
    return page(side("user"), "ref").join(page(side("assistant"), "pred"), "conv_id").withColumnRenamed("conv_id", "page")


_SIDES = """s AS (SELECT conv_id AS page, list(substr(md5(text), 1, 1) ORDER BY turn) FILTER (WHERE role = 'user') AS a, list(substr(md5(text), 1, 1) ORDER BY turn) FILTER (WHERE role = 'assistant') AS b,
  list(length(text) % 3 ORDER BY turn) FILTER (WHERE role = 'user') AS ra, list(length(text) % 3 ORDER BY turn) FILTER (WHERE role = 'assistant') AS rb FROM conversations GROUP BY conv_id),
m AS (SELECT page, levenshtein(array_to_string(a, ''), array_to_string(b, '')) AS errors, len(a) AS total, a = b AS exact, len(list_filter(list_zip(ra, rb), lambda p: p[1] = p[2])) AS right_, greatest(len(ra), len(rb)) AS regions, ra = rb AS ordered FROM s WHERE a IS NOT NULL AND b IS NOT NULL)"""


@query(f"WITH {_SIDES} SELECT page, CAST(errors AS INT) AS line_errors, CAST(total AS INT) AS line_total, exact::INT::DOUBLE AS lines_exact, CAST(right_ AS INT) AS types_right, CAST(regions AS INT) AS types_total, ordered AS types_ordered FROM m")
def a6_page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.page_metrics(page_pairs(spark, sf_dir))
    return out.select("page", F.col("lines.errors").alias("line_errors"), F.col("lines.total").alias("line_total"), F.col("lines.exact").alias("lines_exact"), F.col("layout.right").alias("types_right"), F.col("layout.total").alias("types_total"), F.col("layout.order").alias("types_ordered"))


@query(f"""
WITH {_SIDES} SELECT page % 4 AS part, count(*) AS pages, round(sum(errors) / sum(total), 9) AS line_rate, round(avg(exact::INT), 9) AS lines_exact, round(100.0 * sum(right_) / sum(regions), 9) AS layout_types, bool_and(ordered) AS layout_order FROM m GROUP BY 1
""")
def a12_corpus_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = P.page_metrics(page_pairs(spark, sf_dir)).withColumn("part", F.col("page") % 4)
    r = lambda c: F.round(c, 9).alias(c)
    return P.corpus_metrics(measured, "part").select("part", "pages", r("line_rate"), r("lines_exact"), r("layout_types"), "layout_order")


CLASSES = "(SELECT p_brand AS folder, CASE WHEN p_brand LIKE '%5' THEN NULL WHEN p_brand LIKE '%4' THEN replace(p_brand, '4', '3') ELSE p_brand END AS canonical, CASE WHEN p_brand LIKE '%2' THEN 0 ELSE count(*) END AS samples FROM part GROUP BY p_brand)"


def brand_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as classes: those on 5 have no name, those on 4 belong to another, those on 2 are empty."""
    b = F.col("folder")
    counted = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    named = F.when(b.endswith("4"), F.replace(b, F.lit("4"), F.lit("3"))).when(~b.endswith("5"), b)
    return counted.select("folder", named.alias("canonical"), F.when(b.endswith("2"), F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("samples"))


@query(f"""
WITH c AS (SELECT * FROM {CLASSES}) SELECT c.folder, CASE WHEN samples = 0 THEN 'remove' WHEN canonical IS NULL THEN 'quarantine' WHEN canonical <> c.folder AND o.folder IS NOT NULL THEN 'merge' ELSE 'rename' END AS step,
  CASE WHEN samples > 0 AND canonical IS NOT NULL THEN canonical END AS "to"
FROM c LEFT JOIN (SELECT folder FROM c) o ON canonical = o.folder WHERE samples = 0 OR canonical IS NULL OR canonical <> c.folder
""")
def a36_migration_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.migration_plan(brand_classes(spark, sf_dir))


@query(f"SELECT canonical AS folder, CAST(sum(samples) AS BIGINT) AS samples FROM {CLASSES} WHERE samples > 0 AND canonical IS NOT NULL GROUP BY canonical")
def a36_migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.migrated(brand_classes(spark, sf_dir))[0].select("folder", "samples")


@query("""
SELECT event_type AS engine, round(avg(value), 6) AS quality, round(avg(length(props)), 6) AS cost, CAST(count(*) FILTER (WHERE value < 20) AS BIGINT) AS review_items FROM events GROUP BY 1
""")
def a38_engine_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), F.col("value").alias("quality"), F.length("props").alias("cost"), (F.col("value") < 20).alias("review"))
    out = X.engine_means(cases, "engine", "review", "quality", "cost")
    return out.select("engine", F.round("quality", 6).alias("quality"), F.round("cost", 6).alias("cost"), "review_items")


DIAGRAMS = f"(SELECT p_partkey AS id, {sql_pick(FENS[:2] + ['8/8/8/4k3/8/8/8/4K3', None, ' '], 'p_partkey')} AS fen, p_size > 40 AS review, CASE WHEN p_size < 10 THEN ' ' ELSE p_name END AS legend FROM part)"


@query(f"""
SELECT id, 'no position' AS problem FROM {DIAGRAMS} WHERE trim(coalesce(fen, '')) = '' UNION ALL SELECT id, 'needs review' FROM {DIAGRAMS} WHERE review
UNION ALL SELECT id, 'no legend' FROM {DIAGRAMS} WHERE trim(legend) = '' UNION ALL SELECT id, 'side unknown' FROM {DIAGRAMS} WHERE trim(coalesce(fen, '')) <> '' AND NOT regexp_matches(fen, '^\\S+ [wb]')
""")
def a42_diagram_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fen = pick(FENS[:2] + ["8/8/8/4k3/8/8/8/4K3", None, " "], F.col("p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), fen.alias("fen"), (F.col("p_size") > 40).alias("review"), F.when(F.col("p_size") < 10, " ").otherwise(F.col("p_name")).alias("legend"))
    return P.diagram_report(rows)


_BLOCKS = ["heading", "paragraph", "list", "table", "figure", "diagram", "note", "page_break"]


@query(f"""
WITH b AS (SELECT user_id % 20 AS doc, {sql_pick(_BLOCKS, 'event_id')} AS kind, event_id % 6 = 0 AS warned FROM events)
SELECT doc, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in _BLOCKS)}, count(*) FILTER (WHERE warned) AS with_warnings FROM b GROUP BY doc
""")
def a45_conversion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    blocks = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("doc"), pick(_BLOCKS, k).alias("kind"), F.when(k % 6 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return P.conversion_report(blocks, "doc")


@query("""
WITH r AS (SELECT o_orderkey AS item, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders), g AS (SELECT DISTINCT root FROM r),
h AS (SELECT root, row_number() OVER (ORDER BY sha256(root || ':9')) AS k, count(*) OVER () AS n FROM g)
SELECT item, root, CASE WHEN k <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) THEN 'test' WHEN k <= greatest(1, round_even(n * 0.1::DOUBLE, 0)) + greatest(1, round_even(n * 0.2::DOUBLE, 0)) THEN 'validation' ELSE 'train' END AS split FROM r JOIN h USING (root)
""")
def g3_document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer stay together."""
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), "o_custkey")
    return C.split_by_components(items, "item", ["o_custkey"], 0.2, 0.1, 9)


@query(f"SELECT o_orderkey AS id FROM orders WHERE {sql_pick(['train', 'holdout'], 'o_custkey')} = 'holdout' AND {sql_pick(['reviewed', 'open', 'reviewed'], 'o_orderkey')} = 'reviewed' AND o_orderkey % 5 <> 0 AND o_orderstatus <> 'P' AND o_totalprice > 2000")
def g6_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pages = table(spark, sf_dir, "orders").select(
        k.alias("id"), pick(["train", "holdout"], F.col("o_custkey")).alias("split"), pick(["reviewed", "open", "reviewed"], k).alias("status"), F.when(k % 5 == 0, True).alias("synthetic"),
        F.when(F.col("o_orderstatus") != "P", "image").alias("image"), F.when(F.col("o_totalprice") > 2000, "text").alias("reference"),
    )
    return R.holdout(pages).select("id")


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value FROM events WHERE event_id % 4 <> 1 AND event_type <> 'view'), b AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer)
SELECT CAST(event_id AS VARCHAR) AS record_id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'diagram' WHEN c_mktsegment = 'BUILDING' THEN 'chess_sequence' ELSE 'paragraph' END AS kind,
  CASE WHEN c_acctbal < 0 THEN 0.0 ELSE 0.25 END::DOUBLE AS confidence, CASE WHEN c_mktsegment = 'MACHINERY' THEN 100.0 WHEN c_mktsegment = 'BUILDING' THEN 85.0 ELSE 50.0 END::DOUBLE AS impact
FROM e JOIN b ON user_id = c_custkey
""")
def g7_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that change customers; every fourth is an undo and views are left out."""
    k, none = F.col("event_id"), F.array().cast("array<string>")
    events = table(spark, sf_dir, "events").where("event_type <> 'view'").select(
        k.cast("string").alias("event_id"), F.lit("d").alias("document_id"), F.lit("p").alias("page_id"), F.col("user_id").cast("string").alias("target_id"), F.lit("a").alias("before"), F.lit("b").alias("after"),
        F.when(k % 4 == 1, F.array(F.lit("undo"))).when(k % 4 == 2, F.array(F.lit("other"))).otherwise(none).alias("reason_codes"), F.lit("u").alias("user"),
    )
    kind = F.when(F.col("c_mktsegment") == "MACHINERY", "diagram").when(F.col("c_mktsegment") == "BUILDING", "chess_sequence").otherwise("paragraph")
    blocks = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), kind.alias("kind"), F.lit("s").alias("source_id"), F.when(F.col("c_acctbal") < 0, F.array().cast("array<double>")).otherwise(F.array(F.lit(0.5), F.lit(0.25))).alias("confidences"))
    return R.corrections(events, blocks).select("record_id", "kind", "confidence", "impact")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def g9_equal_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of one region differ by generated ids only."""
    n = table(spark, sf_dir, "nation")
    side = lambda s: n.select(F.col("n_nationkey").alias(s), F.col("n_regionkey").alias(f"r{s}"), F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias(f"x{s}"))
    pairs = side("a").join(side("b"), (F.col("ra") == F.col("rb")) & (F.col("a") < F.col("b")))
    return pairs.where(P.equal_without(F.col("xa"), F.col("xb"), "id", "name")).select("a", "b")


@query("""
WITH a AS (SELECT 'e' || p_partkey AS name, sha256(p_type) AS sha FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT 'e' || p_partkey AS name, sha256(CASE WHEN p_size = 7 THEN 'other' ELSE p_type END) AS sha FROM part WHERE p_partkey % 13 <> 0)
SELECT name, CASE WHEN a.sha IS NULL THEN 'added' WHEN b.sha IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (name) WHERE a.sha IS DISTINCT FROM b.sha
""")
def g10_checkpoint_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two archives by name and digest."""
    part, name = table(spark, sf_dir, "part"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("name")
    before = part.where("p_partkey % 11 <> 0").select(name, F.sha2("p_type", 256).alias("sha"))
    after = part.where("p_partkey % 13 <> 0").select(name, F.sha2(F.when(F.col("p_size") == 7, "other").otherwise(F.col("p_type")), 256).alias("sha"))
    return C.difference(before, after, "name", F.col("sha"))


@query(r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: w = 'the')) AS INT) AS whole, CAST(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w = 'the')) AS INT) AS any_case,
  CAST(len(regexp_extract_all(text, 't.?e')) AS INT) AS expression, CAST((length(text) - length(replace(text, 't.', ''))) // 2 AS INT) AS literal FROM documents
""")
def f1_search_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda s: S.count(F.col("text"), s)
    return table(spark, sf_dir, "documents").select(
        "doc_id", count(S.Search("the", whole_word=True)).alias("whole"), count(S.Search("the", whole_word=True, ignore_case=True)).alias("any_case"), count(S.Search("t.?e", regex=True)).alias("expression"), count(S.Search("t.")).alias("literal")
    )


CONFUSED = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u")]


@query(f"""
WITH RECURSIVE {LEXICON}, c(read, meant) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CONFUSED)}), u AS (SELECT DISTINCT w.word FROM (SELECT replace(replace(word, 'm', 'rn'), 'd', 'cl') AS word FROM lex) w LEFT JOIN lex ON lex.word = w.word WHERE lex.word IS NULL AND length(w.word) >= 3),
p AS (SELECT word, i, read, meant FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM u) JOIN c ON substr(word, i, length(read)) = read),
m(word, done, "at", k) AS (SELECT word, substr(word, 1, i - 1) || meant, i + length(read), 1 FROM p UNION SELECT m.word, done || substr(m.word, "at", i - "at") || meant, i + length(read), k + 1 FROM m JOIN p ON p.word = m.word AND i >= "at" WHERE k < 3),
t AS (SELECT DISTINCT m.word, done || substr(m.word, "at") AS "to" FROM m), g AS (SELECT t.* FROM t JOIN lex ON lex.word = "to" WHERE freq >= 5 AND length("to") >= 3)
SELECT word, min("to") AS "to" FROM g GROUP BY word HAVING count(*) = 1
""")
def f7_joined_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lexicon with letters read as two, back to words of a frequency of five or more."""
    known = lexicon(spark, sf_dir)
    asked = known.select(F.replace(F.replace("word", F.lit("m"), F.lit("rn")), F.lit("d"), F.lit("cl")).alias("word"))
    return P.joined_letters(asked, known, spark.createDataFrame(CONFUSED, "read string, meant string"), least=5.0)


AFFIXES = [("suffix", "S", "", "s", "[^s]", True), ("suffix", "E", "e", "ing", "e", True), ("suffix", "N", "", "", "n", False), ("suffix", "T", "t", "tion", ".", False), ("prefix", "U", "", "un", ".", True), ("prefix", "R", "", "re", "[^e]", False)]
_AFFIX = ", ".join(f"('{k}', '{f}', '{s}', '{a}', '{c}', {str(x).lower()})" for k, f, s, a, c, x in AFFIXES)
#: The flags of a root follow from its length.
_FLAGS = {2: "SU", 3: "EU", 4: "SNR", 5: "TR", 6: "SU", 7: "ER"}


@query(f"""
WITH {LEXICON}, a(kind, flag, strip, add, condition, crossed) AS (VALUES {_AFFIX}), f(n, flag) AS (VALUES {', '.join(f"({n}, '{x}')" for n, xs in _FLAGS.items() for x in xs)}),
r AS (SELECT word AS root, flag FROM lex JOIN f ON n = length(word)), w AS (SELECT DISTINCT word FROM {WORDS}),
x AS (SELECT word, substr(word, 1, length(word) - length(add)) || strip AS root, flag, condition FROM w JOIN a ON kind = 'suffix' AND length(add) < length(word) AND ends_with(word, add)),
s AS (SELECT word, x.root, x.flag FROM x JOIN r ON r.root = x.root AND r.flag = x.flag WHERE condition = '.' OR regexp_matches(x.root, condition || '$')),
p AS (SELECT word, strip || substr(word, length(add) + 1) AS rest, flag, condition, crossed FROM w JOIN a ON kind = 'prefix' AND length(add) < length(word) AND starts_with(word, add)),
d AS (SELECT word, rest AS root, p.flag FROM p JOIN r ON r.root = rest AND r.flag = p.flag WHERE condition = '.' OR regexp_matches(rest, '^' || condition)),
y AS (SELECT p.word, substr(rest, 1, length(rest) - length(add)) || strip AS root, p.flag, p.condition AS pc, a.flag AS sf, a.condition AS sc FROM p JOIN a ON a.kind = 'suffix' AND a.crossed AND length(add) < length(rest) AND ends_with(rest, add) WHERE p.crossed),
b AS (SELECT y.word, y.root, y.flag FROM y JOIN r ON r.root = y.root AND r.flag = y.sf JOIN r q ON q.root = y.root AND q.flag = y.flag WHERE (sc = '.' OR regexp_matches(y.root, sc || '$')) AND (pc = '.' OR regexp_matches(y.root, '^' || pc)))
SELECT * FROM s UNION SELECT * FROM d UNION SELECT * FROM b UNION SELECT word, word, NULL FROM w JOIN r ON r.root = word
""")
def f8_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the documents against the lexicon as roots."""
    known = lexicon(spark, sf_dir)
    flags = F.create_map(*(F.lit(x) for n, fs in _FLAGS.items() for x in (n, fs)))
    roots = known.select(F.col("word").alias("root"), F.explode(F.split(F.try_element_at(flags, F.length("word")), "")).alias("flag")).where("flag <> ''")
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0))).alias("word")).distinct()
    return M.strip_affixes(words, roots, spark.createDataFrame(AFFIXES, "kind string, flag string, strip string, add string, condition string, crossed boolean"))


@query(f"""
WITH b AS (SELECT l_orderkey, pos, CAST(round_even(l_quantity, 0) AS INT) AS x1, CAST(round_even(l_quantity + l_tax * 100 - 2.5, 0) AS INT) AS x2, CAST(round_even(l_discount * 100, 0) AS INT) AS y1, CAST(round_even(l_tax * 100 + 1.5, 0) AS INT) AS y2 FROM {LINE_ITEMS})
SELECT l_orderkey, pos, x2 - x1 AS width, y2 - y1 AS height, (x2 - x1) * (y2 - y1) AS area, x2 > x1 AND y2 > y1 AS valid FROM b
""")
def f10_box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, tax = F.col("l_quantity"), F.col("l_tax") * 100
    rows = line_items(spark, sf_dir).select("l_orderkey", "pos", q.alias("x1"), (q + tax - 2.5).alias("x2"), (F.col("l_discount") * 100).alias("y1"), (tax + 1.5).alias("y2"))
    g = P.box_geometry()
    return rows.select("l_orderkey", "pos", *(g[k].alias(k) for k in ("width", "height", "area", "valid")))


GAMES = ["1. e4 e5 (1... c5 2. Nf3 {open (sic)} $1) 2. Nf3 1-0", "1.d4 d5 2.c4 $6 (2.Nf3 Nf6 (2...e6)) ; rest\n2...e6 *", "{only a comment} 0-1", "", "1. e4 ((("]
#: By kind: comment, open, close, nag, number, result, move; and the greatest depth (fixed by hand).
_LEXEMES = [(1, 1, 1, 1, 4, 1, 5, 1), (1, 2, 2, 1, 5, 1, 7, 2), (1, 0, 0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 0, 0, 0, 0), (0, 3, 0, 0, 1, 0, 1, 3)]
_LEXEME_KINDS = ["comment", "open", "close", "nag", "number", "result", "move"]


@query(f"""
WITH k AS (SELECT p_partkey, ({[list(x) for x in _LEXEMES]})[CAST(p_partkey % 5 + 1 AS INT)] AS n FROM part)
SELECT p_partkey, {', '.join(f"CAST(n[{i + 1}] AS INT) AS {k}" for i, k in enumerate(_LEXEME_KINDS))}, CAST(n[8] AS INT) AS depth FROM k
""")
def f11_lexemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of lexemes and nesting of game texts; the SQL has them counted by hand."""
    found = table(spark, sf_dir, "part").select("p_partkey", N.lexemes(pick(GAMES, F.col("p_partkey"))).alias("x"))
    return found.select("p_partkey", *(F.size(F.filter("x", _of_kind(k))).alias(k) for k in _LEXEME_KINDS), F.coalesce(F.array_max(F.transform("x", lambda e: e["depth"])), F.lit(0)).alias("depth"))


def _of_kind(kind: str):
    return lambda e: e["kind"] == kind


@query("SELECT l_orderkey, pos, translate(token, 'KQRBN', '♔♕♖♗♘') AS figures, token AS letters FROM " + TOKENS + " WHERE regexp_matches(token, '^[KQRBN][a-h][1-8]')")
def f14_piece_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = move_tokens(spark, sf_dir).where(F.col("token").rlike("^[KQRBN][a-h][1-8]"))
    drawn = moves.select("l_orderkey", "pos", N.to_figures(F.col("token")).alias("figures"))
    return drawn.select("l_orderkey", "pos", "figures", N.to_letters(F.col("figures")).alias("letters"))


@query(f"""
WITH n(code, sign) AS (VALUES {', '.join(f"({k}, '{v}')" for k, v in P.NAGS.items())}), x AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 21 END AS code, CASE WHEN l_linenumber % 2 = 1 THEN {sql_pick(['', '!', '?!', '±', 'x'], 'l_partkey')} END AS sign FROM lineitem),
c AS (SELECT CAST(coalesce(x.code, n.code) AS INT) AS code FROM x LEFT JOIN n ON x.code IS NULL AND x.sign = n.sign)
SELECT c.code, n.sign, count(*) AS n FROM c LEFT JOIN n ON n.code = c.code WHERE c.code IS NOT NULL GROUP BY ALL
""")
def f16_nags(spark: SparkSession, sf_dir: str) -> DataFrame:
    nag = F.col("l_linenumber") % 2 == 0
    text = F.when(nag, F.concat(F.lit("$"), (F.col("l_suppkey") % 21).cast("string"))).otherwise(F.concat(F.lit("e4"), pick(["", "!", "?!", "±", "x"], F.col("l_partkey"))))
    return P.nag_counts(table(spark, sf_dir, "lineitem").select(F.when(nag, "nag").otherwise("move").alias("kind"), text.alias("text")))


#: Lines (text, domain, source, primary, engine text, dropped, filled, similarity) with the reasons and the confidence they get, by hand.
SUSPECT = [
    ("plain words here", "prose", "line", "line", "plain words here", 0, 0, 0.9, "", 0.9),
    ("words", "prose", "glyph", "line", "other", 0, 0, 0.9, "engine_disagreed", 0.5),
    ("words", "prose", "glyph", "line", "", 0, 0, 0.9, "engine_missing", 0.65),
    ("1.e4 e5 2.♘", "notation", "glyph", "glyph", "", 2, 1, None, "dropped_in_notation,malformed_move", 0.3),
    ("", "notation", "glyph", "glyph", "", 1, 0, None, "line_lost", 0.1),
    ("a|b c", "prose", "line", "line", "", 0, 0, 1.0, "engine_garbage", 0.75),
]


@query(f"""
WITH k(i, reasons, confidence) AS (VALUES {', '.join(f"({i}, '{s[8]}', CAST({s[9]} AS DOUBLE))" for i, s in enumerate(SUSPECT))})
SELECT p_partkey, reasons, confidence FROM part JOIN k ON i = p_partkey % {len(SUSPECT)}
""")
def f18_f19_suspicions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons and confidence of lines; the SQL has them by hand."""
    schema = "i long, text string, domain string, source string, primary string, engine_text string, dropped int, filled int, similarity double"
    kinds = spark.createDataFrame([(i, *s[:8]) for i, s in enumerate(SUSPECT)], schema).withColumn("fragment", F.lit(False)).withColumn("anchor", F.lit(""))
    met = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(SUSPECT)).alias("i")).join(F.broadcast(kinds), "i").withColumn("codes", R.line_reasons())
    return met.select("p_partkey", F.concat_ws(",", "codes").alias("reasons"), F.round(R.line_confidence(F.col("codes"), F.col("similarity"), F.col("source")), 4).alias("confidence"))


SAID = [("White to move", "12...Kd7", "w"), ("Diagram 3: Black to move and win", "", "b"), ("", "12...Kd7", "b"), ("", "12.Kd7", "w"), ("A quiet position", "Kd7", None), ("Schwarz am Zug", "1.e4", "b")]


@query(f"WITH k(i, side) AS (VALUES {', '.join(f'({i}, ' + ('NULL' if s is None else repr(s)) + ')' for i, (_, _, s) in enumerate(SAID))}) SELECT p_partkey, side FROM part JOIN k ON i = p_partkey % {len(SAID)}")
def f20_side_to_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", N.side_to_move(pick([s[0] for s in SAID], k), pick([s[1] for s in SAID], k)).alias("side"))


@query("""
SELECT o_orderkey, sha256('{"p0":' || o_orderkey || ',"p1":"' || o_orderstatus || '","p2":"v1"}') AS cache_key FROM orders
""")
def h2_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", R.cache_key(F.col("o_orderkey"), F.col("o_orderstatus"), F.lit("v1")).alias("cache_key"))


@query("SELECT sha256('{\"p0\":' || count(*) || ',\"p1\":' || min(o_orderkey) || ',\"p2\":' || max(o_orderkey) || '}') AS fingerprint FROM orders")
def h3_protocol_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of what a protocol fixes: number and range of its cases."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.min(k).alias("a"), F.max(k).alias("b")).select(R.cache_key(F.col("n"), F.col("a"), F.col("b")).alias("fingerprint"))


@query("SELECT p_partkey, translate(p_type, 'AEIOU', '♔♕♖♗♘') AS text FROM part")
def x8_substituted_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of a legacy font to the characters they print."""
    return table(spark, sf_dir, "part").select("p_partkey", N.substituted(F.col("p_type"), dict(zip("AEIOU", "♔♕♖♗♘", strict=True))).alias("text"))


@query("""
WITH r AS (SELECT p_type, percentile_cont(0.05) WITHIN GROUP (ORDER BY p_size) AS low, percentile_cont(0.95) WITHIN GROUP (ORDER BY p_size) AS high FROM part GROUP BY p_type)
SELECT p_type, low, high FROM r
""")
def x6_bounds_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stroke weights accepted of every class."""
    return R.bounds_by_class(table(spark, sf_dir, "part"), "p_type", "p_size", 0.05, 0.95)


@query("SELECT s_suppkey, CAST(greatest(1, least(8, 6, floor(least(s_acctbal, 4000) / 700))) AS INT) AS workers FROM supplier")
def t11_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many workers every memory allows."""
    from folioscope.streaming.journal import allowed_workers

    return table(spark, sf_dir, "supplier").select("s_suppkey", allowed_workers(F.lit(8), F.lit(6), F.lit(4000.0), F.col("s_acctbal"), F.lit(700.0)).alias("workers"))


#: Positions with their legality, the number of legal moves and the side that legality leaves to move, by hand.
POSITIONS = [
    (rules.START, True, 20, None), ("8/8/8/4k3/8/8/8/4K3 w - -", True, 5, None), ("8/8/8/4k3/8/8/8/4K3 b - -", True, 8, None), ("4k3/8/8/8/8/8/4r3/4K3 b - -", False, None, "w"),
    ("4k3/4R3/8/8/8/8/8/4K3 b - -", True, 3, "b"), ("P3k3/8/8/8/8/8/8/4K3 w - -", False, None, None), ("no position", False, None, None), ("4k3/8/8/8/8/8/8/R3K2R w KQ -", True, 26, None),
]
_HELD = ", ".join(f"({i}, {str(ok).lower()}, {'NULL' if n is None else n}, {'NULL' if side is None else repr(side)})" for i, (_, ok, n, side) in enumerate(POSITIONS))


@query(f"SELECT p_partkey, legal, CAST(moves AS INT) AS moves, side FROM part JOIN (VALUES {_HELD}) k(i, legal, moves, side) ON i = p_partkey % {len(POSITIONS)}")
def f12_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legality, legal moves and the only possible side to move of positions; the SQL has them by hand."""
    kinds = spark.createDataFrame([(i, f) for i, (f, *_) in enumerate(POSITIONS)], "i long, fen string")
    judged = kinds.select("i", rules.is_legal("fen").alias("legal"), F.size(rules.moves_of("fen")).alias("moves"), rules.side_of_legality("fen").alias("side"))
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % len(POSITIONS)).alias("i"))
    return rows.join(F.broadcast(judged), "i").select("p_partkey", "legal", F.when(F.col("legal"), F.col("moves")).alias("moves"), "side")


READ = [["e4", "e5", "♘f3", "Nc6", "Bb5"], ["e4", "c5", "Nf8", "d6"], ["e4", "e5", "Zz9"], ["d4", "d5", "c4", "dxc4", "Nxc4"], ["e4", "e5", "Nf3", "Nc6", "Bc4", "Bc5", "0-0"]]
_VERDICTS = ["exact,exact,exact,exact,exact", "exact,exact,repaired,exact", "exact,exact,illegal", "exact,exact,exact,exact,illegal", "exact,exact,exact,exact,exact,exact,exact"]


@query(f"SELECT p_partkey, ({_VERDICTS})[CAST(p_partkey % {len(READ)} + 1 AS INT)] AS verdicts, ({['Bb5', 'd6', '', '', 'O-O']})[CAST(p_partkey % {len(READ)} + 1 AS INT)] AS last FROM part")
def f12_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the moves of games as they were read; the SQL has them by hand."""
    games = F.element_at(F.array(*(F.array(*(F.lit(t) for t in g)) for g in READ)), (F.col("p_partkey") % len(READ) + 1).cast("int"))
    out = table(spark, sf_dir, "part").select("p_partkey", rules.replay(F.lit(rules.START), games).alias("r"))
    return out.select("p_partkey", F.concat_ws(",", F.transform("r", lambda x: x["verdict"])).alias("verdicts"), F.element_at("r", -1)["move"].alias("last"))


_GAME = [(1, True, "e4"), (1, False, "e5"), (2, True, "Nf3"), (2, True, "d4"), (2, False, "Nc6"), (4, True, "Bb5"), (3, True, "Ke3"), (3, True, "Bb5")]


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'main,main,main,variation,main,stop,stop,main' ELSE 'main,main,main,variation,deviation,stop,stop,stop' END AS fates FROM part
""")
def f13_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A game whose page also holds a variation, a missing number and an impossible move; every other copy has a foreign diagram before the fifth move."""
    odd = F.col("p_partkey") % 2 == 1
    fens = F.array(*(F.when(odd, F.lit(rules.START)).otherwise(F.lit(None).cast("string")) if i == 4 else F.lit(None).cast("string") for i in range(len(_GAME))))
    fates = rules.assembly(F.array(*(F.lit(n) for n, _, _ in _GAME)), F.array(*(F.lit(w) for _, w, _ in _GAME)), F.array(*(F.lit(t) for _, _, t in _GAME)), fens)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(fates, ",").alias("fates"))
