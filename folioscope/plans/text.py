"""Queries over texts: statistics, normalisation, shapes, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import notation as N
from folioscope.functions import text as T
from folioscope.operators import documents as D
from folioscope.operators import matching as M
from folioscope.operators import search as S
from folioscope.plans.registry import query, table
from folioscope.sources import readers as R
from folioscope.sources import writers as W

LINES = "(SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


@query("""
SELECT lang, source, count(*) AS docs, CAST(sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) AS BIGINT) AS words,
  CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(regexp_replace(text, '[ \\t\\r\\n]', '', 'g'))) AS BIGINT) AS visible_chars,
  CAST(sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))) AS BIGINT) AS paragraphs
FROM documents GROUP BY ROLLUP (lang, source)
""")
def a29_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted once per document, below the rows that the rollup multiplies
    counted = table(spark, sf_dir, "documents").select(
        "lang",
        "source",
        F.regexp_count("text", F.lit(T.WORD)).alias("words"),
        F.length("text").alias("chars"),
        F.length(F.regexp_replace("text", r"[ \t\r\n]", "")).alias("visible_chars"),
        F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")).alias("paragraphs"),
    )
    per_source = counted.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs"), *(F.sum(c).alias(c) for c in ("words", "chars", "visible_chars", "paragraphs")))
    return per_source.rollup("lang", "source").agg(*(F.sum(c).cast("bigint").alias(c) for c in ("docs", "words", "chars", "visible_chars", "paragraphs")))


@query("""
SELECT c AS char, count(*) AS n, count(DISTINCT doc_id) AS docs
FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS c FROM documents)
WHERE c <> '' GROUP BY c
""")
def a30_char_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    foreign = F.regexp_replace("text", r"[\x00-\x7F]", "")
    chars = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(foreign, "")).alias("char")).where("char <> ''")
    per_doc = chars.groupBy("doc_id", "char").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("char").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
f AS (SELECT word, count(*) AS freq FROM w GROUP BY word)
SELECT word, freq, round(least(1.0, 0.5 + ln(1 + freq) / ln(1 + (SELECT sum(freq) FROM f))), 9) AS score FROM f
""")
def a31_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the total needs no words: a sum of counts per document
    total = table(spark, sf_dir, "documents").agg(F.sum(F.regexp_count("text", F.lit(T.WORD)))).first()[0] or 0
    return vocabulary(spark, sf_dir).select("word", "freq", F.round(F.least(F.lit(1.0), 0.5 + F.log1p("freq") / F.log1p(F.lit(float(total)))), 9).alias("score"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0)))
    return table(spark, sf_dir, "documents").select(words.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


SIGNATURE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '[0-9]+', '', 'g'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
CANDIDATE = """len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) BETWEEN 1 AND 8 AND regexp_matches(line, '[\\p{L}\\p{N}]')
  AND NOT (starts_with(line, '(') AND ends_with(line, ')'))
  AND len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '' AND (
    length(trim(regexp_replace(w, '^\\d+\\.(\\.\\.)?', ''), '+#!?±∓⩱⩲=∞.,;:)(')) BETWEEN 1 AND 8
    AND (replace(upper(trim(regexp_replace(w, '^\\d+\\.(\\.\\.)?', ''), '+#!?±∓⩱⩲=∞.,;:)(')), '0', 'O') IN ('O-O', 'O-O-O')
      OR (regexp_matches(trim(regexp_replace(w, '^\\d+\\.(\\.\\.)?', ''), '+#!?±∓⩱⩲=∞.,;:)('), '^[KQRBNabcdefgh0O]')
        AND regexp_matches(trim(regexp_replace(w, '^\\d+\\.(\\.\\.)?', ''), '+#!?±∓⩱⩲=∞.,;:)('), '[a-h][1-8]')))))) = 0"""


@query(f"""
SELECT signature, count(*) AS docs FROM (SELECT DISTINCT doc_id, {SIGNATURE} AS signature FROM {LINES} WHERE {CANDIDATE})
GROUP BY signature HAVING count(*) >= 3
""")
def a32_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.running_lines(lines(spark, sf_dir), 3, doc="doc_id")


@query(f"""
WITH m AS (SELECT doc_id, pos, {SIGNATURE} AS signature, ({CANDIDATE}) AS c FROM {LINES}),
f AS (SELECT signature FROM m WHERE c GROUP BY signature HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS kept FROM m WHERE NOT (c AND signature IN (SELECT signature FROM f)) GROUP BY doc_id
""")
def a32_without_running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.without_running_lines(lines(spark, sf_dir), 3, doc="doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
  '[ \t\x0B\f ]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS digest FROM documents
""")
def p1_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text of these tables changes under compatibility composition, so plain SQL gives the same."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalised(F.col("text")), 256).alias("digest"))


@query(r"""
SELECT doc_id, sha256(replace(translate(text, '–—−‐‑“”„«»‘’‚†✝', '-----' || repeat(chr(34), 5) || chr(39) || chr(39) || chr(39) || '++'), '…', '...')) AS digest
FROM documents
""")
def p2_typography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.plain_typography(F.col("text")), 256).alias("digest"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS word FROM documents)
SELECT doc_id, count(*) AS words, count(DISTINCT regexp_extract(word, '^[^\p{L}]*(.*?)[^\p{L}]*$', 1)) AS cores,
  CAST(sum(length(regexp_extract(word, '^([^\p{L}]*)', 1))) AS BIGINT) AS offsets
FROM w WHERE regexp_matches(word, '\p{L}') GROUP BY doc_id
""")
def p5_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))
    return words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.countDistinct(T.core(F.col("word"))).alias("cores"), F.sum(T.core_offset(F.col("word"))).cast("bigint").alias("offsets")
    )


_BARE = "trim(w, '" + T.EDGE.replace("'", "''") + "')"
NOTATION = "(" + " OR ".join([f"regexp_matches(w, '{p}')" for p in (T.FIGURE, T.MOVE_NUMBER, T.EVALUATION)] + [f"regexp_matches({_BARE}, '{p}')" for p in (T.STRICT_MOVE, T.RESULT)]) + ")"


@query(f"""
WITH t AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '') AS ws FROM {LINES}),
k AS (SELECT *, len(list_filter(ws, lambda w: {NOTATION})) AS n, len(list_filter(ws, lambda w: NOT {NOTATION} AND regexp_matches(w, '\\p{{L}}'))) AS p FROM t)
SELECT CASE WHEN n = 0 AND p = 0 THEN 'unknown' WHEN p = 0 THEN 'notation' WHEN n = 0 THEN 'prose' ELSE 'mixed' END AS domain, count(*) AS lines
FROM k GROUP BY 1
""")
def p12_line_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy(T.domain(F.col("line")).alias("domain")).agg(F.count(F.lit(1)).alias("lines"))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS word FROM documents),
l AS (SELECT *, regexp_replace(word, '[^\\p{L}]', '', 'g') AS x FROM w)
SELECT word, count(*) AS n FROM l WHERE length(x) >= 3 AND x <> lower(x) AND x <> upper(x) AND NOT regexp_matches(x, '^\\p{Lu}[^\\p{Lu}]*$') GROUP BY word
""")
def p16_strange_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0))).alias("word"))
    return words.where(T.strange_case(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT doc_id, regexp_matches(text, 'Ã[\\x{80}-¿]|Â[ -¿]|â\\x{80}|â€') AS mojibake,
  length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) > 0 AS foreign_chars FROM documents
""")
def p17_screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.mojibake(F.col("text")).alias("mojibake"), F.col("text").rlike(r"[^\x00-\x7F]").alias("foreign_chars"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages
""")
def p26_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.visible_text(F.col("html")).alias("text"))


STOP = {"en": ["the", "and", "of", "to"], "de": ["der", "die", "und", "von"], "fr": ["le", "les", "et", "des"], "es": ["el", "los", "que", "del"]}
_STOP_SQL = ", ".join(f"('{k}', '{w}')" for k, v in STOP.items() for w in v)


@query(f"""
WITH s(language, word) AS (VALUES {_STOP_SQL}),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS word FROM documents),
h AS (SELECT doc_id, language, count(*) AS hits FROM w JOIN s USING (word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, language) AS place,
  lead(hits) OVER (PARTITION BY doc_id ORDER BY hits DESC, language) AS second FROM h)
SELECT d.doc_id, r.language FROM documents d LEFT JOIN (SELECT * FROM r WHERE place = 1 AND hits >= 5 AND hits >= 2 * coalesce(second, 0)) r USING (doc_id)
""")
def p23_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language with most stop words, if they are enough and twice those of the runner-up."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents")
    known = F.create_map(*(F.lit(x) for k, v in STOP.items() for w in v for x in (w, k)))
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    hits = words.withColumn("language", F.try_element_at(known, "word")).where("language is not null").groupBy("doc_id", "language").agg(F.count(F.lit(1)).alias("hits"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "language")
    ranked = hits.withColumn("place", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("hits").over(order), F.lit(0)))
    best = ranked.where("place = 1 and hits >= 5 and hits >= 2 * second").select("doc_id", "language")
    return docs.select("doc_id").join(best, "doc_id", "left")


@query("""
SELECT lang, CAST(sum(len(list_filter(regexp_extract_all(text, '(?im)(?:the|der|la)'), lambda m: m <> ''))) AS BIGINT) AS found FROM documents GROUP BY lang
""")
def f3_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = S.Search("the|der|la", regex=True, ignore_case=True)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(S.count(F.col("text"), find)).cast("bigint").alias("found"))


@query("""
SELECT doc_id, regexp_replace(text, '(\\w+)@(\\w+)', '<\\2:\\1>', 'g') AS text, len(regexp_extract_all(text, '(\\w+)@(\\w+)')) AS n
FROM documents
""")
def f4_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    find = S.Search(r"(\w+)@(\w+)", regex=True, replacement=r"<\2:\1>")
    return table(spark, sf_dir, "documents").select("doc_id", S.replaced_and_counted(F.col("text"), find).alias("r")).select("doc_id", "r.text", F.col("r.n").cast("bigint").alias("n"))


@query(f"""
WITH l AS (SELECT doc_id, pos, line FROM {LINES}), s AS (
  SELECT doc_id, pos, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l
), p AS (SELECT doc_id, pos, start, string_split(line, 'License') AS parts FROM s WHERE contains(line, 'License')),
o AS (SELECT doc_id, pos, start, parts, unnest(range(1, len(parts))) AS i FROM p),
c AS (SELECT doc_id, pos, start, list_sum(list_transform(parts[1:i], lambda x: length(x))) + 7 * (i - 1) AS before FROM o)
SELECT doc_id, CAST(pos + 1 AS INT) AS line, CAST(before + 1 AS INT) AS "column", CAST(start + before AS INT) AS at FROM c
""")
def f2_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of a word."""
    found = S.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", S.Search("License"))
    return found.select("doc_id", F.col("line").cast("int").alias("line"), "column", "at")


@query(r"""
SELECT doc_id, sha256(replace(regexp_replace(text, '\$\$\$', '$', 'g'), '&&&', '&')) AS digest FROM documents
""")
def f5_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = {"dollars": S.Search("$$$", replacement="$"), "ands": S.Search("&&&", replacement="&"), "bad": S.Search("(", regex=True)}
    text, _ = S.batch(F.col("text"), searches, ["dollars", "missing", "bad", "ands"])
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"))


@query(None)
def p18_typography_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(S.proposals("text", "lang")).alias("p"))
    return docs.select("doc_id", "p.*")


@query("""
SELECT doc_id, sha256(text) AS digest, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '"}') AS row_digest FROM documents
""")
def h1_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small = docs.select("lang", "doc_id")
    return docs.select("doc_id", F.sha2("text", 256).alias("digest"), W.digest(small).alias("row_digest"))


@query(f"""
WITH b AS (SELECT doc_id, pos, line FROM {LINES} WHERE trim(line) <> '')
SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10) || string_agg('<p>' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', chr(10) ORDER BY pos)
  || chr(10) || '</body></html>' || chr(10) AS value FROM b GROUP BY doc_id
""")
def s15_html_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = lines(spark, sf_dir).where(F.trim("line") != "").select("doc_id", "pos", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("line").alias("text"))
    return W.exported(blocks, "doc_id", "html")


@query(f"""
WITH b AS (SELECT doc_id, pos, line FROM {LINES} WHERE trim(line) <> '')
SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS value FROM b GROUP BY doc_id
""")
def s17_text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = lines(spark, sf_dir).where(F.trim("line") != "").select("doc_id", "pos", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("line").alias("text"))
    return W.exported(blocks, "doc_id", "text")


@query(None)
def s14_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.html_blocks(table(spark, sf_dir, "pages"), "page_id")


@query(None)
def s16_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.text_blocks(table(spark, sf_dir, "documents"), "doc_id")


@query("""
SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_transform([o_orderkey % 7 + 1, o_orderkey % 7 + 2, o_orderkey % 5 + 1], lambda x: CAST(x AS INT)))), ' ') AS pages
FROM orders
""")
def s28_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked = F.concat((k % 7 + 1).cast("string"), F.lit("-"), (k % 7 + 2).cast("string"), F.lit("; "), (k % 5 + 1).cast("string"))
    numbers = R.page_numbers(asked, F.lit(10))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", F.transform(numbers, lambda n: n.cast("string"))).alias("pages"))


@query("""
SELECT c_custkey, split_part(c_name, '#', 2) || ', ' || split_part(c_name, '#', 1) AS key FROM customer
""")
def f15_player_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", N.player_key(F.replace("c_name", F.lit("#"), F.lit(" "))).alias("key"))


@query(None)
def f6_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type readings of every part."""
    return table(spark, sf_dir, "part").select("p_partkey", M.similarity("p_name", "p_type").alias("similarity"))
