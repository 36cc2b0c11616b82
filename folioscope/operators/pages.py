"""Whole-page metrics and their aggregate, diagrams and notation, reports, repairs from a second reading."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from folioscope.functions import notation as N
from folioscope.functions import text as T
from folioscope.operators import metrics as M


def diagram_counts(ref: Column, pred: Column) -> Column:
    """struct of two arrays of positions: exact (both legal in shape and equal), legal, n_ref, n_pred, missing, spurious."""
    pair = F.zip_with(ref, pred, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    legal = lambda x: F.coalesce(N.fen_shape(x), F.lit(False))
    exact = F.size(F.filter(pair, lambda p: legal(p["a"]) & legal(p["b"]) & (N.fen_key(p["a"]) == N.fen_key(p["b"]))))
    return F.struct(
        exact.alias("exact"), F.size(F.filter(pred, legal)).alias("legal"), F.size(ref).alias("n_ref"), F.size(pred).alias("n_pred"),
        F.greatest(F.size(ref) - F.size(pred), F.lit(0)).alias("missing"), F.greatest(F.size(pred) - F.size(ref), F.lit(0)).alias("spurious"),
    )


def notation_counts(ref: Column, pred: Column) -> Column:
    """struct of two arrays of move texts: exact by position, well-formed predictions, sizes."""
    same = F.size(F.filter(F.zip_with(ref, pred, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    formed = F.size(F.filter(pred, lambda p: F.forall(F.filter(F.split(p, r"\s+"), lambda t: t != ""), T.is_notation)))
    return F.struct(same.alias("exact"), formed.alias("legal"), F.size(ref).alias("n_ref"), F.size(pred).alias("n_pred"))


def page_metrics(pairs: DataFrame) -> DataFrame:
    """One wide row per page of (page, ref, pred: page objects): a metric is null unless both sides have its field.

    text: errors and total of characters; words: over tokens; lines, paragraphs: over items; layout, diagrams, notation.
    """
    both = lambda f: F.col(f"ref.{f}").isNotNull() & F.col(f"pred.{f}").isNotNull()
    clean = lambda c: T.collapsed(F.coalesce(c, F.lit("")))
    rt, pt = clean(F.col("ref.text")), clean(F.col("pred.text"))
    sequence = lambda a, b: F.struct(T.item_distance(a, b).alias("errors"), F.size(a).alias("total"), F.when((F.size(a) > 0) | (F.size(b) > 0), (a == b).cast("double")).alias("exact"))
    items = lambda f: F.when(both(f), sequence(F.transform(f"ref.{f}", clean), F.transform(f"pred.{f}", clean)))
    types = lambda s: F.transform(f"{s}.regions", lambda r: F.coalesce(r["type"], F.lit("unknown")))
    right = F.size(F.filter(F.zip_with(types("ref"), types("pred"), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x))
    fens = lambda s: F.transform(f"{s}.diagrams", lambda d: d["fen"])
    return pairs.select(
        "page",
        F.struct(F.levenshtein(rt, pt).alias("errors"), F.length(rt).alias("total")).alias("text"),
        sequence(T.tokens(rt), T.tokens(pt)).alias("words"),
        items("lines").alias("lines"),
        items("paragraphs").alias("paragraphs"),
        F.when(both("regions"), F.struct(right.alias("right"), F.greatest(F.size("ref.regions"), F.size("pred.regions")).alias("total"), (types("ref") == types("pred")).alias("order"))).alias("layout"),
        F.when(both("diagrams"), diagram_counts(fens("ref"), fens("pred"))).alias("diagrams"),
        F.when(both("notation"), notation_counts(F.col("ref.notation"), F.col("pred.notation"))).alias("notation"),
    )


def corpus_metrics(measured: DataFrame, *by: str) -> DataFrame:
    """Micro rates over all pages of a group; sequences also the macro mean of exactness with null as 0; layout order by all()."""
    rate = lambda f: F.coalesce(F.try_divide(F.sum(f"{f}.errors"), F.sum(f"{f}.total")), F.lit(0.0))
    exact = lambda f: F.avg(F.when(F.col(f).isNotNull(), F.coalesce(F.col(f"{f}.exact"), F.lit(0.0))))
    return measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"), rate("text").alias("cer"), rate("words").alias("wer"), rate("lines").alias("line_rate"), exact("lines").alias("lines_exact"),
        rate("paragraphs").alias("paragraph_rate"), F.try_divide(100.0 * F.sum("layout.right"), F.sum("layout.total")).alias("layout_types"), F.bool_and("layout.order").alias("layout_order"),
        F.try_divide(F.sum("diagrams.exact").cast("double"), F.sum(F.greatest("diagrams.n_ref", "diagrams.n_pred"))).alias("diagrams_exact"),
        F.try_divide(F.sum("diagrams.legal").cast("double"), F.sum("diagrams.n_pred")).alias("diagrams_legal"),
        F.try_divide(F.sum("notation.exact").cast("double"), F.sum(F.greatest("notation.n_ref", "notation.n_pred"))).alias("notation_exact"),
    )


def gated(summary: DataFrame, limits: DataFrame, *names: str) -> DataFrame:
    """Failures of a one-row summary against limits."""
    return M.gate(summary.select(*(F.col(n).cast("double").alias(n) for n in names)).unpivot([], list(names), "metric", "value"), limits)


def diagram_report(diagrams: DataFrame) -> DataFrame:
    """Diagrams to look at: without a position, needing review, without a legend, without a side to move."""
    row = lambda cond, kind: diagrams.where(cond).select("id", F.lit(kind).alias("problem"))
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    out = row(empty("fen"), "no position").unionByName(row(F.coalesce("review", F.lit(False)), "needs review"))
    return out.unionByName(row(empty("legend"), "no legend")).unionByName(row(~empty("fen") & ~F.col("fen").rlike(r"^\S+ [wb]"), "side unknown"))


def conversion_report(blocks: DataFrame, *by: str) -> DataFrame:
    """Objects of a conversion by kind, with those that carry a warning."""
    kinds = ("heading", "paragraph", "list", "table", "figure", "diagram", "note", "page_break")
    return blocks.groupBy(*by).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds), F.count_if(F.size("warnings") > 0).alias("with_warnings"))


def repaired_words(aligned: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Unknown words of one reading (ref) replaced by the aligned word of another (pred), where that one is known."""
    known = lexicon.select("word").distinct()
    a, b = known.select(F.col("word").alias("__a"), F.lit(True).alias("ka")), known.select(F.col("word").alias("__b"), F.lit(True).alias("kb"))
    low = lambda c: F.lower(T.core(F.col(c)))
    met = aligned.join(a, low("ref") == F.col("__a"), "left").join(b, low("pred") == F.col("__b"), "left")
    swap = F.col("ka").isNull() & F.col("kb").isNotNull() & (low("ref") != "")
    return met.select(*aligned.columns, F.when(swap, F.col("pred")).otherwise(F.col("ref")).alias("word"), swap.alias("repaired"))


#: At most so many confusions are undone in one word, as in the rule that is followed.
AT_ONCE = 3


def joined_letters(words: DataFrame, lexicon: DataFrame, confusions: DataFrame, *, shortest: int = 3, least: float | None = None, score: str = "freq") -> DataFrame:
    """Unknown words that up to AT_ONCE confusions (read, meant: such as rn, m) at places apart turn into one known word, and one only.

    Words and results have ``shortest`` letters at least; with ``least`` the known word must reach that ``score``.
    """
    good = lexicon if least is None else lexicon.where(F.col(score) >= least)
    known = lexicon.select("word").distinct()
    aim = good.select(F.col("word").alias("to")).where(F.length("to") >= shortest).distinct()
    unknown = words.select("word").distinct().where(F.length("word") >= shortest).join(known, "word", "left_anti")
    sizes = [r[0] for r in confusions.select(F.length("read")).distinct().collect()]  # lengths of pieces: a handful
    # every piece of such a length meets the confusions by equality
    places = unknown.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i")).withColumn("n", F.explode(F.array(*(F.lit(k) for k in sizes)) if sizes else F.array().cast("array<int>")))
    pieces = places.where("i + n - 1 <= length(word)").withColumn("read", F.expr("substring(word, i, n)"))
    tried = pieces.join(confusions.select("read", "meant").distinct(), "read").select("word", "i", "n", "meant")
    # changes go from left to right: ``done`` is the new text before place ``at``
    made = tried.select("word", F.expr("concat(left(word, i - 1), meant)").alias("done"), (F.col("i") + F.col("n")).alias("at"))
    all_made = made
    for _ in range(AT_ONCE - 1):
        more = made.join(tried, "word").where("i >= at")
        made = more.select("word", F.expr("concat(done, substring(word, at, i - at), meant)").alias("done"), (F.col("i") + F.col("n")).alias("at")).distinct()
        all_made = all_made.unionByName(made)
    to = all_made.select("word", F.expr("concat(done, substring(word, at))").alias("to")).distinct()
    found = to.join(aim, "to", "left_semi")
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.first("to").alias("to")).where("n = 1").select("word", "to")


def character_names(spark, query: str, limit: int = 50) -> DataFrame:
    """code, char and name of characters whose name holds every word of the query, by code."""
    import unicodedata

    def run(batches):
        for b in batches:
            rows = [(c, chr(c), unicodedata.name(chr(c), "")) for c in b["id"] if not 0xD800 <= c < 0xE000]
            yield pd.DataFrame([r for r in rows if r[2]], columns=["code", "char", "name"])

    names = spark.range(0x20, 0x110000).mapInPandas(run, "code bigint, char string, name string")
    for word in query.upper().split():
        names = names.where(F.contains("name", F.lit(word)))
    return names.orderBy("code").limit(limit)


def saved_searches(rows: DataFrame) -> DataFrame:
    """Searches by name; of one name the last."""
    return rows.groupBy("name").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("name", "pos")]), "pos").alias("s")).select("name", "s.*")


def box_geometry() -> dict[str, Column]:
    """area, width, height and validity of columns x1, y1, x2, y2 (rounded to integers, positive area)."""
    c = {k: F.bround(k).cast("int") for k in ("x1", "y1", "x2", "y2")}
    w, h = c["x2"] - c["x1"], c["y2"] - c["y1"]
    return {"width": w, "height": h, "area": w * h, "valid": (w > 0) & (h > 0)}


def equal_without(a: Column, b: Column, *ids: str) -> Column:
    """Whether two structs agree but for generated ids."""
    return F.to_json(a.dropFields(*ids)).eqNullSafe(F.to_json(b.dropFields(*ids)))


def split_with_notes(blocks: DataFrame, notes: DataFrame, at: int, new: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (chapter, pos, refs) from a position on go to a new chapter, and notes (note, chapter) with their references."""
    moved = blocks.withColumn("chapter", F.when(F.col("pos") >= at, new).otherwise(F.col("chapter")))
    where = moved.select(F.explode("refs").alias("note"), F.col("chapter").alias("__to"), "pos").groupBy("note").agg(F.min_by("__to", "pos").alias("__to"))
    return moved, notes.join(where, "note", "left").withColumn("chapter", F.coalesce("__to", "chapter")).drop("__to")


# The NAGs with a printed sign of their own.
NAGS = {1: "!", 2: "?", 3: "!!", 4: "??", 5: "!?", 6: "?!", 10: "=", 13: "∞", 14: "⩲", 15: "⩱", 16: "±", 17: "∓", 18: "+-", 19: "-+"}


def nag_counts(lexemes: DataFrame) -> DataFrame:
    """NAGs ($n) and signs of moves by code in standard order, with their counts."""
    codes = {v: k for k, v in NAGS.items()}
    signs = F.create_map(*(F.lit(x) for k, v in codes.items() for x in (k, v)))
    sign = F.regexp_extract("text", r"([!?]{1,2}|[=∞⩲⩱±∓]|\+-|-\+)$", 1)
    code = F.when(F.col("kind") == "nag", F.substring("text", 2, 9).try_cast("int")).when((F.col("kind") == "move") & (sign != ""), F.try_element_at(signs, sign))
    names = F.create_map(*(F.lit(x) for k, v in NAGS.items() for x in (k, v)))
    return lexemes.select(code.alias("code")).where("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n")).select("code", F.try_element_at(names, "code").alias("sign"), "n").orderBy("code")


def recogniser(read: Callable[[str], tuple[str, float]]):
    """A pluggable reader as an Arrow function: struct<text, confidence, error>; a failing item carries its error."""

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("confidence", DoubleType()), StructField("error", StringType())]))
    def run(items: pd.Series) -> pd.DataFrame:
        out = []
        for item in items:
            try:
                text, confidence = read(item)
                out.append((text, min(max(float(confidence), 0.0), 1.0), None))
            except Exception as failed:  # noqa: BLE001  a plugged-in reader may raise anything
                out.append((None, None, f"{type(failed).__name__}: {failed}"))
        return pd.DataFrame(out, columns=["text", "confidence", "error"])

    return run
