"""Joins and matching: as-of, intervals, grids, lexica, consensus, references between parts of a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioscope.functions import text as T
from folioscope.operators.metrics import CELL, cells, in_cells


def last_before(events: DataFrame, group: str, order: str, is_anchor: Column, value: Column) -> DataFrame:
    """Adds ``anchor``: the value of the nearest anchor row at or before each row of its group."""
    frame = Window.partitionBy(group).orderBy(order, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("anchor", F.last(F.when(is_anchor, value), ignorenulls=True).over(frame))


def in_interval(points: DataFrame, at: str, intervals: DataFrame, width: float) -> DataFrame:
    """Points joined with the intervals [start, end) that hold them.

    Every interval is listed in the cells of ``width`` it crosses, so the join is on the cell and not over all pairs.
    """
    cells = intervals.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    placed = points.withColumn("__cell", F.floor(F.col(at) / width))
    return placed.join(cells, "__cell").where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("__cell")


def grid_neighbours(boxes: DataFrame, page: str, cell: float) -> DataFrame:
    """Pairs (page, a, b), a < b, of boxes of a page that share a square cell of the grid."""
    span = lambda low, high: F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    listed = boxes.select(page, "pos", F.explode(span("x1", "x2")).alias("cx"), "y1", "y2").withColumn("cy", F.explode(span("y1", "y2")))
    a, b = listed.alias("a"), listed.alias("b")
    same = (F.col(f"a.{page}") == F.col(f"b.{page}")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col("a.pos") < F.col("b.pos"))
    return a.join(b, same).select(F.col(f"a.{page}").alias(page), F.col("a.pos").alias("a"), F.col("b.pos").alias("b")).distinct()


def smallest_containing(points: DataFrame, boxes: DataFrame, page: str, cell: float = CELL) -> DataFrame:
    """The box of least area that holds each point (point, x, y), ties to the first. They meet by page and cell."""
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).alias("p")
    b = in_cells(boxes, cell).alias("b")
    met = (F.col(f"p.{page}") == F.col(f"b.{page}")) & (F.col("p.cx") == F.col("b.cx")) & (F.col("p.cy") == F.col("b.cy"))
    inside = F.col("p.x").between(F.col("b.x1"), F.col("b.x2")) & F.col("p.y").between(F.col("b.y1"), F.col("b.y2"))
    area = (F.col("b.x2") - F.col("b.x1")) * (F.col("b.y2") - F.col("b.y1"))
    return p.join(b, met & inside).groupBy(F.col(f"p.{page}").alias(page), F.col("p.point").alias("point")).agg(F.min_by("b.pos", F.struct(area, "b.pos")).alias("box"))


def captions(boards: DataFrame, lines: DataFrame, page: str, reach: float = 0.35, overlap: float = 0.25, cell: float = CELL) -> DataFrame:
    """The nearest line below and above each board: within ``reach`` of its height, covering over ``overlap`` of its width.

    A board is listed in the cells of its zone, itself and its reach; a line meets it in the cells of the line's own.
    """
    c = F.col
    zone = boards.withColumn("room", reach * (c("y2") - c("y1"))).withColumn("cx", cells(c("x1"), c("x2"), cell)).withColumn("cy", cells(c("y1") - c("room"), c("y2") + c("room"), cell))
    b, n = zone.alias("b"), in_cells(lines, cell).alias("n")
    height, width = c("b.y2") - c("b.y1"), c("b.x2") - c("b.x1")
    wide = F.least("b.x2", "n.x2") - F.greatest("b.x1", "n.x1") > overlap * width
    side = F.when(c("n.y1") >= c("b.y2"), "below").when(c("n.y2") <= c("b.y1"), "above")
    gap = F.when(side == "below", c("n.y1") - c("b.y2")).otherwise(c("b.y1") - c("n.y2"))
    same = (c(f"b.{page}") == c(f"n.{page}")) & (c("b.cx") == c("n.cx")) & (c("b.cy") == c("n.cy"))
    met = b.join(n, same & wide & side.isNotNull() & (gap <= reach * height))
    return met.groupBy(c(f"b.{page}").alias(page), c("b.pos").alias("board"), side.alias("side")).agg(F.min_by("n.pos", F.struct(gap, "n.pos")).alias("line"))


def unknown_words(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Rows whose word is not in the lexicon."""
    return words.join(lexicon.select(F.col(word).alias("__known")).distinct(), F.col(word) == F.col("__known"), "left_anti")


def suspects(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Words with a reason: unknown to the lexicon or of strange case; strange case comes first."""
    known = lexicon.select(F.col(word).alias("__known")).distinct().withColumn("__in", F.lit(True))
    reason = F.when(T.strange_case(F.col(word)), "strange_case").when(F.col("__in").isNull(), "unknown")
    return words.join(known, F.lower(word) == F.col("__known"), "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("__known", "__in")


def suggestions(unknown: DataFrame, lexicon: DataFrame, n: int, word: str = "word", score: str = "freq") -> DataFrame:
    """The n best known words for each unknown one: distance up to max(1, length / 3), by (distance, -score, word).

    A word cut into one piece more than the distance allows keeps a piece unchanged, moved by the distance at most: pieces and places
    are the join keys, so that no candidate is lost. Words shorter than that meet by length.
    """
    length = F.length("word")
    limit = F.greatest(F.lit(1), F.floor(length / 3).cast("int"))
    asked = unknown.select(F.col(word).alias("word")).distinct().withColumn("limit", limit)
    known = lexicon.select(F.col(word).alias("candidate"), F.col(score).alias("score"))
    # piece p of k pieces starts after floor(p * length / k) letters
    cut = lambda p: F.floor(p * length / (F.col("limit") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("limit")), lambda p: F.struct(cut(p).alias("start"), F.substring(F.col("word"), cut(p) + 1, cut(p + 1) - cut(p)).alias("piece")))
    cutup = asked.where(length > F.col("limit")).select("word", "limit", F.explode(pieces).alias("p")).select("word", "limit", "p.piece", F.explode(F.sequence(F.greatest(F.col("p.start") - F.col("limit"), F.lit(0)), F.col("p.start") + F.col("limit"))).alias("start"))
    sizes = [r[0] for r in cutup.select(F.length("piece")).distinct().collect()]  # of pieces: a handful

    def of_size(k: int) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.length("candidate") - k), lambda i: F.struct(F.substring(F.col("candidate"), i + 1, F.lit(k)).alias("piece"), i.alias("start")))
        return F.when(F.length("candidate") >= k, cuts).otherwise(F.array().cast("array<struct<piece:string,start:int>>"))

    places = F.flatten(F.array(*(of_size(k) for k in sizes or [1])))
    spread = known.select("candidate", "score", F.explode(F.array_distinct(places)).alias("p")).select("candidate", "score", "p.piece", "p.start")
    met = cutup.join(spread, ["piece", "start"]).where(F.abs(length - F.length("candidate")) <= F.col("limit")).select("word", "limit", "candidate", "score").distinct()
    tiny = asked.where(length <= F.col("limit")).withColumn("len", F.explode(F.sequence(F.lit(0), length + F.col("limit"))))
    met = met.unionByName(tiny.join(known.withColumn("len", F.length("candidate")), "len").select("word", "limit", "candidate", "score"))
    near = met.withColumn("distance", F.levenshtein("word", "candidate")).where(F.col("distance") <= F.col("limit"))
    place = F.row_number().over(Window.partitionBy("word").orderBy("distance", F.desc("score"), "candidate"))
    return near.withColumn("place", place).where(F.col("place") <= n).select("word", "place", "candidate", "distance")


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all characters (longest-block matching)."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """ratio() of two readings, case folded and alphanumeric only; 0 if either is empty."""
    clean = lambda s: "".join(c for c in (s or "").casefold() if c.isalnum())
    return pd.Series([ratio(x, y) if x and y else 0.0 for x, y in zip(a.map(clean, na_action=None), b.map(clean, na_action=None), strict=True)], dtype="float64")


def joined_hyphens(lines: DataFrame, lexicon: DataFrame, doc: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """Line ends that were hyphenated: doc, pos, word. The hyphen (any of HYPHENS) stands between letters and the joined word is known.

    What is joined are the cores of the last word of a line and of the first of the next.
    """
    after = F.lead(line).over(Window.partitionBy(doc).orderBy(pos))
    last, first = F.regexp_extract(line, r"(\S+)\s*$", 1), F.regexp_extract(F.col("__next"), r"^\s*(\S+)", 1)
    left = F.regexp_extract(last, rf"^(.*\p{{L}})[{T.HYPHENS}]+$", 1)
    right = F.when(first.rlike(r"^\p{L}"), first)
    word = F.lower(F.concat(T.core(left), T.core(right)))
    found = lines.withColumn("__next", after).where((left != "") & right.isNotNull()).select(doc, pos, word.alias("word"))
    return found.join(lexicon.select("word").distinct(), "word", "left_semi").select(doc, pos, "word")


def split_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Unknown words that are two known words without a space: word, at, left, right (parts of two letters at least).

    With a column ``gaps`` (array: the gap after each character) the cut must have the strictly largest gap.
    """
    known = lexicon.select("word").distinct()
    at = F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("at")
    cut = unknown_words(words, known).where(F.length("word") >= 4).select("*", at)
    cut = cut.withColumn("left", F.expr("substring(word, 1, at)")).withColumn("right", F.expr("substring(word, at + 1)"))
    for side in ("left", "right"):
        cut = cut.join(known.select(F.col("word").alias("__k")), F.col(side) == F.col("__k"), "left_semi")
    if "gaps" in words.columns:
        gap = F.expr("element_at(gaps, at)")
        cut = cut.where(F.size(F.filter("gaps", lambda g: g >= gap)) == 1)
    return cut.select("word", "at", "left", "right").distinct()


#: Letters of the run by which masked words meet the lexicon.
RUN = 3


def masked_words(masked: DataFrame, lexicon: DataFrame, wildcard: str = "*") -> DataFrame:
    """Words with unread characters (wildcards) that exactly one known word of their length fits; no anchor gives none.

    They meet by length and by the place and letters of the longest read run, up to RUN letters of it.
    """
    anchored = masked.where(F.col("mask").contains(wildcard) & F.col("mask").rlike(r"\p{L}")).select("mask").distinct()
    runs = F.transform(F.sequence(F.lit(1), F.length("mask")), lambda i: F.struct(F.length(F.substring_index(F.substring(F.col("mask"), i, F.lit(RUN)), wildcard, 1)).alias("n"), (-i).alias("at")))
    best = F.array_max(runs)
    asked = anchored.withColumn("len", F.length("mask")).withColumn("at", -best["at"]).withColumn("run", F.substring(F.col("mask"), F.col("at"), best["n"]))
    known = lexicon.select("word", F.length("word").alias("len")).distinct()
    some = known.select("word", "len", F.explode(F.sequence(F.lit(1), F.greatest("len", F.lit(1)))).alias("at")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(RUN)))).where("at + n - 1 <= len")
    met = asked.join(some.withColumn("run", F.substring(F.col("word"), F.col("at"), F.col("n"))), ["len", "at", "run"])
    letters = lambda c: F.split(c, "")
    fits = F.forall(F.zip_with(letters("mask"), letters("word"), lambda m, w: (m == wildcard) | (m == w)), lambda x: x)
    return met.where(fits).groupBy("mask").agg(F.countDistinct("word").alias("n"), F.first("word").alias("word")).where("n = 1").select("mask", "word")


def strip_affixes(words: DataFrame, roots: DataFrame, rules: DataFrame) -> DataFrame:
    """Words (lower case) that are roots, or that a suffix rule, a prefix rule or one of each takes back to a root: word, root, flag.

    ``rules``: kind (suffix or prefix), flag, strip, add (may be empty for suffixes), and where given condition (a
    pattern the root must end, or for prefixes begin, with) and crossed (whether the rule may meet one of the other
    kind, true where not given). The root must have the flags of all rules used; flag is that of the outer rule.
    """
    for name, default in (("condition", F.lit(".")), ("crossed", F.lit(True))):
        rules = rules if name in rules.columns else rules.withColumn(name, default)
    rules = rules.select("kind", F.col("flag"), "strip", "add", F.coalesce("condition", F.lit(".")).alias("condition"), F.coalesce("crossed", F.lit(True)).alias("crossed"))
    low = words.select(F.lower("word").alias("word")).where("word <> ''").distinct()
    flags = roots.select(F.lower("root").alias("root"), "flag").distinct()
    suffixes, prefixes = rules.where("kind = 'suffix'"), rules.where("kind = 'prefix' and add <> ''")
    ends = [r[0] for r in suffixes.select(F.length("add")).distinct().collect()]  # lengths of affixes: a handful
    starts = [r[0] for r in prefixes.select(F.length("add")).distinct().collect()]
    listed = lambda sizes: F.explode(F.array(*(F.lit(k) for k in sizes)) if sizes else F.array().cast("array<int>"))

    def unsuffixed(df: DataFrame, form: str, only_crossed: bool = False) -> DataFrame:
        """df with root and the suffix rule's flag as inner."""
        some = suffixes.where("crossed") if only_crossed else suffixes
        cut = df.withColumn("n", listed(ends)).where(F.col("n") < F.length(form)).withColumn("add", F.expr(f"right({form}, n)"))
        met = cut.join(some.select("add", F.col("strip").alias("s"), F.col("flag").alias("inner"), F.col("condition").alias("inner_condition")), "add")
        met = met.withColumn("root", F.expr(f"concat(left({form}, length({form}) - n), s)")).where("root <> '' and (inner_condition = '.' or regexp(root, concat(inner_condition, '$')))")
        return met.join(flags.withColumnRenamed("flag", "inner"), ["root", "inner"], "left_semi").drop("n", "add", "s", "inner_condition")

    by_suffix = unsuffixed(low, "word").select("word", "root", F.col("inner").alias("flag"))
    cut = low.withColumn("n", listed(starts)).where(F.col("n") < F.length("word")).withColumn("add", F.expr("left(word, n)"))
    rest = cut.join(prefixes.drop("kind"), "add").withColumn("rest", F.expr("concat(strip, substring(word, n + 1))")).select("word", "rest", "flag", "condition", "crossed")
    begins = F.expr("condition = '.' or regexp(root, concat('^', condition))")
    by_prefix = rest.withColumn("root", F.col("rest")).where(begins).join(flags, ["root", "flag"], "left_semi").select("word", "root", "flag")
    by_both = unsuffixed(rest.where("crossed"), "rest", only_crossed=True).where(begins).join(flags, ["root", "flag"], "left_semi").select("word", "root", "flag")
    plain = low.join(flags.select(F.col("root").alias("word")).distinct(), "word", "left_semi").select("word", F.col("word").alias("root"), F.lit(None).cast("string").alias("flag"))
    return by_suffix.unionByName(by_prefix).unionByName(by_both).unionByName(plain).distinct()


def consensus(hypotheses: DataFrame, minimum: int, order: str = "source") -> DataFrame:
    """Per region the text of most distinct sources, then highest mean and maximum confidence, then text.

    ``conflict`` if the runner-up has as many sources and those reach the minimum; ``accepted`` if the winner
    reaches it without a conflict. Confidences are added one by one by the column ``order``, however rows are dealt: the last bit
    of a sum depends on it, and decides between means that are equal but for rounding.
    """
    listed = Window.partitionBy("region", "text").orderBy(order, "confidence")
    added = hypotheses.withColumn("mean", F.avg("confidence").over(listed.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(listed))
    groups = added.groupBy("region", "text").agg(F.countDistinct("source").alias("support"), F.max_by("mean", "at").alias("mean"), F.max("confidence").alias("top"))
    ranks = Window.partitionBy("region").orderBy(F.desc("support"), F.desc("mean"), F.desc("top"), F.desc("text"))
    ranked = groups.withColumn("place", F.row_number().over(ranks)).withColumn("next", F.lead("support").over(ranks)).where("place = 1")
    conflict = F.coalesce((F.col("next") == F.col("support")) & (F.col("support") >= minimum), F.lit(False))
    return ranked.select("region", "text", "support", conflict.alias("conflict"), ((F.col("support") >= minimum) & ~conflict).alias("accepted"))


#: Words by which texts and passages meet.
INNER = 4


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and item_id of texts (doc_id, text) that contain a whole passage (item_id, passage), a row for each two rows.

    The first and last word of a passage may be parts of words of the text, those between are whole: they meet by a hash of the
    first of these, up to INNER, as rows of adjacent words; then by the text. Passages of at most two words have none between and
    are looked for in every text.
    """
    words = lambda c: F.split(c, r"\s+")
    passages = items.where(F.col("passage").isNotNull()).withColumn("w", F.filter(words("passage"), lambda w: w != ""))
    passages = passages.select("item_id", "passage", F.slice("w", F.lit(2), F.greatest(F.least(F.size("w") - 2, F.lit(INNER)), F.lit(0))).alias("inner"))
    keyed = passages.where(F.size("inner") > 0).select("item_id", "passage", F.xxhash64(F.array_join("inner", " ")).alias("key"), F.size("inner").alias("n"))
    met = docs.select("doc_id", "text").join(F.broadcast(passages.where(F.size("inner") == 0)), F.col("text").contains(F.col("passage"))).select("doc_id", "item_id")
    for n in [r[0] for r in keyed.select("n").distinct().collect()]:  # at most INNER
        asked = keyed.where(F.col("n") == n)
        own = docs.select("doc_id", words("text").alias("w"))
        ahead = F.arrays_zip(*(F.slice("w", F.lit(k + 1), F.greatest(F.size("w") - n + 1, F.lit(0))).alias(f"w{k}") for k in range(n)))
        runs = own.select("doc_id", F.explode(ahead).alias("r")).select("doc_id", F.xxhash64(F.concat_ws(" ", *(f"r.w{k}" for k in range(n)))).alias("key"))
        hits = runs.join(asked.select("key").distinct(), "key").distinct()
        pairs = hits.join(asked, "key").join(docs.select("doc_id", "text"), "doc_id")
        met = met.unionByName(pairs.where(F.col("text").contains(F.col("passage"))).select("doc_id", "item_id"))
    return met


def fused(hypotheses: DataFrame, lexicon: DataFrame, margin: float) -> DataFrame:
    """Best reading per region: confidence + min(.08, .04 * (sources of the text - 1)) + .10 * share of known words."""
    agree = F.count(F.lit(1)).over(Window.partitionBy("region", "text"))
    words = hypotheses.select("region", "source", F.explode(F.array_distinct(F.transform(T.words(F.col("text")), lambda w: F.lower(T.core(w))))).alias("word"))
    known = lexicon.select("word").distinct().withColumn("k", F.lit(1))
    share = words.join(known, "word", "left").groupBy("region", "source").agg((F.sum(F.coalesce("k", F.lit(0))) / F.count(F.lit(1))).alias("share"))
    score = F.col("confidence") + F.least(F.lit(0.08), 0.04 * (F.col("agree") - 1)) + 0.10 * F.coalesce("share", F.lit(0.0))
    order = Window.partitionBy("region").orderBy(F.desc("score"), "source")
    scored = hypotheses.withColumn("agree", agree).join(share, ["region", "source"], "left").withColumn("score", F.round(score, 9))
    best = scored.withColumn("place", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("place = 1")
    return best.select("region", "source", "text", "score", F.coalesce(F.col("score") - F.col("second") < margin, F.lit(False)).alias("review"))


def broken_links(links: DataFrame, targets: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Links without a target, targets nobody points at and (given notes) notes nobody refers to, with a severity."""
    to, at = F.col("target"), targets.select(F.col("target").alias("__t")).distinct()
    dead = links.join(at, to == F.col("__t"), "left_anti").select(F.lit("error").alias("severity"), F.lit("no target").alias("kind"), "source", "target")
    used = links.select(F.col("target").alias("__u")).distinct()
    idle = targets.join(used, to == F.col("__u"), "left_anti").select(F.lit("warning").alias("severity"), F.lit("not linked").alias("kind"), F.lit(None).cast("string").alias("source"), "target")
    out = dead.unionByName(idle)
    if notes is not None:
        lost = notes.join(used, F.col("note") == F.col("__u"), "left_anti").select(F.lit("warning").alias("severity"), F.lit("note unused").alias("kind"), F.lit(None).cast("string").alias("source"), F.col("note").alias("target"))
        out = out.unionByName(lost)
    return out


def used_and_defined(used: DataFrame, defined: DataFrame, name: str) -> DataFrame:
    """Names on one side only: used but not defined, defined but not used."""
    u, d = used.select(name).distinct().withColumn("u", F.lit(True)), defined.select(name).distinct().withColumn("d", F.lit(True))
    both = u.join(d, name, "full").where(F.col("u").isNull() | F.col("d").isNull())
    return both.select(name, F.when(F.col("d").isNull(), "not defined").otherwise("not used").alias("problem"))


def foreign_key_violations(children: DataFrame, key: str, parents: DataFrame, parent_key: str, ids: str) -> DataFrame:
    """Duplicate ids of the children and keys that no parent has."""
    twice = children.groupBy(F.col(ids).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), "value", "n")
    lost = children.join(parents.select(F.col(parent_key).alias("__p")).distinct(), F.col(key) == F.col("__p"), "left_anti")
    return twice.unionByName(lost.groupBy(F.col(key).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("dangling").alias("kind"), "value", "n"))


def reviewed(rows: DataFrame, reviews: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with reviewed values put in; rejected ones leave, the others stay, rows only reviewed come in."""
    r = reviews.select(key, F.col("status").alias("__s"), F.col(value).alias("__v"))
    return rows.select(key, value).join(r, key, "full").where(F.coalesce(F.col("__s"), F.lit("")) != "rejected").select(key, F.coalesce("__v", value).alias(value))


def replaced_page(blocks: DataFrame, page: int, new: DataFrame) -> DataFrame:
    """Blocks (page, pos, kind, text) with those of one page replaced, except its page mark; positions are renumbered."""
    old = (F.col("page") == page) & (F.col("kind") != "page_break")
    first = blocks.where(old).agg(F.min("pos")).first()[0]
    if first is None:
        mark = blocks.where((F.col("page") == page) & (F.col("kind") == "page_break")).agg(F.max("pos")).first()[0]
        if mark is None:
            raise ValueError(f"page {page} has no place in the document")
        first = mark + 1
    kept = blocks.where(~old).select(F.when(F.col("pos") < first, 0).otherwise(2).alias("__g"), "page", "pos", "kind", "text")
    rows = kept.unionByName(new.select(F.lit(1).alias("__g"), F.lit(page).alias("page"), "pos", "kind", "text"))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("__g", "pos")) - 1).drop("__g")  # one document


def inventory(resources: DataFrame, uses: DataFrame) -> DataFrame:
    """Every resource and the sorted set of files that use it."""
    met = resources.select("name").join(uses.select("name", "file"), "name", "left")
    return met.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("used_by"), F.countDistinct("file").alias("files"))


def label_join(entries: DataFrame, labels: DataFrame, key: str, *, all_required: bool = True) -> DataFrame:
    """Decisions joined to entries; duplicates, unknown entries and (unless allowed) missing ones raise."""
    for rows, what in ((entries, "entry"), (labels, "label")):
        if rows.groupBy(key).count().where("count > 1").head(1):
            raise ValueError(f"duplicate {what}")
    if labels.join(entries, key, "left_anti").head(1):
        raise ValueError("a label for an unknown entry")
    if all_required and entries.join(labels, key, "left_anti").head(1):
        raise ValueError("an entry without a label")
    return entries.join(labels, key, "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
