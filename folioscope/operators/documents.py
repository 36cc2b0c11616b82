"""Document structure: running lines, paragraphs, lines and words of boxes, numbering, nesting, review and history."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Priority of block kinds and the reasons of high impact in the review queue.
KIND_PRIORITY = {"diagram": 0, "chess_sequence": 1, "paragraph": 2, "heading": 2, "caption": 2, "figure": 3, "table": 3, "header": 4, "footer": 4, "unknown": 5, "page_break": 6}
HIGH_IMPACT = ["low_confidence", "orientation_missing", "fen_invalid", "notation_conflict", "diagram_uncertain", "layout_ambiguous", "manual_review", "side_to_move_legalidade"]


def needs_review() -> Column:
    """Of columns status, flagged, warnings, reason_codes."""
    open_ = ~F.col("status").isin("reviewed", "rejected")
    high = F.arrays_overlap("reason_codes", F.array(*(F.lit(r) for r in HIGH_IMPACT)))
    return open_ & ((F.col("status") == "unresolved") | F.coalesce("flagged", F.lit(False)) | (F.size("warnings") > 0) | F.coalesce(high, F.lit(False)))


def kind_priority() -> Column:
    pairs = [F.lit(x) for k, v in KIND_PRIORITY.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("kind")), F.lit(5))


def severity(weights: dict[str, float] | None = None) -> Column:
    """100 - 10 * priority, +20 below a confidence of .8, +10 high impact, +int(50 * highest weight), +15 unresolved."""
    high = F.coalesce(F.arrays_overlap("reason_codes", F.array(*(F.lit(r) for r in HIGH_IMPACT))), F.lit(False))
    out = 100 - 10 * kind_priority() + F.when(F.col("confidence") >= 0.8, 0).otherwise(20) + F.when(high, 10).otherwise(0) + F.when(F.col("status") == "unresolved", 15).otherwise(0)
    if weights:
        table = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, v)))
        top = F.array_max(F.transform("reason_codes", lambda r: F.coalesce(F.try_element_at(table, r), F.lit(0.0))))
        out = out + F.coalesce(F.floor(50 * top).cast("int"), F.lit(0))
    return out


def review_queue(blocks: DataFrame, *, per_page: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Blocks that need review by falling severity, then page, kind and id; optionally the first of every page only."""
    rows = blocks.where(needs_review()).withColumn("severity", severity(weights))
    if per_page is not None:
        place = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("severity"), "id"))
        rows = rows.withColumn("__p", place).where(F.col("__p") <= per_page).drop("__p")
    return rows.orderBy(F.desc("severity"), "page", kind_priority(), "id")


def running_lines(lines: DataFrame, minimum: int, *by: str, doc: str = "doc", line: str = "line") -> DataFrame:
    """Signatures (and given columns) that candidate lines of at least ``minimum`` documents share."""
    marked = lines.where(T.header_candidate(F.col(line))).select(doc, *by, T.signature(F.col(line)).alias("signature")).distinct()
    return marked.groupBy(*by, "signature").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= minimum)


def without_running_lines(lines: DataFrame, minimum: int, doc: str = "doc", line: str = "line") -> DataFrame:
    found = running_lines(lines, minimum, doc=doc, line=line).select("signature")
    marked = lines.withColumn("signature", F.when(T.header_candidate(F.col(line)), T.signature(F.col(line))))
    return marked.join(found, "signature", "left_anti").drop("signature")


def merged_paragraphs(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages whose last paragraph goes on in the first of the next page: doc, page, joined.

    Both are plain paragraphs, the first ends without .!?:; and the second starts in lower case; a middle page of a
    single block breaks the chain in a single left-to-right pass.
    """
    edges = blocks.groupBy(doc, "page").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("kind", "text"), "pos").alias("first"), F.max_by(F.struct("kind", "text"), "pos").alias("last"))
    order = Window.partitionBy(doc).orderBy("page")
    pair = edges.withColumn("next", F.lead("first").over(order)).withColumn("into", F.lag("n").over(order))
    goes_on = (F.col("last.kind") == "paragraph") & (F.col("next.kind") == "paragraph") & ~F.col("last.text").rlike(r"[.!?:;]\s*$") & F.col("next.text").rlike(r"^\s*\p{Ll}")
    alone = (F.col("n") == 1) & F.col("into").isNotNull()
    return pair.where(goes_on & ~alone).select(doc, "page", F.concat_ws(" ", F.col("last.text"), F.col("next.text")).alias("joined"))


def lines_of_boxes(boxes: DataFrame, page: str = "page", short: float = 0.5, drop: float = 0.2) -> DataFrame:
    """Boxes with a line number, by top edge; a box opens a line when its centre passes the mean bottom of the line's
    tall boxes by ``drop`` of its own height. Boxes under ``short`` of the median height set no baseline. A page must
    fit one task."""

    kinds = dict(boxes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for rows in batch.column("boxes").to_pylist():
                heights = [r["y2"] - r["y1"] for r in rows]
                median = sorted(heights)[len(heights) // 2]
                line, bottoms, own = 0, [], []
                for r, h in zip(rows, heights, strict=True):
                    if bottoms and (r["y1"] + r["y2"]) / 2 > sum(bottoms) / len(bottoms) + drop * h:
                        line, bottoms = line + 1, []
                    if h >= short * median or not bottoms:
                        bottoms.append(r["y2"])
                    own.append({"pos": r["pos"], "line": line})
                lines.append(own)
            kind = pa.list_(pa.struct([("pos", pa.int64()), ("line", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, kind)], names=[page, "lines"])

    pages = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("y1", "x1", F.col("pos").cast("bigint").alias("pos"), "y2"))).alias("boxes"))
    found = pages.mapInArrow(run, f"{page} {kinds[page]}, lines array<struct<pos:bigint,line:int>>")
    return found.select(page, F.explode("lines").alias("l")).select(page, F.col("l.pos").cast(kinds["pos"]).alias("pos"), "l.line")


def words_by_gap(boxes: DataFrame, by: list[str], factor: float) -> DataFrame:
    """Adds ``word``: a new word starts where the gap exceeds factor x the upper median width of the line's boxes."""
    line = Window.partitionBy(*by).orderBy("x1", "pos")
    width = upper_median(boxes.withColumn("w", F.col("x2") - F.col("x1")), "w", *by).withColumnRenamed("w", "__median")
    gap = F.col("x1") - F.max("x2").over(line.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((gap > factor * F.col("__median")).cast("int"), F.lit(0))
    return boxes.join(width, by).withColumn("__cut", cut).withColumn("word", F.sum("__cut").over(line)).drop("__cut", "__median")


def upper_median(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Element n // 2 of the sorted values of each group, not interpolated; ranks within groups, no list is collected."""
    order = Window.partitionBy(*by).orderBy(value)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    some = rows.where(F.col(value).isNotNull())
    return some.withColumn("__r", F.row_number().over(order)).withColumn("__n", n).where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select(*by, value)


def columns_of_lines(lines: DataFrame, page: str, least_gap: float) -> DataFrame:
    """Adds ``column``: lines whose spans on x, taken in order, leave a gap of ``least_gap`` start another column."""
    order = Window.partitionBy(page).orderBy("x1", "x2", "pos")
    reach = F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("x1") - reach >= least_gap).cast("int"), F.lit(0))
    return lines.withColumn("__cut", cut).withColumn("column", F.sum("__cut").over(order)).drop("__cut")


def reading_order(boxes: DataFrame, page: str, least_gap: float) -> DataFrame:
    """Place of every box: by column, then top, then left."""
    placed = columns_of_lines(boxes, page, least_gap)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("column", "y1", "x1", "pos")))


def line_breaks(boxes: DataFrame, page: str) -> DataFrame:
    """Lines of boxes already in reading order: a box left of the one before it starts a line."""
    order = Window.partitionBy(page).orderBy("pos")
    cut = F.coalesce((F.col("x1") < F.lag("x1").over(order)).cast("int"), F.lit(0))
    return boxes.withColumn("__cut", cut).withColumn("line", F.sum("__cut").over(order)).drop("__cut")


def numbered(objects: DataFrame, book: str, kind: str, order: str, chapter: str | None = None) -> DataFrame:
    """Adds ``number`` of objects of a kind in order, per book or per chapter."""
    by = [book, kind] + ([chapter] if chapter else [])
    return objects.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def reference_texts(references: DataFrame, numbers: DataFrame, target: str, label: str) -> DataFrame:
    """Reference texts anew from the numbers of their targets; references without a target keep theirs."""
    n = numbers.select(F.col(target).alias("__t"), "number")
    return references.join(n, F.col(target) == F.col("__t"), "left").withColumn("text", F.coalesce(F.concat(F.lit(label + " "), F.col("number").cast("string")), F.col("text"))).drop("__t", "number")


def next_or_first(occurrences: DataFrame, by: str, position: str, at: Column) -> DataFrame:
    """Per group the smallest position from ``at`` on, else the smallest of all."""
    ahead = F.min(F.when(F.col(position) >= at, F.col(position)))
    return occurrences.groupBy(by).agg(F.coalesce(ahead, F.min(position)).alias("next"))


def steps_of_events(events: DataFrame, by: str, order: str) -> DataFrame:
    """Adds ``step``: neighbouring events of one batch and one side of undo make one step, others stand alone."""
    w = Window.partitionBy(by).orderBy(order)
    same = (F.col("batch") == F.lag("batch").over(w)) & (F.col("undo") == F.lag("undo").over(w))
    return events.withColumn("step", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))


def standing_steps(events: DataFrame, by: str, order: str) -> DataFrame:
    """The stack of steps that no undo has taken back, oldest first: by, steps array<bigint>."""
    steps = steps_of_events(events, by, order).groupBy(by, "step").agg(F.max("undo").alias("undo"))
    ordered = steps.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("step", "undo"))).alias("s"))

    def fold(stack: Column, x: Column) -> Column:
        popped = F.when(F.size(stack) > 0, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)
        return F.when(x["undo"], popped).otherwise(F.array_append(stack, x["step"]))

    return ordered.select(by, F.aggregate("s", F.array().cast("array<bigint>"), fold).alias("steps"))


def latest_state(events: DataFrame, target: str, order: Column, value: str) -> DataFrame:
    """The last value of every target and the number of its events."""
    return events.groupBy(target).agg(F.max_by(value, order).alias(value), F.count(F.lit(1)).alias("events"))


def stale_events(events: DataFrame, target: str, order: list[str], before: str, after: str) -> DataFrame:
    """Events whose ``before`` differs from the value that the event before them left."""
    w = Window.partitionBy(target).orderBy(*order)
    return events.withColumn("__was", F.lag(after).over(w)).where(F.col("__was").isNotNull() & ~F.col("__was").eqNullSafe(F.col(before))).drop("__was")


def coalesced(edits: DataFrame, by: str, ts: str, gap_seconds: float, before: str, after: str) -> DataFrame:
    """Edits within the gap of the one before fuse: by, start, end, oldest before, newest after, n."""
    w = Window.partitionBy(by).orderBy(ts, "event_id")
    away = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    island = F.sum(F.when(away <= int(gap_seconds * 1e6), 0).otherwise(1)).over(w)
    order = F.struct(ts, "event_id")
    return edits.withColumn("island", island).groupBy(by, "island").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.min_by(before, order).alias("before"), F.max_by(after, order).alias("after"), F.count(F.lit(1)).alias("n")
    )


def recent_distinct(events: DataFrame, by: str, value: str, order: list[str], n: int) -> DataFrame:
    """The last n distinct values of each group, most recent first: by, place, value."""
    last = events.groupBy(by, value).agg(F.max(F.struct(*order)).alias("__o"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("__o"), value))
    return last.withColumn("place", place).where(F.col("place") <= n).select(by, "place", value)


def evicted(files: DataFrame, by: str, size: str, newest: list[Column], budget: int) -> DataFrame:
    """Files that leave when, newest first, sizes add up to more than the budget of their group."""
    total = F.sum(size).over(Window.partitionBy(by).orderBy(*newest).rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("kept_bytes", total).where(F.col("kept_bytes") > budget)


def nesting(headings: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds ``parent``: the position of the last earlier heading of a lower level (a stack of open headings)."""
    w = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = headings
    # a heading closes all of its level and deeper ones: the parent is the last of a lower level since the document began
    lower = [F.max(F.when(F.col("level") == level, F.col("pos"))).over(w).alias(f"__l{level}") for level in range(1, 7)]
    out = headings.select("*", *lower)
    candidates = [F.when(F.col("level") > level, F.col(f"__l{level}")) for level in range(1, 7)]
    return out.withColumn("parent", F.greatest(*candidates)).drop(*(f"__l{level}" for level in range(1, 7)))


def chapters(blocks: DataFrame, doc: str, starts: Column) -> DataFrame:
    """Adds ``chapter``: 0 before the first start, then one more at every start."""
    return blocks.withColumn("chapter", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(doc).orderBy("pos")))


def index_entries(mentions: DataFrame, key: str, place: str) -> DataFrame:
    """Back-of-book index: every key with its places in order, each once."""
    return mentions.select(key, place).distinct().groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda p: p.cast("string")), ",").alias("places"))


def renamed(links: DataFrame, names: DataFrame, target: str) -> DataFrame:
    """Links with targets renamed by one simultaneous map old -> new, so that names may swap."""
    return links.join(names, F.col(target) == F.col("old"), "left").withColumn(target, F.coalesce("new", target)).drop("old", "new")


def deleted(files: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files that stay and the links that pointed to those that go."""
    return files.join(gone, "name", "left_anti"), links.join(gone.select(F.col("name").alias("target")), "target", "left_semi")


def appended(book: DataFrame, other: DataFrame) -> DataFrame:
    """Files (name, digest) of two books; equal ones are shared, other colliding names of the second get -1, -2, ..."""
    a = book.select("name", "digest")
    taken = a.select(F.col("name").alias("__n"), F.col("digest").alias("__d"))
    b = other.join(taken, F.col("name") == F.col("__n"), "left").where(F.col("__d").isNull() | (F.col("__d") != F.col("digest")))
    stem, ending = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    tries = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(stem, F.lit("-"), i.cast("string"), ending))
    names = book.select("name").distinct()
    free = b.where(F.col("__n").isNotNull()).select("name", "digest", F.posexplode(tries).alias("k", "new")).join(names.select(F.col("name").alias("new")), "new", "left_anti")
    suffixed = free.groupBy("name", "digest").agg(F.min_by("new", "k").alias("new"))
    plain = b.where(F.col("__n").isNull()).select("name", "digest")
    return a.unionByName(plain).unionByName(suffixed.select(F.col("new").alias("name"), "digest"))


def style_runs(chars: DataFrame, doc: str, *formats: str) -> DataFrame:
    """Runs of characters of one format: doc, run, start, text."""
    w = Window.partitionBy(doc).orderBy("pos")
    same = None
    for f in formats:
        one = F.col(f).eqNullSafe(F.lag(f).over(w))
        same = one if same is None else same & one
    run = F.sum(F.when(same & (F.row_number().over(w) > 1), 0).otherwise(1)).over(w)
    marked = chars.withColumn("run", run)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "")
    return marked.groupBy(doc, "run", *formats).agg(F.min("pos").alias("start"), texts.alias("text"))
