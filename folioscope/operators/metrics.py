"""Error rates, alignment and their aggregates; box, layout and diagram metrics; gates and comparisons."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from folioscope.functions import text as T


def rate(errors: Column, total: Column, predicted: Column) -> Column:
    """errors / total; with an empty reference 0 if nothing was predicted, else 1."""
    return F.when(total > 0, errors / total).when(predicted == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def text_errors(pairs: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Adds errors, total (characters of the reference) and cer."""
    with_errors = pairs.withColumn("errors", F.levenshtein(reference, prediction)).withColumn("total", F.length(reference))
    return with_errors.withColumn("cer", rate(F.col("errors"), F.col("total"), F.length(prediction)))


def sequence_errors(pairs: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Of two arrays: errors, total, error_rate, exact_items (0 unless of one length) and exact (null if both are empty)."""
    a, b = F.col(reference), F.col(prediction)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    out = pairs.withColumn("errors", T.item_distance(a, b)).withColumn("total", F.size(a))
    out = out.withColumn("error_rate", rate(F.col("errors"), F.col("total"), F.size(b)))
    out = out.withColumn("exact_items", F.when(F.size(a) == F.size(b), same).otherwise(0))
    return out.withColumn("exact", F.when((F.size(a) == 0) & (F.size(b) == 0), None).otherwise((a == b).cast("double")))


def micro(measured: DataFrame, *by: str) -> DataFrame:
    """pages, errors, total, micro rate (0 without any reference) and the macro mean of cer per group."""
    return measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("errors").cast("bigint").alias("errors"),
        F.sum("total").cast("bigint").alias("total"),
        F.coalesce(F.try_divide(F.sum("errors"), F.sum("total")), F.lit(0.0)).alias("micro_cer"),
        F.avg("cer").alias("macro_cer"),
    )


def layout(pairs: DataFrame, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Of two arrays of types: types_right by position, type_accuracy (percent of the longer), order_right."""
    a, b = F.col(reference), F.col(prediction)
    right = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e))
    longest = F.greatest(F.size(a), F.size(b))
    return (
        pairs.withColumn("types_right", right)
        .withColumn("type_accuracy", F.try_divide(F.lit(100.0) * right, longest))
        .withColumn("order_right", F.when(longest == 0, None).otherwise(a == b))
    )


def boxes_summary(counts: DataFrame, *by: str) -> DataFrame:
    """Micro precision, recall and F1 in percent from n_reference, n_predicted, matched, right; null where undefined."""
    sums = counts.groupBy(*by).agg(*(F.sum(c).cast("bigint").alias(c) for c in ("n_reference", "n_predicted", "matched", "right")))
    p, r = F.try_divide(F.lit(100.0) * F.col("right"), F.col("n_predicted")), F.try_divide(F.lit(100.0) * F.col("right"), F.col("n_reference"))
    return (
        sums.withColumn("spurious", F.col("n_predicted") - F.col("matched"))
        .withColumn("missed", F.col("n_reference") - F.col("matched"))
        .withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn("f1", F.try_divide(2 * p * r, p + r))
    )


def match_boxes(reference: DataFrame, predicted: DataFrame, page: str = "page", *, fold_case: bool = False) -> DataFrame:
    """Greedy one-to-one matching of a page's boxes: page, n_reference, n_predicted, matched, right (equal characters, normalised).

    Reference boxes in order ``pos`` each take the unused predicted box whose centre lies in them with the highest
    overlap ratio, ties to the first; boxes without coordinates are left out. A page must fit one task.
    """
    corners = ["x1", "y1", "x2", "y2"]
    schema = f"{page} {dict(reference.dtypes)[page]}, n_reference bigint, n_predicted bigint, matched bigint, right bigint"

    def listed(boxes: DataFrame, name: str) -> DataFrame:
        some = boxes.dropna(subset=corners).groupBy(page)
        return some.agg(F.array_sort(F.collect_list(F.struct("pos", *corners, "char"))).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_matched(r or [], p or [], fold_case) for r, p in zip(batch.column("ref").to_pylist(), batch.column("pred").to_pylist(), strict=True)]
            counts = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(page), *counts], names=[page, "n_reference", "n_predicted", "matched", "right"])

    return listed(reference, "ref").join(listed(predicted, "pred"), page, "full").select(page, "ref", "pred").mapInArrow(run, schema)


def _matched(ref: list[dict], pred: list[dict], fold_case: bool = False) -> tuple[int, int, int, int]:
    def clean(char: str | None) -> str:
        plain = " ".join(unicodedata.normalize("NFKC", char or "").split())
        return plain.casefold() if fold_case else plain

    same = lambda a, b: clean(a) == clean(b)
    used, matched, right = [False] * len(pred), 0, 0
    for r in ref:
        best, top = None, -1.0
        for i, p in enumerate(pred):
            if used[i] or not (r["x1"] <= (p["x1"] + p["x2"]) / 2 <= r["x2"] and r["y1"] <= (p["y1"] + p["y2"]) / 2 <= r["y2"]):
                continue
            cut = max(0.0, min(r["x2"], p["x2"]) - max(r["x1"], p["x1"])) * max(0.0, min(r["y2"], p["y2"]) - max(r["y1"], p["y1"]))
            areas = sum(max(0.0, b["x2"] - b["x1"]) * max(0.0, b["y2"] - b["y1"]) for b in (r, p))
            iou = cut / (areas - cut) if cut > 0 and areas > cut else 0.0
            if iou > top:
                best, top = i, iou
        if best is not None:
            used[best] = True
            matched += 1
            right += same(pred[best]["char"], r["char"])
    return len(ref), len(pred), matched, right


#: Side of the cells by which boxes and points of a page meet.
CELL = 64.0


def cells(low: Column, high: Column, cell: float = CELL) -> Column:
    """The numbers of the cells from one coordinate to another, one row each."""
    return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))


def in_cells(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """Boxes (x1, y1, x2, y2), a row for every cell (cx, cy) they touch; boxes without an area or coordinates touch none."""
    some = boxes.where("x1 <= x2 and y1 <= y2")
    return some.withColumn("cx", cells(F.col("x1"), F.col("x2"), cell)).withColumn("cy", cells(F.col("y1"), F.col("y2"), cell))


def centre_in_box(reference: DataFrame, predicted: DataFrame, page: str = "page", cell: float = CELL) -> DataFrame:
    """Pairs (page, ref, pred, iou) of boxes of one page where the predicted centre lies in the reference box.

    A centre lies in one cell and a reference box is listed in all of its own, so pairs meet by page and cell, once each.
    """
    col = F.col
    centred = predicted.withColumn("mx", (col("x1") + col("x2")) / 2).withColumn("my", (col("y1") + col("y2")) / 2)
    r, p = in_cells(reference, cell).alias("r"), centred.withColumn("cx", F.floor(col("mx") / cell)).withColumn("cy", F.floor(col("my") / cell)).alias("p")
    cut = F.greatest(F.least("r.x2", "p.x2") - F.greatest("r.x1", "p.x1"), F.lit(0.0)) * F.greatest(F.least("r.y2", "p.y2") - F.greatest("r.y1", "p.y1"), F.lit(0.0))
    area = lambda s: (col(f"{s}.x2") - col(f"{s}.x1")) * (col(f"{s}.y2") - col(f"{s}.y1"))
    met = (col(f"r.{page}") == col(f"p.{page}")) & (col("r.cx") == col("p.cx")) & (col("r.cy") == col("p.cy"))
    inside = col("p.mx").between(col("r.x1"), col("r.x2")) & col("p.my").between(col("r.y1"), col("r.y2"))
    return r.join(p, met & inside).select(col(f"r.{page}").alias(page), col("r.pos").alias("ref"), col("p.pos").alias("pred"), F.coalesce(F.try_divide(cut, area("r") + area("p") - cut), F.lit(0.0)).alias("iou"))


_PAIR = ArrayType(StructType([StructField("ref", StringType()), StructField("pred", StringType())]))


#: Where an alignment comes from: both advance, the reference alone, the prediction alone.
_BOTH, _LOST, _ADDED = 0, 1, 2


def align(reference: list[str], predicted: list[str]) -> list[tuple[str | None, str | None]]:
    """Unit-cost alignment; from the end, a diagonal step is preferred, then a deletion, then an insertion.

    Costs are kept for one row at a time, steps as one byte a cell; equal ends are paired beforehand, as in any such alignment.
    """
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(t, len(codes)) for t in tokens], dtype=np.int64) for tokens in (reference, predicted))
    shorter = min(len(a), len(b))
    unequal = np.flatnonzero(a[len(a) - shorter :] != b[len(b) - shorter :])
    tail = shorter - (int(unequal[-1]) + 1 if len(unequal) else 0)
    n, m = len(a) - tail, len(b) - tail
    steps = np.full((n + 1, m + 1), _LOST, dtype=np.uint8)
    steps[0, 1:] = _ADDED
    places = np.arange(m + 1)
    above = places.copy()
    for i in range(1, n + 1):
        through = above[:-1] + (b[:m] != a[i - 1])
        best = np.concatenate([[i], np.minimum(through, above[1:] + 1)])
        row = np.minimum.accumulate(best - places) + places  # the cheapest run of insertions from any earlier place
        steps[i, 1:] = np.where(row[1:] == through, _BOTH, np.where(row[1:] == above[1:] + 1, _LOST, _ADDED))
        above = row
    pairs: list[tuple[str | None, str | None]] = []
    i, j = n, m
    while i or j:
        step = steps[i, j]
        i, j = i - (step != _ADDED), j - (step != _LOST)
        pairs.append((None if step == _ADDED else reference[i], None if step == _LOST else predicted[j]))
    return pairs[::-1] + list(zip(reference[n:], predicted[m:], strict=True))


@F.pandas_udf(_PAIR)
def _aligned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([[{"ref": x, "pred": y} for x, y in align(list(r if r is not None else []), list(p if p is not None else []))] for r, p in zip(a, b, strict=True)])


def aligned_tokens(pairs: DataFrame, key: str, reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """One row (key, pos, ref, pred) per aligned pair of tokens of two arrays."""
    return pairs.select(key, F.posexplode(_aligned(reference, prediction)).alias("pos", "pair")).select(key, "pos", "pair.ref", "pair.pred")


def errors_by_domain(aligned: DataFrame, key: str) -> DataFrame:
    """Tokens, characters and their errors, wer and cer per key and domain, and for the total.

    An inserted token counts for the domain of the last reference token before it (at first prose).
    """
    from pyspark.sql import Window

    own = F.when(F.col("ref").isNotNull(), F.when(T.is_notation(F.col("ref")), "notation").otherwise("prose"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = aligned.withColumn("domain", F.coalesce(F.last(own, ignorenulls=True).over(before), F.lit("prose")))
    chars = F.coalesce(F.length("ref"), F.lit(0))
    edits = F.when(F.col("ref").isNull(), F.length("pred")).when(F.col("pred").isNull(), F.length("ref")).otherwise(F.levenshtein("ref", "pred"))
    counted = rows.select(key, F.explode(F.array("domain", F.lit("total"))).alias("domain"), F.col("ref").isNotNull().cast("int").alias("t"), (~F.col("ref").eqNullSafe(F.col("pred"))).cast("int").alias("e"), chars.alias("c"), edits.alias("ce"))
    sums = counted.groupBy(key, "domain").agg(F.sum("t").alias("tokens"), F.sum("e").alias("errors"), F.sum("c").alias("chars"), F.sum("ce").alias("char_errors"))
    zero = F.lit(0.0)
    return sums.withColumn("wer", F.coalesce(F.try_divide("errors", "tokens"), zero)).withColumn("cer", F.coalesce(F.try_divide("char_errors", "chars"), zero))


def gate(values: DataFrame, limits: DataFrame, name: str = "metric") -> DataFrame:
    """Failures of metrics against their limits; a metric that is missing fails."""
    met = limits.join(values, name, "left")
    return met.where(F.col("value").isNull() | (F.col("value") < F.col("limit"))).select(name, "value", "limit")


def regressions(now: DataFrame, before: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Rows whose value rose by more than the tolerance over the run before; rows without one before pass."""
    old = before.select(key, F.col(value).alias("before"))
    return now.join(old, key).where(F.col(value) > F.col("before") + tolerance).select(key, "before", F.col(value).alias("now"))


def compared(cases: DataFrame, case: str, mode: str, value: str, baseline: str, candidate: str) -> DataFrame:
    """The cases of two modes side by side with the difference; cases of one mode only are left out."""
    wide = cases.where(F.col(mode).isin(baseline, candidate)).groupBy(case).pivot(mode, [baseline, candidate]).agg(F.first(value))
    both = wide.where(F.col(baseline).isNotNull() & F.col(candidate).isNotNull())
    return both.select(case, F.col(baseline).alias("baseline"), F.col(candidate).alias("candidate"), (F.col(candidate) - F.col(baseline)).alias("delta"))


def engine_means(cases: DataFrame, engine: str, review: str, *values: str) -> DataFrame:
    """Mean values of every engine and how many of its cases need review."""
    return cases.groupBy(engine).agg(*(F.avg(v).alias(v) for v in values), F.count_if(F.col(review)).alias("review_items"))


def engine_pairs(measured: DataFrame, engine: str, *values: str) -> DataFrame:
    """Mean values of every engine and the differences of every pair of engines (names ascending)."""
    means = measured.groupBy(engine).agg(*(F.avg(v).alias(v) for v in values))
    a, b = means.alias("a"), means.alias("b")
    return a.join(b, F.col(f"a.{engine}") < F.col(f"b.{engine}")).select(F.col(f"a.{engine}").alias("left"), F.col(f"b.{engine}").alias("right"), *((F.col(f"b.{v}") - F.col(f"a.{v}")).alias(f"{v}_delta") for v in values))


def confusion(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """Off-diagonal pairs and their counts."""
    return rows.where(F.col(expected) != F.col(got)).groupBy(expected, got).agg(F.count(F.lit(1)).alias("n"))


def recall_by_class(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """total, hits and recall in percent of every class that occurs."""
    hits = F.sum((F.col(expected) == F.col(got)).cast("bigint"))
    return rows.groupBy(expected).agg(F.count(F.lit(1)).alias("total"), hits.alias("hits"), (100.0 * hits / F.count(F.lit(1))).alias("recall"))
