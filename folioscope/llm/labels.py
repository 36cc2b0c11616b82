"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many documents of each label are used to fit, none longer than SAMPLE_CHARS (scoring has no bound).
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 40_000


def held_out(doc_id: Column) -> Column:
    """The fold that no fit may see: crc32 of the id as text, modulo 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of at most ``rows`` documents per label outside the held-out fold, in the order of a hash of the id.

    Of documents that repeat a labelled id the least text is taken, so what reaches the driver is bounded.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    picked = None
    for value in (0, 1):
        some = known.where(F.col(label) == value).select("doc_id", F.lit(value).alias("label"), order.alias("order")).orderBy("order", "doc_id").limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.where(F.length("text") <= chars).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    found = texts.groupBy("order", "doc_id", "label").agg(F.min("text").alias("text")).collect()  # a repeated id counts once
    found.sort(key=lambda r: (r.order, r.doc_id, r.label, r.text))
    return [(r.text, r.label) for r in found]


def share_of_ones(labels: DataFrame, label: str) -> float:
    """The share of label 1 among all labels outside the held-out fold, kept within 1 and 99 percent."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    return min(max(float(known.agg(F.avg(label)).first()[0] or 0.5), 0.01), 0.99)
