"""Line dedup by site-relative frequency, in DataFrame functions only.

For every host the pages that contain a line are divided by the pages of the host; lines above ``max_ratio``
that stand on at least ``min_pages`` pages of it are boilerplate there and leave its pages.

Defined cases: blank lines are never counted nor dropped; lines are compared trimmed of spaces; a line counts
once per page however often it repeats; a null host is a host of its own; a null text stays null and counts as
a page without lines; repeated rows are pages of their own; a page may end with an empty text, its row stays;
an empty table gives an empty result; further columns pass through unchanged
(columns n_lines and n_dropped are replaced).
A line is identified in its host by 96 bits of hash (xxHash64 and Murmur3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import checkpointed

#: Boilerplate lines up to this number are broadcast (16 bytes a line and host); beyond it the join is shuffled.
BROADCAST_LINES = 200_000
#: Parts into which the pages of one host are dealt in the shuffled join.
SALTS = 64


def _key(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.struct(F.xxhash64(trimmed).alias("a"), F.hash(trimmed).alias("b"))


def boilerplate_lines(pages: DataFrame, host: Column, *, text: str = "text", max_ratio: float, min_pages: int) -> DataFrame:
    """host_key, key (struct of hashes), pages, host_pages, ratio of every line above the limits.

    Lines are counted with a map-side partial count, so a line or host of any size is one row per task.
    """
    at = pages.select(F.coalesce(host.cast("string"), F.lit("\0")).alias("host_key"), F.col(text).alias("body"))
    totals = at.groupBy("host_key").agg(F.count(F.lit(1)).alias("host_pages"))
    keys = F.array_distinct(F.transform(F.filter(F.split("body", "\n", -1), lambda x: F.trim(x) != ""), _key))
    counts = (
        at.select("host_key", F.explode(keys).alias("key"))
        .groupBy("host_key", "key")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    ratio = F.col("pages") / F.col("host_pages")
    return counts.join(totals, "host_key").withColumn("ratio", ratio).where(F.col("ratio") > max_ratio)


def drop_boilerplate(pages: DataFrame, host: Column, *, text: str = "text", max_ratio: float = 0.01, min_pages: int = 5) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``, plus n_lines and n_dropped.

    The lines of one host number at most its mean lines per page / max_ratio. All of them together are broadcast
    while they are few; otherwise pages and lines meet by host and salt, so a hot host is dealt to SALTS parts.
    """
    found = checkpointed(boilerplate_lines(pages, host, text=text, max_ratio=max_ratio, min_pages=min_pages).select("host_key", "key"))
    sets = found.groupBy(F.col("host_key").alias("__set_host")).agg(F.collect_list("key").alias("__keys"))
    at = pages.withColumn("__host", F.coalesce(host.cast("string"), F.lit("\0")))
    if found.count() <= BROADCAST_LINES:
        met = at.join(F.broadcast(sets), F.col("__host") == F.col("__set_host"), "left")
    else:
        salts = sets.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = at.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        met = dealt.join(salts, (F.col("__host") == F.col("__set_host")) & (F.col("__salt") == F.col("__part")), "left").drop("__salt", "__part")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__keys"), _key(x)), F.lit(False)) | (F.trim(x) == ""))
    return (
        met.withColumn("__kept", kept)
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)))
        .withColumn("n_dropped", F.coalesce(F.col("n_lines") - F.size("__kept"), F.lit(0)))
        .withColumn(text, F.array_join("__kept", "\n"))
        .drop("__host", "__set_host", "__keys", "__kept")
    )
