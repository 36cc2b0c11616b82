"""Corpus operators: copies, contradictions, coverage, splits, leakage, differences, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.graph import components_by_keys


def first_of_copies(rows: DataFrame, content: Column, order: str) -> DataFrame:
    """The row of least ``order`` per content, and how many rows share it."""
    return rows.groupBy(F.sha2(content, 256).alias("digest")).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))


def contradictory(rows: DataFrame, content: Column, label: str) -> DataFrame:
    """Contents with more than one label, counted per set of labels."""
    sets = rows.groupBy(F.sha2(content, 256).alias("d")).agg(F.array_sort(F.collect_set(label)).alias("labels")).where(F.size("labels") > 1)
    return sets.groupBy(F.concat_ws(",", F.transform("labels", lambda x: x.cast("string"))).alias("labels")).agg(F.count(F.lit(1)).alias("contents"))


def principal(families: Column, known: list[str], otherwise: str) -> Column:
    """The first family of the fixed list, which is in the order of rarity, that a page has."""
    return F.coalesce(F.get(F.array_intersect(F.array(*(F.lit(f) for f in known)), families), F.lit(0)), F.lit(otherwise))


def coverage(pages: DataFrame, families: str, known: list[str], *by: str) -> DataFrame:
    """Pages per family of the fixed list, zeros kept; other families are left out."""
    groups = pages.select(*by).distinct() if by else pages.sparkSession.range(1).drop("id")
    grid = groups.withColumn("family", F.explode(F.array(*(F.lit(f) for f in known))))
    counts = pages.select(*by, F.explode(families).alias("family")).groupBy(*by, "family").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, [*by, "family"], "left").select(*by, "family", F.coalesce("n", F.lit(0)).alias("pages"))


def deficits(covered: DataFrame, known: list[str], minimum: int, *by: str) -> DataFrame:
    """Families below the minimum, in the order of the fixed list."""
    place = F.array_position(F.array(*(F.lit(f) for f in known)), F.col("family"))
    short = covered.where(F.col("pages") < minimum).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(place.alias("p"), "family"))).alias("f"))
    return short.select(*by, F.concat_ws(",", F.transform("f", lambda x: x["family"])).alias("missing"))


def planned(measured: DataFrame, candidates: DataFrame, known: list[str], minimum: int, limit: int | None = None) -> list[tuple[str, str, int]]:
    """Greedy order (candidate, document, needs met): each time the candidate covering most unmet needs, ties by id.

    A need is a (document, family) below the minimum. Only one signature row per (document, set of families) reaches
    the driver with its ids in order, as many as can ever be chosen of it, so what is collected is bounded by the
    documents and families, not by the candidates.
    """
    fams = F.array_sort(F.array_intersect("families", F.array(*(F.lit(f) for f in known))))
    have: dict[tuple[str, str], int] = {}
    for r in measured.select("document", F.explode(F.array_distinct("families")).alias("f")).groupBy("document", "f").count().collect():
        have[r.document, r.f] = r["count"]
    seen = measured.select(F.col("id").alias("__seen"))
    fresh = candidates.join(seen, F.col("id") == F.col("__seen"), "left_anti").select("id", "document", fams.alias("families"))
    order = F.row_number().over(Window.partitionBy("document", "families").orderBy("id"))
    rows = fresh.withColumn("n", order).where((F.col("n") <= minimum * F.size("families"))).collect()
    waiting = {(r.id, r.document): r.families for r in rows}
    out: list[tuple[str, str, int]] = []
    while waiting and (limit is None or len(out) < limit):
        gain = {c: sum(have.get((c[1], f), 0) < minimum for f in fams_) for c, fams_ in waiting.items()}
        best = min(waiting, key=lambda c: (-gain[c], c[0]))
        if not gain[best]:
            break
        out.append((*best, gain[best]))
        for f in waiting.pop(best):
            have[best[1], f] = have.get((best[1], f), 0) + 1
    return out


def hash_order(item: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", item.cast("string"), F.lit(str(seed))), 256)


def split_groups(groups: DataFrame, group: str, validation: float, test: float, seed: int) -> DataFrame:
    """Whole groups to train, validation and test in the order of a seeded hash.

    Counts are rounded half to even, one group at least for each part asked for while train keeps one.
    """
    n = groups.count()
    test_n = min(max(1, round(n * test)), max(n - 1, 0)) if test > 0 and n > 1 else 0
    valid_n = min(max(1, round(n * validation)), max(n - test_n - 1, 0)) if validation > 0 and n > 2 else 0
    h = hash_order(F.col(group), seed)
    marks = _ranked_hashes(groups.select(h.alias("h")), {test_n, test_n + valid_n} - {0})
    part = F.lit("train")
    if valid_n:
        part = F.when(h <= marks[test_n + valid_n], "validation").otherwise(part)
    if test_n:
        part = F.when(h <= marks[test_n], "test").otherwise(part)
    return groups.select(group, part.alias("split"))


def _ranked_hashes(hashes: DataFrame, ranks: set[int]) -> dict[int, str]:
    """The hashes of the given ranks (from 1): counts of 65,536 prefixes find the prefix, whose hashes alone are sorted."""
    if not ranks:
        return {}
    prefix = F.substring("h", 1, 4)
    counts = sorted((r.p, r["count"]) for r in hashes.groupBy(prefix.alias("p")).count().collect())
    out: dict[int, str] = {}
    for rank in ranks:
        before = 0
        for p, n in counts:
            if before + n >= rank:
                break
            before += n
        out[rank] = sorted(r.h for r in hashes.where(prefix == p).collect())[rank - before - 1]
    return out


def stratified(rows: DataFrame, item: str, label: str, validation: float, test: float, minimum: int, seed: int) -> DataFrame:
    """Per class shares in hash order; classes below the minimum stay in train, which is never emptied."""
    per = Window.partitionBy(label)
    n = F.count(F.lit(1)).over(per)
    t = F.greatest(F.lit(1), F.bround(n * test)).cast("int")
    v = F.greatest(F.lit(1), F.bround(n * validation)).cast("int")
    place = F.row_number().over(per.orderBy(hash_order(F.col(item), seed), item))
    split = F.when(n < minimum, "train").when(place <= t, "test").when(place <= t + v, "validation").otherwise("train")
    return rows.select(item, label, split.alias("split"))


def leaks(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Non-blank key values that stand in more than one split."""
    held = rows.select(F.col(split), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys))).alias("key"))
    sides = held.where("trim(key.v) <> ''").groupBy(F.col("key.k").alias("key"), F.col("key.v").alias("value"))
    return sides.agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count(F.lit(1)).alias("n")).where("splits like '%,%'")


def split_by_components(items: DataFrame, item: str, keys: list[str], validation: float, test: float, seed: int) -> DataFrame:
    """item, root and split, whole components of items that share keys staying together."""
    rooted = components_by_keys(items, item, keys)
    return rooted.join(split_groups(rooted.select("root").distinct(), "root", validation, test, seed), "root").select(item, "root", "split")


def difference(before: DataFrame, after: DataFrame, key: str, value: Column) -> DataFrame:
    """key and change (added, removed, changed) of two versions."""
    a, b = before.select(key, value.alias("a"), F.lit(True).alias("in_a")), after.select(key, value.alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full").withColumn("change", change).where(F.col("change").isNotNull()).select(key, "change")


def not_a_permutation(order: DataFrame, current: DataFrame) -> DataFrame:
    """Rows in one of the two only: empty if one is a permutation of the other."""
    return order.exceptAll(current).withColumn("side", F.lit("order")).unionByName(current.exceptAll(order).withColumn("side", F.lit("current")))


def active_sample(items: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` items of highest 0.65 * uncertainty + 0.35 * impact, ties by id; impacts over 1 are percents."""
    impact = F.when(F.col("impact") > 1, F.col("impact") / 100).otherwise(F.col("impact"))
    score = 0.65 * (1 - F.col("confidence")) + 0.35 * F.least(F.lit(1.0), impact)
    return items.withColumn("score", score).orderBy(F.desc("score"), "id").limit(limit)


def holdout_change(before: DataFrame, after: DataFrame, value: str, minimum: float, higher_is_better: bool = True) -> DataFrame:
    """Means before and after, the gain in the better direction, and whether it reaches the minimum; sizes must agree."""
    a, b = before.agg(F.count(F.lit(1)).alias("na"), F.avg(value).alias("before")), after.agg(F.count(F.lit(1)).alias("nb"), F.avg(value).alias("after"))
    both = a.join(b, F.col("na") == F.col("nb"), "full")
    gain = (F.col("after") - F.col("before")) * (1 if higher_is_better else -1)
    return both.select("before", "after", gain.alias("gain"), F.coalesce(gain >= minimum, F.lit(False)).alias("passed"))


def reservoir(rows: DataFrame, content: Column, label: str, item: str, n: int, seed: int) -> DataFrame:
    """At most n rows per class in the order of a seeded hash, each content once."""
    once = rows.groupBy(label, F.sha2(content, 256).alias("d")).agg(F.min(item).alias(item))
    place = F.row_number().over(Window.partitionBy(label).orderBy(hash_order(F.col(item), seed), item))
    return once.withColumn("place", place).where(F.col("place") <= n).select(label, item, "place")


def upsert(base: DataFrame, changes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """base with the latest change of every key put in; a null value discards the row."""
    last = changes.groupBy(key).agg(F.max_by(value, order).alias("__new"), F.lit(True).alias("__hit"))
    merged = base.select(key, value).join(last, key, "full")
    chosen = F.when(F.col("__hit").isNotNull(), F.col("__new")).otherwise(F.col(value))
    return merged.select(key, chosen.alias(value)).where(F.col(value).isNotNull())
