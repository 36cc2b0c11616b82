"""Exact nearest neighbours and the classifiers built on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.graph import checkpointed, connected

BLOCK = 4096
#: Items of a block of ``similar_links``, and rows of it that are compared at once.
LINKED, AT_ONCE = 2048, 256


def nearest(queries: DataFrame, references: DataFrame, k: int, *, id_col: str = "id", vector: str = "vector", label: str = "label") -> DataFrame:
    """query, rank, reference, label, distance: the k nearest references of every query by L2, not the query itself.

    Both sides are cut into blocks; every pair of blocks is one group of bounded size.
    """
    sizes = [max(1, -(-df.count() // BLOCK)) for df in (queries, references)]

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).cast("string").alias("label"))
        mine = rows.where(F.col("vector").isNotNull()).withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "reference", "label", "distance"]
        if q.empty or r.empty:
            return pd.DataFrame(columns=names)
        a, b = np.stack(q["vector"].to_numpy()), np.stack(r["vector"].to_numpy())
        ids, labels, out = r["id"].to_numpy(), r["label"].to_numpy(), []
        for i in range(0, len(a), 16):
            for row, query in zip(((a[i : i + 16, None, :] - b[None]) ** 2).sum(-1), q["id"].iloc[i : i + 16], strict=True):
                row = np.where(ids == query, np.inf, row)
                bar = np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1]
                near = np.flatnonzero((row <= bar) & np.isfinite(row))  # all ties of the k-th stay for the final ranking
                out += [(query, ids[j], labels[j], float(np.sqrt(row[j]))) for j in near]
        return pd.DataFrame(out, columns=names)

    left = dealt(queries, "q", sizes[0], "r", sizes[1]).groupBy("q", "r")
    right = dealt(references, "r", sizes[1], "q", sizes[0]).groupBy("q", "r")
    found = left.cogroup(right).applyInPandas(run, "query bigint, reference bigint, label string, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "reference"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "reference", "label", "distance")


def predicted(near: DataFrame, threshold: float) -> DataFrame:
    """Label of the nearest reference and confidence max(0, 1 - distance / threshold)."""
    best = near.groupBy("query").agg(F.min_by("label", "rank").alias("label"), F.min("distance").alias("distance"))
    return best.withColumn("confidence", F.greatest(F.lit(0.0), 1 - F.col("distance") / threshold))


def voted(near: DataFrame) -> DataFrame:
    """Majority label among the neighbours, ties to the label of the nearest."""
    counts = near.groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("first"))
    return counts.groupBy("query").agg(F.max_by("label", F.struct("votes", -F.col("first"))).alias("label"), F.max("votes").alias("votes"))


def margin(by_class: DataFrame) -> DataFrame:
    """1 - d(winner) / d(best other class), within 0 and 1: 1 if there is one class, 0 if the other distance is 0."""
    ranked = by_class.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "label")))
    pair = ranked.groupBy("query").agg(F.min(F.when(F.col("place") == 1, F.col("distance"))).alias("a"), F.min(F.when(F.col("place") == 2, F.col("distance"))).alias("b"))
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide("a", "b")))
    return pair.select("query", F.when(F.col("b").isNull(), 1.0).when(F.col("b") == 0, 0.0).otherwise(ratio).alias("margin"))


def nearest_classes(near: DataFrame, n: int) -> DataFrame:
    """The best neighbour of every class, then the n nearest classes: query, place, label, distance."""
    best = near.groupBy("query", "label").agg(F.min("distance").alias("distance"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("distance", "label"))
    return best.withColumn("place", place).where(F.col("place") <= n)


def similar_items(items: DataFrame, limit: float, *, ratio: float = 1.15, height: float = 1.20) -> DataFrame:
    """id, other, distance of items of one label whose proportions and heights are alike and whose vectors are close.

    Items meet by label and by logarithmic classes of height and proportion (each also in the next lower and higher
    class), so only items of like geometry are compared; distance is L2 over the square root of the dimensions.
    """
    log = lambda c, base: F.floor(F.ln(c) / F.ln(F.lit(base)))
    own = items.select("id", "label", "vector", F.col("height").cast("double").alias("h"), (F.col("width") / F.col("height")).alias("r"))
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    a = own.withColumn("hc", log(F.col("h"), height)).withColumn("rc", log(F.col("r"), ratio))
    b = a.withColumn("hc", near("hc")).withColumn("rc", near("rc"))
    b = b.select("label", "hc", "rc", F.col("id").alias("other"), F.col("vector").alias("v"), F.col("h").alias("oh"), F.col("r").alias("o"))
    alike = lambda x, y, k: F.greatest(x / y, y / x) <= k
    met = a.join(b, ["label", "hc", "rc"]).where((F.col("id") != F.col("other")) & alike(F.col("h"), F.col("oh"), height) & alike(F.col("r"), F.col("o"), ratio))
    squares = F.aggregate(F.zip_with("vector", "v", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    return met.withColumn("distance", F.sqrt(squares / F.size("vector"))).where(F.col("distance") <= limit).select("id", "other", "distance")


def _groups(hit: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each row's and column's component (its own where nothing is hit)."""
    least = one.copy(), two.copy()
    left, right = hit.any(axis=1), hit.any(axis=0)
    for start in np.flatnonzero(left):
        if not left[start]:
            continue
        left[start] = False
        rows, columns, fresh = [np.array([start])], [], np.array([start])
        while len(fresh):
            new = np.flatnonzero(right)
            new = new[hit[np.ix_(fresh, new)].any(axis=0)]
            right[new] = False
            columns.append(new)
            fresh = np.flatnonzero(left)
            fresh = fresh[hit[np.ix_(fresh, new)].any(axis=1)]
            left[fresh] = False
            rows.append(fresh)
        r, c = np.concatenate(rows), np.concatenate(columns)
        least[0][r] = least[1][c] = min(one[r].min(), two[c].min())
    return least


def _linked(limit: float, ratio: float, height: float):
    """id, least and n of the linked items of a pair of blocks (sides 0 and 1, or 0 alone): smallest id joined there, links there."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        alone = bool(rows["alone"].iloc[0])
        b = a if alone else b
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "least": [], "n": []}, dtype="int64")
        (one, x, h, r), (two, y, oh, o) = ((s["id"].to_numpy(), np.stack(s["vector"].to_numpy()), s["h"].to_numpy(), s["r"].to_numpy()) for s in (a, b))
        bar, squares = limit * limit * x.shape[1], (y * y).sum(axis=1)
        hit = np.zeros((len(one), len(two)), dtype=bool)
        for at in range(0, len(one), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            own = (x[part] * x[part]).sum(axis=1)[:, None]
            apart = own + squares - 2 * (x[part] @ y.T)
            found = apart <= bar
            # too near the limit for products: the differences themselves, added in order
            i, j = np.nonzero(np.abs(apart - bar) <= 1e-9 * (own + squares + bar))
            for k in range(0, len(i), 1 << 14):
                p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                exact = np.cumsum((x[part][p] - y[q]) ** 2, axis=1)[:, -1]
                found[p, q] = np.sqrt(exact) / np.sqrt(x.shape[1]) <= limit
            for u, v, most in ((h[part][:, None], oh, height), (r[part][:, None], o, ratio)):
                found &= np.maximum(u / v, v / u) <= most
            hit[part] = found & (one[part][:, None] != two)
        least = _groups(hit, one, two)
        ids, n = np.concatenate([one, two]), np.concatenate([hit.sum(axis=1), hit.sum(axis=0) * (not alone)])
        out = pd.DataFrame({"id": ids, "least": np.concatenate(least), "n": n})
        return out[np.concatenate([hit.any(axis=1), hit.any(axis=0)])]

    return run


def similar_links(items: DataFrame, limit: float, *, ratio: float = 1.15, height: float = 1.20) -> DataFrame:
    """id, root and links of every item: how many items ``similar_items`` pairs it with, and the smallest id reachable over such pairs.

    Items meet by label and by classes of height and proportion, as there, in pairs of blocks of bounded size; of each only the
    number of links and a spanning star of its components come back, so pairs are counted but not written. Vectors that are null, or hold
    nulls or non-finite components, link with none.
    """
    c = F.col
    log = lambda v, base: F.floor(F.ln(v) / F.log(F.lit(base * (1 + 1e-9))))
    rows = items.select(c("id").cast("bigint").alias("id"), "label", c("vector").cast("array<double>").alias("vector"), c("height").cast("double").alias("h"), F.try_divide(c("width").cast("double"), c("height").cast("double")).alias("r"))
    finite = F.forall("vector", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    sound = c("label").isNotNull() & finite & (c("h") > 0) & (c("r") > 0) & (c("h") < float("inf")) & (c("r") < float("inf"))
    keys = ["label", "dim", "hc", "rc"]
    placed = rows.where(sound).withColumn("dim", F.size("vector")).where("dim > 0").withColumn("hc", log(c("h"), height)).withColumn("rc", log(c("r"), ratio))
    cells = checkpointed(placed.groupBy(keys).agg(F.ceil(F.count(F.lit(1)) / LINKED).cast("int").alias("chunks")))
    steps = F.array(*(F.struct(F.lit(p).alias("h"), F.lit(q).alias("r")) for p in range(2) for q in range(-1, 2) if p or q >= 0))
    a = cells.withColumn("to", F.explode(steps)).alias("a")
    same = (c("to.h") == 0) & (c("to.r") == 0)
    met = a.join(cells.alias("b"), (c("a.label") == c("b.label")) & (c("a.dim") == c("b.dim")) & (c("a.hc") + c("to.h") == c("b.hc")) & (c("a.rc") + c("to.r") == c("b.rc")))
    blocks = met.select(*(c(f"a.{k}") for k in keys), c("b.hc").alias("ohc"), c("b.rc").alias("orc"), same.alias("same"), F.explode(F.sequence(F.lit(0), c("a.chunks") - 1)).alias("i"), c("b.chunks").alias("others"))
    blocks = blocks.withColumn("j", F.explode(F.sequence(F.lit(0), c("others") - 1))).where(~c("same") | (c("i") <= c("j")))
    blocks = blocks.withColumn("alone", c("same") & (c("i") == c("j"))).withColumn("block", F.struct(*keys, "ohc", "orc", "i", "j"))
    place = lambda side, hc, rc, chunk: F.struct(F.lit(side).alias("side"), c(hc).alias("hc"), c(rc).alias("rc"), c(chunk).alias("chunk"))
    taking = blocks.withColumn("p", F.explode(F.array(place(0, "hc", "rc", "i"), place(1, "ohc", "orc", "j")))).where(~c("alone") | (c("p.side") == 0))
    taking = taking.select("block", "alone", "label", "dim", c("p.side").alias("side"), c("p.hc").alias("hc"), c("p.rc").alias("rc"), c("p.chunk").alias("chunk"))
    dealt = placed.join(cells, keys).withColumn("chunk", F.pmod(F.xxhash64("id"), c("chunks")).cast("int")).join(taking, [*keys, "chunk"])
    found = checkpointed(dealt.select("block", "alone", "side", "id", "vector", "h", "r").groupBy("block").applyInPandas(_linked(limit, ratio, height), "id bigint, least bigint, n bigint"))
    number = found.groupBy("id").agg(F.sum("n").alias("links"))
    roots = connected(found.select(c("least").alias("a"), c("id").alias("b"))).select(c("node").alias("id"), "root")
    return rows.select("id").join(number, "id", "left").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
