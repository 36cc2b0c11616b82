"""Calibration of confidences: binned error, ranks, triage, temperature, bias.

Rows are observations: domain, confidence (0 to 1), correct (boolean). Sums over all rows are partial aggregates;
ranks are taken over distinct confidences in range buckets, so no step needs all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 15


def bin_of(confidence: Column, bins: int = BINS) -> Column:
    """The number of lower edges below the confidence: 1 to bins for (lo, hi], 0 for 0 and less."""
    edges = F.array(*(F.lit(i / bins) for i in range(bins)))
    return F.size(F.filter(edges, lambda e: e < confidence))


def _levels(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of equal confidence as one, with their number (n) and how many are correct (y)."""
    return rows.groupBy(*by, "confidence").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("bigint")).alias("y"))


def _ece(binned: DataFrame, by: list[str]) -> DataFrame:
    """Of weighted rows: bin, confidence, n, y."""
    total = F.sum("n")
    cells = binned.groupBy(*by, "bin").agg((F.sum(F.col("confidence") * F.col("n")) / total).alias("c"), (F.sum("y") / total).alias("a"), total.alias("n"))
    gap = F.sum(F.when(F.col("bin") > 0, F.col("n") * F.abs(F.col("a") - F.col("c"))).otherwise(0.0))
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), F.coalesce(F.try_divide(gap, F.sum("n")), F.lit(float("nan"))).alias("ece"))


def ece_strict(rows: DataFrame, *by: str) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; a confidence of 0 lies in no bin but counts among the rows."""
    return _ece(_levels(rows, list(by)).withColumn("bin", bin_of(F.col("confidence"))), list(by))


def ece_closed(rows: DataFrame, *by: str) -> DataFrame:
    """The same with 0 in the first bin."""
    return _ece(_levels(rows, list(by)).withColumn("bin", F.greatest(bin_of(F.col("confidence")), F.lit(1))), list(by))


def reliability(rows: DataFrame, *by: str) -> DataFrame:
    """Per bin: lower, upper, n, mean confidence, accuracy."""
    binned = rows.withColumn("bin", F.greatest(bin_of(F.col("confidence")), F.lit(1)))
    return binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy")
    ).withColumn("lower", (F.col("bin") - 1) / BINS).withColumn("upper", F.col("bin") / BINS)


def running_total(rows: DataFrame, order: str, value: str, *, buckets: int = 64) -> DataFrame:
    """Adds ``before``: the sum of value over rows of lower ``order`` (distinct numbers), without one task for all."""
    cuts = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))), lambda c: c <= F.col(order).cast("double"))) if cuts else F.lit(0)
    dealt = rows.withColumn("__part", part)
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    over = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", F.coalesce(F.sum("__sum").over(over), F.lit(0)).alias("__offset"))  # a row per bucket
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), "__part").withColumn("before", F.col("__offset") + F.col("__own")).drop("__part", "__offset", "__own")


def auroc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve with ties at half; NaN if a class is missing."""
    right = F.col("correct").cast("bigint")
    levels = rows.groupBy("confidence").agg(F.sum(right).alias("pos"), F.sum(1 - right).alias("neg"))
    ranked = running_total(levels, "confidence", "neg")
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.coalesce(F.try_divide(wins, pairs.cast("double")), F.lit(float("nan"))).alias("auroc"))


def triage(rows: DataFrame, cuts: tuple[float, ...] = (0.5, 0.7, 0.8, 0.9, 0.95)) -> DataFrame:
    """Per cut, of reviewing what lies below it: percent reviewed, errors caught, right rows flagged, errors left."""
    at = rows.withColumn("cut", F.explode(F.array(*(F.lit(c) for c in cuts))))
    low, wrong = F.col("confidence") < F.col("cut"), ~F.col("correct")
    count = lambda c: F.sum(c.cast("bigint"))
    percent = lambda a, b: F.try_divide(100.0 * a, b)
    return at.groupBy("cut").agg(
        percent(count(low), F.count(F.lit(1))).alias("reviewed"),
        percent(count(low & wrong), count(wrong)).alias("caught"),
        percent(count(low & ~wrong), count(~wrong)).alias("flagged"),
        count(~low & wrong).alias("errors_left"),
    )


def recalibrated(confidence: Column, temperature: Column, bias: Column | None = None) -> Column:
    """sigmoid(logit(confidence) / temperature + bias), the confidence kept off 0 and 1."""
    c = F.least(F.greatest(confidence, F.lit(1e-6)), F.lit(1 - 1e-6))
    z = F.ln(c / (1 - c)) / temperature
    return 1 / (1 + F.exp(-(z if bias is None else z + bias)))


def best_temperature(rows: DataFrame, *by: str, low: int = 55, high: int = 550, step: int = 5) -> DataFrame:
    """The temperature (in hundredths: low to high by step, and 1) of least closed ECE; the lowest of equals, 1 first."""
    grid = F.array(F.lit(100), *(F.lit(t) for t in range(low, high + 1, step) if t != 100))
    # the grid multiplies levels of confidence, not rows
    tried = _levels(rows, list(by)).withColumn("t", F.explode(grid))
    scaled = tried.withColumn("confidence", recalibrated(F.col("confidence"), F.col("t") / 100.0))
    binned = scaled.withColumn("bin", F.greatest(bin_of(F.col("confidence")), F.lit(1)))
    errors = _ece(binned, [*by, "t"]).withColumn("ece", F.round("ece", 12))
    return errors.groupBy(*by).agg(F.min_by("t", F.struct("ece", (F.col("t") != 100), "t")).alias("t"), F.min("ece").alias("ece"))


def nll(rows: DataFrame, temperature: float = 1.0) -> Column:
    """-log of the softmax mass on acceptable classes: logits array<double>, acceptable array<int> (from 0)."""
    z = F.transform("logits", lambda x: x / temperature)
    top = F.array_max(z)
    mass = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    good = F.transform("acceptable", lambda i: F.element_at(z, i + 1))
    return F.ln(mass(z)) - F.ln(mass(good))


def bias_fit(rows: DataFrame, domain: str = "domain", source: str = "source") -> DataFrame:
    """Mean residual logit over all rows, and per domain and per source less that global one."""
    c = F.least(F.greatest(F.col("confidence"), F.lit(0.01)), F.lit(0.99))
    target = F.when(F.col("correct"), F.ln(F.lit(0.99 / 0.01))).otherwise(F.ln(F.lit(0.01 / 0.99)))
    residual = target - F.ln(c / (1 - c))
    some = rows.select(F.lit("global").alias("grain"), F.lit("").alias("name"), residual.alias("r"))
    for grain, column in (("domain", domain), ("source", source)):
        some = some.unionByName(rows.select(F.lit(grain).alias("grain"), F.col(column).alias("name"), residual.alias("r")))
    means = some.groupBy("grain", "name").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"))
    overall = F.lit((rows.agg(F.avg(residual)).first() or [None])[0])  # one number
    return means.select("grain", "name", "n", F.when(F.col("grain") == "global", F.col("mean")).otherwise(F.col("mean") - overall).alias("bias"))
