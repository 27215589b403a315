"""Rank and association statistics on DataFrames; each returns one row per group (one row in all without groups)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memaudit.operators.scratch import stored


def running(counts: DataFrame, value: str, n: str = "__n", by: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """counts (one row per group and value) with __before, the sum of n over the group's lesser values.

    Rows are range partitioned by (by, value) and summed in order within ranges; a range's offset is the sum of the
    ranges before it, of which there are only as many as partitions. No task sees more than one range.
    """
    order = [*by, value]
    ranges = counts.repartitionByRange(*([parts] if parts else []), *order).withColumn("__part", F.spark_partition_id())
    ranges = stored(ranges, "ranges")
    inside = Window.partitionBy("__part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("__part", *by).agg(F.sum(n).alias("__sum"))  # a group that is cut has one row a partition
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("__part").alias("__p2"), *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    same = F.col("__part") == F.col("__p2")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    joined = ranges.withColumn("__inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(offsets, same)
    return joined.select(*counts.columns, (F.col("__inside") + F.col("__offset")).alias("__before"))


def ranked(df: DataFrame, value: str, out: str, by: tuple[str, ...] = (), base: int = 1) -> DataFrame:
    """Average ranks from `base`, ties sharing theirs.

    Ranks come from value counts: rows are first aggregated per value, the distinct values are range partitioned, and
    sums before a range are carried to it, so neither a group's rows nor its values meet in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    ranks = running(counts, value, "__n", by).withColumn(out, F.col("__before") + base + (F.col("__n") - 1) / 2).drop("__n", "__before")
    return df.join(ranks, [*by, value])


def auroc(df: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mann-Whitney statistic with average ranks; null if a class is missing. label is boolean; null scores are left out.

    It needs the rows and positives of each distinct score only, so however many rows share a score, none is joined.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(*by, score).agg(F.count("*").alias("__n"), F.count_if(F.col(label)).alias("__up"))
    ranks = running(counts, score, "__n", by)
    up, n = F.sum("__up"), F.sum("__n")
    over = F.sum(F.col("__up") * (F.col("__before") + (F.col("__n") + 1) / 2)) - up * (up + 1) / 2
    found = ranks.groupBy(*by).agg(up.alias("positives"), (n - up).alias("negatives"), over.alias("__over"))
    value = F.when((F.col("positives") > 0) & (F.col("negatives") > 0), F.try_divide(F.col("__over"), F.col("positives").cast("double") * F.col("negatives")))
    found = found.select(*by, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("positives", "negatives")], value.alias("auroc"))
    return found


def spearman(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation of average ranks; null where a variance is zero.

    Ranks are those of distinct values and meet the counts of distinct pairs, so equal rows are one row from the start.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = stored(rows.groupBy(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__n")), "pair-counts")

    def ranks(value: str) -> DataFrame:
        counts = running(pairs.groupBy(*by, value).agg(F.sum("__n").alias("__m")), value, "__m", by)
        return counts.select(*by, value, (F.col("__before") + (F.col("__m") + 1) / 2).alias(f"__r{value}"))

    r = pairs.join(ranks("__x"), [*by, "__x"]).join(ranks("__y"), [*by, "__y"])
    n, rx, ry = F.col("__n"), F.col("__r__x"), F.col("__r__y")
    sums = r.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0).cast("long")).alias("n"), *[F.sum(n * v).alias(c) for c, v in (("__sx", rx), ("__sy", ry), ("__sxx", rx * rx), ("__syy", ry * ry), ("__sxy", rx * ry))])
    mean = lambda c: F.try_divide(F.col(c), F.col("n"))
    cov = mean("__sxy") - mean("__sx") * mean("__sy")
    var = (mean("__sxx") - mean("__sx") * mean("__sx")) * (mean("__syy") - mean("__sy") * mean("__sy"))
    return sums.select(*by, "n", F.when(var > 1e-12, cov / F.sqrt(var)).alias("spearman"))


def phi(df: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Phi coefficient of two booleans; null if a margin is empty."""
    a, b = F.col(x), F.col(y)
    n11, n10, n01, n00 = (F.count_if(c).cast("double") for c in (a & b, a & ~b, ~a & b, ~a & ~b))
    margins = (n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00)
    return df.groupBy(*by).agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("n"), F.when(margins > 0, (n11 * n00 - n10 * n01) / F.sqrt(margins)).alias("phi"))


def answer_entropy(df: DataFrame, answer: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct answers, the commonest answer's share, and entropy over its maximum (0 with one answer)."""
    counts = df.groupBy(*by, answer).agg(F.count("*").alias("__n"))
    # sum of -p ln p = ln N - (sum of n ln n) / N
    total, k = F.sum("__n"), F.count("*")
    raw = F.log(total) - F.sum(F.col("__n") * F.log("__n")) / total
    return counts.groupBy(*by).agg(k.alias("answers"), (F.max("__n") / total).alias("majority_share"), F.when(k > 1, raw / F.log(k)).otherwise(0.0).alias("entropy"))


def quartile_edges(df: DataFrame, value: str) -> list:
    """Values at places int(q n) of the sorted values for q = 1/4, 1/2, 3/4, from counts per value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return []
    upto = running(counts, value, "n").withColumn("upto", F.col("__before") + F.col("n"))
    places = [int(q * total) for q in (0.25, 0.5, 0.75)]
    row = upto.agg(*[F.min(F.when(F.col("upto") > p, F.col(value))).alias(f"q{i}") for i, p in enumerate(places)]).first()
    return list(row)


def quartile_bin(value: Column, edges: list) -> Column:
    """Number of edges strictly below the value."""
    return sum((F.when(F.lit(e) < value, 1).otherwise(0) for e in edges), F.lit(0))


def quartile_bins(df: DataFrame, value: str, outcomes: list[str], near: float = 450) -> DataFrame:
    """Per quartile bin: facts, mean of each outcome, and the share of values at or above `near`."""
    edges = quartile_edges(df, value)
    rows = df.where(F.col(value).isNotNull()).withColumn("bin", quartile_bin(F.col(value), edges))
    return rows.groupBy("bin").agg(F.count("*").alias("facts"), *[F.avg(F.col(o).cast("double")).alias(f"mean_{o}") for o in outcomes], F.avg((F.col(value) >= near).cast("double")).alias("near_cap_share"))


def logit_per_doubling(df: DataFrame, frequency: str, outcome: str) -> dict[str, float | int | None]:
    """Logistic regression of a boolean outcome on log2(frequency + 1): odds ratio per doubling with a 95 % Wald interval.

    Newton steps with a ridge of 1e-8, at most 100, to 1e-9. Each step needs five sums over the distinct frequencies
    (sufficient statistics), which are computed where the data are; nothing else reaches the driver. Null below three
    rows or with one class.
    """
    none = {"n": 0, "odds_ratio": None, "low": None, "high": None, "slope": None}
    data = df.where(F.col(frequency).isNotNull() & F.col(outcome).isNotNull()).groupBy(F.log2(F.col(frequency) + 1.0).alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(outcome).cast("double")).alias("k")).persist()
    try:
        n, k = data.agg(F.sum("n"), F.sum("k")).first()
        n, k = int(n or 0), int(k or 0)
        if n < 3 or k in (0, n):
            return none | {"n": n}
        beta = np.zeros(2)
        for _ in range(100):
            z = F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("x")
            p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-50.0)), F.lit(50.0))))
            w, rest, x = F.col("n") * p * (1 - p), F.col("k") - F.col("n") * p, F.col("x")
            h00, h01, h11, g0, g1 = data.agg(F.sum(w), F.sum(w * x), F.sum(w * x * x), F.sum(rest), F.sum(rest * x)).first()
            hessian = np.array([[h00, h01], [h01, h11]]) + 1e-8 * np.eye(2)
            step = np.linalg.solve(hessian, np.array([g0, g1]) - 1e-8 * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        se = math.sqrt(max(np.linalg.inv(hessian)[1, 1], 0.0))
        bound = lambda v: math.exp(max(-50.0, min(50.0, v)))
        return {"n": n, "slope": float(beta[1]), "odds_ratio": bound(beta[1]), "low": bound(beta[1] - 1.96 * se), "high": bound(beta[1] + 1.96 * se)}
    finally:
        data.unpersist()
