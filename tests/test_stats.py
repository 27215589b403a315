"""Rank statistics from counts, with one value in half of all rows."""

import random

import numpy as np
import pytest

from memaudit.functions import stats


def average_ranks(values):
    order = sorted(values)
    first, last = {}, {}
    for i, v in enumerate(order, 1):
        first.setdefault(v, i)
        last[v] = i
    return np.array([(first[v] + last[v]) / 2 for v in values])


def rows(seed=4, n=600):
    r = random.Random(seed)
    out = [(g, r.choice([0.0] * 5 + [r.randrange(9) / 4 for _ in range(5)]), r.choice([1.5, 1.5, r.randrange(6)]) * 1.0, r.random() < 0.3) for g in "ab" for _ in range(n)]
    return out + [("c", 1.0, 2.0, True)] * 3 + [("a", None, 1.0, True), ("a", 1.0, None, None)]


def test_auroc_and_spearman_of_counts(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, x double, y double, label boolean").repartition(5)
    curves = {r.g: r for r in stats.auroc(df, "x", "label", ("g",)).collect()}
    links = {r.g: r for r in stats.spearman(df, "x", "y", ("g",)).collect()}
    for g in "ab":
        own = [(x, up) for k, x, _, up in data if k == g and x is not None and up is not None]
        ranks, up = average_ranks([x for x, _ in own]), np.array([u for _, u in own])
        want = (ranks[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())
        assert curves[g].auroc == pytest.approx(want) and (curves[g].positives, curves[g].negatives) == (up.sum(), (~up).sum())
        both = [(x, y) for k, x, y, _ in data if k == g and None not in (x, y)]
        a, b = (average_ranks(v) for v in zip(*both))
        assert links[g].spearman == pytest.approx(np.corrcoef(a, b)[0, 1]) and links[g].n == len(both)
    assert curves["c"].auroc is None and curves["c"].positives == 3 and links["c"].spearman is None
    whole = stats.auroc(df, "x", "label").first()
    own = [(x, up) for _, x, _, up in data if x is not None and up is not None]
    ranks, up = average_ranks([x for x, _ in own]), np.array([u for _, u in own])
    assert whole.auroc == pytest.approx((ranks[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum()))
    none = df.limit(0)
    assert [tuple(r) for r in stats.auroc(none, "x", "label").collect()] == [(0, 0, None)]
    assert [tuple(r) for r in stats.spearman(none, "x", "y").collect()] == [(0, None)]


def test_numbers_are_dense_and_in_order(spark):
    from pyspark.sql import functions as F

    from memaudit.sources.prompts import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(6)
    assert [tuple(r) for r in numbered(df, "k").orderBy("k").select("k", "row_index").collect()] == [(i, i) for i in range(1000)]
