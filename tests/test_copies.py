"""Searches where an exclusion hides many copies of a query's best, or entries come in many parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memaudit.functions import text as T
from memaudit.operators import audit, search

CARRY = ("value", "value_norm", "source_id")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def data(spark):
    """Of each vector 120 copies with one value, so of a fact's page all may name its answer."""
    r = np.random.default_rng(11)
    x = np.repeat(r.normal(size=(5, 6)), 120, axis=0)
    x = np.concatenate([x, r.normal(size=(40, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    entries = spark.createDataFrame([(i, v, f"label {i // 120}", i % 5) for i, v in enumerate(x.tolist())], "entry_id long, vector array<double>, value string, source_id long")
    entries = entries.withColumn("value_norm", T.norm(F.col("value"))).repartition(3).cache()
    queries = entries.select(F.col("entry_id").alias("fact"), "vector").repartition(2)
    return queries, entries, search.score_pairs(queries, entries, -0.5, carry=CARRY).localCheckpoint()


def counting(monkeypatch):
    sizes, keep = [], search.stored

    def counted(df, name):
        out = keep(df, name)
        sizes.append(out.count() if name == "page" else 0)
        return out

    monkeypatch.setattr(search, "stored", counted)
    return sizes


@pytest.mark.parametrize("waiting", [50, 200_000])
def test_hidden_copies_are_not_written(spark, data, monkeypatch, waiting):
    queries, entries, pairs = data
    monkeypatch.setattr(search, "WAITING", waiting)
    own = entries.select(F.col("entry_id").alias("fact"), F.col("value_norm").alias("mine"))
    sizes, other = counting(monkeypatch), F.col("value_norm") != F.col("mine")
    for below in (None, 0.6):
        got = search.paged(queries, entries, None, min_score=-0.5, below=below, carry=CARRY, page=8, kept=[(other, 3), (F.col("source_id") != 2, 2)], own=own)
        every = pairs.join(own, "fact") if below is None else pairs.where(F.col("score") < below).join(own, "fact")
        for holds, n in ((other, 3), (F.col("source_id") != 2, 2)):
            best = lambda p: rows(search.top_k(p.where(holds), n).select("fact", "entry_id", "rank", "score", "value", "source_id", "mine"))  # noqa: B023, E731
            assert best(got.drop("rank")) == best(every)
        assert got.count() == got.select("fact", "entry_id").distinct().count()
    n = queries.count()
    assert max(sizes) <= 8 * n and sum(sizes) <= 2 * 16 * n


def test_contenders_of_copies(spark, data, monkeypatch):
    queries, entries, pairs = data
    who = audit.best(pairs, 0.25).withColumn("gold_norms", F.array(T.norm(F.col("selected_value")))).withColumn("parametric", F.lit("none"))
    sizes = counting(monkeypatch)
    few = audit.contenders(who, queries, entries, 0.25, 0.6)
    assert rows(audit.three_states(who, few, 0.25, 0.6).drop("gold_norms")) == rows(audit.three_states(who, pairs, 0.25, 0.6).drop("gold_norms"))
    assert max(sizes) <= search.PAGE * queries.count()


def test_rows_a_query_do_not_grow_with_parts(spark, data, monkeypatch):
    queries, entries, pairs = data
    monkeypatch.setattr(search, "ENTRY_BYTES", 4_000)
    monkeypatch.setattr(search, "QUERY_BYTES", 2_000)
    returned, keep = [], search.top_k

    def counted(found, *args, **more):
        returned.append(found.count())
        return keep(found, *args, **more)

    monkeypatch.setattr(search, "top_k", counted)
    got = search.nearest(queries, entries, 4, -0.5)
    assert max(returned) <= 4 * queries.count()
    assert rows(got.select("fact", "entry_id", "rank")) == rows(keep(pairs, 4).select("fact", "entry_id", "rank"))
    counts = pairs.groupBy("fact").agg(F.count_if(F.col("score") >= 0.2), F.count_if(F.col("score") >= 0.75))
    assert rows(search.tallies(queries, entries, [0.2, 0.75])) == rows(counts)
