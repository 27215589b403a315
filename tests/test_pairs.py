"""What is decided of pairs where they are scored, against the same said in columns and against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memaudit.functions import text as T
from memaudit.operators import search
from memaudit.plans import registry


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_judged_is_judge_norms(spark):
    words = ["", "a", "ab", "label 1", "label 10", "the label 1", "abc", "x abc y", None]
    pairs = spark.createDataFrame([(v, a) for v in words for a in [None, [], *([w] for w in words), ["label 1", None, "abc"]]], "v string, a array<string>")
    for v, a, want in pairs.withColumn("j", T.judge_norms(F.col("v"), F.col("a"))).collect():
        assert search.judged(v, a) == want


def test_six_places_are_those_of_sql(spark):
    s = np.round(np.concatenate([np.random.default_rng(1).uniform(-1, 1, 3000), [0.1234565, -0.1234565, 0.0000005, 1.0, -1.0, 0.2000005]]), 12)
    want = [r[0] for r in spark.createDataFrame([(float(x),) for x in s], "s double").select(F.round("s", 6)).collect()]
    assert search.six_places(s).tolist() == want


@pytest.mark.parametrize("scale", (1.0, 1e30))  # single precision holds only the first
def test_hits_match_plain(scale):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(70, 9)), r.normal(size=(90, 9))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    y[20:50] = x[3]  # ties
    plain = np.round(np.einsum("id,jd->ij", x, y), 12)
    low, below = np.round(plain[:, 25], 12), 0.9  # many scores lie on the floor
    for exact in (True, False):
        got = {(a, b) for q, e, _ in search.hits(x * scale, y / scale, low, below, exact) for a, b in zip(q.tolist(), e.tolist())}
        sure = {(a, b) for a, b in zip(*np.nonzero((plain >= low[:, None] + 1e-11) & (plain < below - 1e-11)))}
        fair = {(a, b) for a, b in zip(*np.nonzero((plain >= low[:, None] - 1e-11) & (plain < below + 1e-11)))}
        assert sure <= got <= fair
        assert all(len({(a, b) in got for b in range(20, 50)}) == 1 for a in range(70))  # copies tie


def test_nearest_below_is_nearest_under_each(spark):
    r = np.random.default_rng(4)
    v = r.normal(size=(120, 6))
    v[30:60] = v[2]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "fact long, vector array<double>").repartition(3)
    e = q.withColumnRenamed("fact", "entry_id")
    got = search.nearest_below(q, e, 4, [0.9, 0.3, 0.1], 0.0).localCheckpoint()
    for below in (0.9, 0.3, 0.1):
        assert rows(got.where(F.col("below") == below).select("fact", "entry_id", "score", "rank")) == rows(search.nearest(q, e, 4, 0.0, below=below).select("fact", "entry_id", "score", "rank"))


@pytest.mark.parametrize("name", ("filter_reasons", "overfetch_widen", "closure_family", "nested_family", "serialize_candidate", "slim_projection"))
def test_pairs_are_not_looked_at_row_by_row(spark, monkeypatch, name):
    """All pairs over the floor used to be rows of a plan, with their texts and lists."""

    def refuse(*args, **more):
        raise AssertionError("pairs as rows")

    monkeypatch.setattr(search, "score_pairs", refuse)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
