"""The vector index against the exhaustive search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memaudit.operators import search, vector_index


def clustered(n, dim, centres, spread, seed):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, dim))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    x = middle[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def data(spark):
    vectors = clustered(3000, 24, 40, 0.05, 1)
    vectors += [vectors[5]] * 300 + [vectors[9]] * 20  # copies, so ties at every rank
    entries = spark.createDataFrame(list(enumerate(vectors)), "entry_id long, vector array<double>").repartition(5)
    queries = spark.createDataFrame([(i, v) for i, v in enumerate(clustered(150, 24, 40, 0.05, 1) + clustered(30, 24, 5, 1.0, 9) + [vectors[5]])], "fact long, vector array<double>").repartition(3)
    return queries, entries, vector_index.build(entries)


def test_search_is_exact_and_scores_few_pairs(spark, data):
    queries, entries, index = data
    assert index.n_entries == 3320
    for k, floor in ((1, -2.0), (7, -2.0), (7, 0.6), (400, -2.0)):
        got, cost = vector_index.nearest(queries, index, k, floor)
        assert rows(got.select("fact", "entry_id", "score", "rank")) == rows(search.nearest(queries, entries, k, floor).select("fact", "entry_id", "score", "rank"))
        assert cost.count() == 181
        if k == 7 and floor < 0:
            near = cost.where("fact < 150").agg(F.sum("scored")).first()[0]
            assert near < 0.2 * 150 * 3320  # of the queries that lie in clusters


def test_pairs_over_a_floor(spark, data):
    queries, entries, index = data
    for floor in (0.9, 0.3):
        assert rows(vector_index.score_pairs(queries, index, floor)) == rows(search.score_pairs(queries, entries, floor))


def test_small_blocks_and_one_cell(spark, data, monkeypatch):
    queries, entries, _ = data
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 50)
    index = vector_index.build(entries, cells=1, shells=3, steps=1)
    got, cost = vector_index.nearest(queries, index, 5)
    assert rows(got.select("fact", "entry_id", "rank")) == rows(search.nearest(queries, entries, 5).select("fact", "entry_id", "rank"))
    assert index.blocks.count() > 60 and cost.agg(F.max("scored")).first()[0] <= 3320


def test_written_index_reads_back(spark, data, tmp_path):
    queries, entries, index = data
    vector_index.write(index, str(tmp_path / "index"))
    again = vector_index.read(spark, str(tmp_path / "index"))
    assert rows(vector_index.nearest(queries, again, 3)[0]) == rows(vector_index.nearest(queries, index, 3)[0])
    assert rows(vector_index.entry_rows(again)) == rows(entries)
    with pytest.raises(Exception, match="(?i)already exists"):
        vector_index.write(index, str(tmp_path / "index"))


def test_empty_single_and_unequal(spark):
    kind, q = "entry_id string, vector array<double>", "fact long, vector array<double>"
    none = vector_index.build(spark.createDataFrame([], kind))
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, -1.0])], q)
    assert vector_index.nearest(queries, none, 2)[0].count() == 0 and vector_index.score_pairs(queries, none, 0.0).count() == 0
    one = vector_index.build(spark.createDataFrame([("a", [1.0, 0.0]), (None, [0.0, 1.0]), ("b", None)], kind))
    assert [tuple(r) for r in vector_index.nearest(queries.where("fact = 1"), one, 1)[0].select("entry_id", "score").collect()] == [("a", 1.0)]
    assert vector_index.nearest(queries.limit(0), one, 1)[0].count() == 0
    with pytest.raises(ValueError, match="components"):
        vector_index.build(spark.createDataFrame([("a", [1.0]), ("b", [0.0, 1.0])], kind))


def test_queries_in_blocks_of_bounded_bytes(spark, data, monkeypatch):
    queries, entries, _ = data
    whole = rows(search.nearest(queries, entries, 3)), rows(search.score_pairs(queries, entries, 0.9))
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 24 * 50)  # 181 queries in blocks of 50
    assert (rows(search.nearest(queries, entries, 3)), rows(search.score_pairs(queries, entries, 0.9))) == whole


def test_vectors_are_not_repeated_per_visit(spark, data):
    """However many shells a query visits, its vector is shuffled once a meeting: no join by shell, no row a visit."""
    queries, entries, index = data
    plan = vector_index.score_pairs(queries, index, -1.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "HashJoin" not in plan and "SortMergeJoin" not in plan
