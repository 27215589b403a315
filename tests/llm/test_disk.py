"""What the near-duplicate join writes: one shuffle of its keys, and the sets of pairs that may link."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memaudit.llm import ngram_join


def texts(n: int) -> list[tuple[int, str]]:
    """Documents that share a passage of half their words, so keys, but don't link; every tenth has a near copy."""
    r = np.random.default_rng(3)
    common = " ".join(f"c{i}" for i in range(60))
    own = [" ".join(f"w{x}" for x in r.integers(0, 10**9, 60)) for _ in range(n)]
    return [(i, f"{common} {own[i]}") for i in range(n)] + [(n + i, f"{common} {own[i]} end") for i in range(0, n, 10)]


def test_keys_are_not_written_and_hopeless_pairs_not_compared(spark, monkeypatch):
    written, keep = {}, ngram_join.stored

    def counted(df, kind):
        out = keep(df, kind)
        written[kind] = max(written.get(kind, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    monkeypatch.setattr(ngram_join, "SAMPLE", 20)
    docs = spark.createDataFrame(texts(200), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, 5, 80).collect()}
    assert got == {i: i - 200 if i >= 200 else i for i, _ in texts(200)}
    assert "keys" not in written and written["sample-keys"] < 60 * 220
    assert written["led-keys"] > 220  # many share keys
    assert written["pairs"] <= 60  # each with a copy at most, not with each key's leader


@pytest.mark.parametrize("parts", (2, 9))
def test_ranges_from_a_sample_deal_every_key_once(spark, parts):
    docs = spark.createDataFrame(texts(80), "doc_id long, text string").repartition(3)
    source = ngram_join._texts(docs, "doc_id", "text")
    starts, alloc = ngram_join.schemes(80, {i: 40 for i in range(30)})
    bounds = ngram_join._bounds(source, 5, starts, alloc, 88, parts)
    assert bounds == sorted(bounds) and len(bounds) < parts
    keyed = ngram_join._keys(source, 5, starts, alloc, bounds).cache()
    order = F.struct("key", (F.col("bits") < 2).cast("long").alias("away"), "node")
    edges = [(tuple(r.lo), tuple(r.hi)) for r in keyed.groupBy("part").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).orderBy("part").collect()]
    assert len(edges) == len(bounds) + 1 and all(a[1] < b[0] for a, b in zip(edges, edges[1:]))
    rows = lambda df: sorted(map(tuple, df.select("key", "node", "bits").distinct().collect()))
    assert rows(ngram_join._shared(keyed, len(bounds) + 1)) == rows(ngram_join._shared(keyed.drop("part"))) != []
