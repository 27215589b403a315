"""Registered queries that SQL can't express, and second branches, against plain versions."""

import difflib
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memaudit.functions import stats
from memaudit.functions import text as T
from memaudit.operators import followups
from memaudit.plans import registry

DATA = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


def tokens(text):
    return re.findall(r"\d+\.\d+|\w+(?:[-']\w+)*", (text or "").lower().replace("ß", "ss").replace("ς", "σ"))


def test_canaries_are_those_of_crc32(spark):
    got = {x.event_id for x in registry.QUERIES["crc_canary"](spark, DATA).collect()}
    assert got == {x.event_id for x in rows(spark, "events") if zlib.crc32(str(x.event_id).encode()) % 10_000 < 500}


def test_hashed_prompts_match_plain_vectors(spark):
    got = {x.item_id: x.vector for x in registry.QUERIES["hashed_prompt"](spark, DATA).collect()}
    for x in rows(spark, "benchmark"):
        words = tokens(x.text)
        v = np.zeros(64)
        for g in [*words, *("_".join(p) for p in zip(words, words[1:]))]:
            digest = hashlib.md5(g.encode()).digest()
            v[int.from_bytes(digest[:4], "little") % 64] += 1 if digest[4] & 1 else -1
        assert np.allclose(got[x.item_id], v / np.linalg.norm(v), atol=1e-8)


def test_ratios_match_difflib_on_whole_turns(spark):
    turns = {}
    for x in rows(spark, "conversations"):
        turns[x.conv_id, x.turn] = x
    got = registry.QUERIES["seq_ratio_signal"](spark, DATA).collect()
    assert got
    for x in got:
        before = max(t for c, t in turns if c == x.conv_id and t < x.turn)
        a, b = (" ".join(tokens(turns[x.conv_id, t].text)) for t in (x.turn, before))
        assert math.isclose(x.ratio, difflib.SequenceMatcher(None, a, b).ratio(), abs_tol=1e-6)


def test_trigram_features_of_any_dimension(spark):
    words = ["", "Paris", "a", "Ærø 12"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for dim in (2048, 1000):
        got = [{f.feature: f.weight for f in r[0]} for r in df.select(T.answer_features(F.col("w"), dim)).collect()]
        for w, features in zip(words, got):
            s, v = f"##{' '.join(tokens(w))}##", {}
            for i in range(len(s) - 2):
                at = int(hashlib.md5(s[i : i + 3].encode()).hexdigest(), 16) % dim
                v[at] = v.get(at, 0) + 1
            n = math.sqrt(sum(x * x for x in v.values()))
            assert features.keys() == v.keys() and all(math.isclose(features[k], v[k] / n) for k in v)


def test_ranks_over_many_ranges(spark):
    r = np.random.default_rng(1)
    data = [(int(g), int(v)) for g, v in zip(r.integers(0, 3, 500), r.integers(0, 40, 500))] + [(None, 3), (None, 3), (None, 1)]
    df = spark.createDataFrame(data, "g int, v int").where("g is not null")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("__n"))
    got = {(x.g, x.v): x["__before"] for x in stats.running(counts, "v", "__n", ("g",), parts=7).collect()}
    known = [d for d in data if d[0] is not None]
    assert got == {(g, v): sum(1 for a, b in known if a == g and b < v) for g, v in set(known)}
    assert stats.quartile_edges(df, "v") == [sorted(v for _, v in known)[int(q * 500)] for q in (0.25, 0.5, 0.75)]


def test_odds_ratio_matches_a_plain_newton_fit(spark):
    r = np.random.default_rng(2)
    freq = r.integers(0, 60, 300)
    hit = r.random(300) < 1 / (1 + np.exp(-(0.6 * np.log2(freq + 1) - 2)))
    out = stats.logit_per_doubling(spark.createDataFrame([(int(f), bool(h)) for f, h in zip(freq, hit)], "f int, h boolean"), "f", "h")
    x = np.stack([np.ones(300), np.log2(freq + 1)], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (hit - p))
    assert math.isclose(out["slope"], beta[1], abs_tol=1e-5) and out["low"] < out["odds_ratio"] < out["high"]


def test_too_many_folds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(followups, "MOST_FOLDS", 3)
    df = spark.createDataFrame([(i, "r", "a") for i in range(4)], "fold int, relation string, answer string")
    with pytest.raises(ValueError, match="4 folds"):
        followups.majority_priors(df)
    assert followups.majority_priors(df.where("fold < 3")).first()["facts"] == 3
