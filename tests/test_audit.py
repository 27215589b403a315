"""Search, closures, metrics, sweep, attack and incremental execution on literal fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from memaudit.functions import text as T
from memaudit.functions import vectors as V
from memaudit.operators import adversary, audit, closure, followups, incremental, metrics, neighbors, search, sweep
from memaudit.sources import files, prompts


def unit(c):
    return [c, math.sqrt(1 - c * c)]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("target-entry", unit(0.95), "Paris", "wiki:France"), ("near-neighbor", unit(0.9), "Lyon", "wiki:Lyon"), ("alias-entry", unit(0.5), "The capital is Paris", "wiki:ParisCity"), ("far-entry", unit(0.1), "Berlin", "wiki:France")]
    e = spark.createDataFrame(rows, "entry_id string, vector array<double>, value string, source_id string")
    q = spark.createDataFrame([("f", [1.0, 0.0])], "fact string, vector array<double>")
    pairs = search.score_pairs(q, e).join(e.drop("vector"), "entry_id")
    return pairs.withColumn("value_norm", T.norm(F.col("value"))).withColumn("answer_norms", F.array(F.lit("paris")))


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([("f", "target-entry", "wiki:France")], "fact string, entry_id string, source_id string")


def test_closure_attribution(spark, scored, seeds):
    c = closure.caught(scored, seeds, [0.8])
    got = {r.entry_id: set(r.caught_by) for r in c.collect()}
    assert got == {"target-entry": {"geometric", "oracle", "provenance", "value"}, "near-neighbor": {"geometric"}, "alias-entry": {"value"}, "far-entry": {"provenance"}}
    n = closure.entry_counts(c).first()
    assert (n.geometric, n.value, n.provenance, n.oracle) == (2, 2, 2, 1)
    few = closure.truncated(c, 1).collect()
    assert [r.entry_id for r in few] == ["target-entry"] and few[0].truncated
    assert closure.nesting_violations(closure.caught(scored, seeds, closure.radius_grid(0.95, 0.05, 0.15))).count() == 0
    g = closure.geometry(scored, closure.caught(scored, seeds, [0.8], closure.ClosureConfig(predicates=("geometric",))), seeds, provenance=False).first()
    assert math.isclose(g.s_del, 0.95) and math.isclose(g.s_surv, 0.5) and g.survivors == ["alias-entry", "far-entry"]


def test_radius_grid_and_configs():
    assert closure.radius_grid(0.95, 0.70, 0.05) == [0.95, 0.9, 0.85, 0.8, 0.75, 0.7]
    for bad in (dict(predicates=("x",)), dict(radius=2), dict(envelope_top_k=0)):
        with pytest.raises(ValueError):
            closure.ClosureConfig(**bad)
    assert closure.ClosureConfig(predicates=("semantic",)).active == ("value",)
    with pytest.raises(ValueError):
        neighbors.NeighborConfig(cap=2, min_count=3)
    with pytest.raises(ValueError):
        audit.validate_modes(sweep=True, closure=("value",))
    audit.validate_modes(bootstrap=True, closure=("geometric",))


def test_exclusions(spark, scored):
    gone = spark.createDataFrame([("f", "wiki:France"), ("f", None)], "fact string, source_id string")
    assert [r.entry_id for r in search.top_k(search.exclude_sources(scored, gone), 5).orderBy("rank").collect()] == ["near-neighbor", "alias-entry"]
    answers = spark.createDataFrame([("f", ["paris"])], "fact string, answer_norms array<string>")
    assert {r.entry_id for r in search.exclude_values(scored, answers).collect()} == {"near-neighbor", "far-entry"}
    ranked = scored.withColumn("rank", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("fact").orderBy(F.desc("score")))).withColumn("excluded", F.col("rank") < 4)
    plan = search.widening_plan(ranked, 1, over_fetch=1, ceiling=64).first()
    assert (plan.searched_top_k, plan.widenings, plan.exceeded) == (4, 1, False)


def test_neighbors(spark):
    f = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [-1.0, 0.0])], "fact string, vector array<double>")
    near = {(r.fact, r.neighbor) for r in neighbors.cosine_neighbors(f).collect()}
    assert near == {("a", "b"), ("b", "a")}
    filled = neighbors.cosine_neighbors(f, neighbors.NeighborConfig(ball=0.95, cap=2, min_count=1)).where("fact = 'a'").collect()
    assert [(r.neighbor, r.within_ball) for r in filled] == [("b", False)]
    s = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("c", "s2"), ("d", None)], "fact string, source_id string")
    assert {(r.fact, r.neighbor) for r in neighbors.same_source_neighbors(s).collect()} == {("a", "b"), ("b", "a")}


def result(fact, state, output, gold="right", row=0):
    return (fact, None, "q", gold, None, row, None, state, output)


RESULT = "fact_id string, prompt_id string, prompt string, ground_truth string, manifest_id string, row_index int, object_aliases array<string>, state string, model_output string"


def test_metrics_golden(spark):
    rows = [("g", "DEL-ON", "right"), ("g", "DEL-OFF", "unknown"), ("n", "DEL-ON", "right"), ("n", "DEL-OFF", "right"), ("n", "FULL", "wrong"), ("g", "FULL", "wrong"), ("n", "FULL", "right")]
    m = metrics.metrics_total(spark.createDataFrame([result(f, s, o, row=i) for i, (f, s, o) in enumerate(rows)], RESULT), traces=False).first()
    assert (m.paired_count, m.full_correct_paired_count, m.parametric_leakage, m.retrieval_mediated_correctness, m.retrieval_interference) == (2, 1, 0.5, 0.5, 0.0)
    assert (m.parametric_leakage_given_full, m.post_deletion_survival_given_full) == (1.0, 1.0)
    only = metrics.metrics_total(spark.createDataFrame([result("x", "FULL", "right"), result("x", "DEL-ON", "right")], RESULT), traces=False).first()
    assert only.paired_count == 0 and only.post_deletion_survival_given_full == 0.0
    none = metrics.metrics_total(spark.createDataFrame([], RESULT), traces=False).first()
    assert none["count"] == 0 and none.exact_match_rate == 0.0
    bad = metrics.validate_states(spark.createDataFrame([result("x", "FULL", "a"), result("x", "DEL-ON", "a", gold="other")], RESULT))
    assert {r.problem for r in bad.collect()} == {"states", "identity"}


def test_entanglement_golden(spark):
    rows = [("t", 0.9, "target", "t", True), ("t", 0.9, "neighbor", "n1", True), ("t", 0.5, "target", "t", False), ("t", 0.5, "neighbor", "n1", False), ("w", 0.5, "target", "w", False)]
    s = spark.createDataFrame(rows, "target string, rho double, role string, subject string, correct boolean")
    near = spark.createDataFrame([("t", "n1")], "fact string, neighbor string")
    full = spark.createDataFrame([("t",), ("n1",)], "fact string")
    curve = sweep.entanglement_curve(s, near, full)
    assert {(r.rho, r.efficacy, r.collateral, r.gap_term) for r in curve.collect()} == {(0.9, 0.0, 0.0, 1.0), (0.5, 1.0, 1.0, 1.0)}
    gap = sweep.entanglement_gap(curve).collect()
    assert [(g.target, g.gap, g.gap_rho, g.gap_eligible) for g in gap] == [("t", 1.0, 0.9, True)]
    alone = sweep.entanglement_gap(sweep.entanglement_curve(s, near.limit(0), full)).first()
    assert alone.gap is None and not alone.gap_eligible


def test_attack_templates_and_topologies(spark):
    f = spark.createDataFrame([("f", [1.0, 0.0, 0.0], "Spice Girls")], "fact string, vector array<double>, answer string")
    sizes = {"single": (1, 0), "aliased": (2, 0), "collided": (1, 2), "saturated": (1, 2)}
    for topology, (survivors, decoys) in sizes.items():
        c = adversary.AdversarialConfig(rho=0.85, epsilons=(0.05,), templates=("hyphenated",), topology=topology, count=2)
        rows = adversary.build_injections(f, c).withColumn("cos", V.dot(F.col("vector"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))).withColumn("n", V.length(F.col("vector"))).collect()
        assert (sum(not r.decoy for r in rows), sum(r.decoy for r in rows)) == (survivors, decoys)
        for r in rows:
            assert math.isclose(r.cos, 0.9 if topology == "saturated" and r.decoy else 0.8, abs_tol=1e-9) and math.isclose(r.n, 1, abs_tol=1e-9)
    evades = f.select(*[adversary.template_evades(F.col("answer"), F.lit(t)).alias(t) for t in adversary.TEMPLATES]).first()
    assert [evades[t] for t in adversary.TEMPLATES] == [False, True, True, True]
    assert f.select(adversary.survivor_value(F.col("answer"), F.lit("letter-spaced"))).first()[0] == "The answer is spelled S p i c e  G i r l s."


def test_incremental(spark):
    jobs = spark.createDataFrame([(i, str(i % 2)) for i in range(6)], "k int, fingerprint string")
    stored = spark.createDataFrame([(0, "0", 1, "late"), (0, "0", 0, "early"), (1, "0", 0, "other")], "k int, fingerprint string, source_pos int, out string")
    served, rest = incremental.reuse(jobs, stored, ["k"])
    assert [(r.k, r.out) for r in served.collect()] == [(0, "early")] and rest.count() == 5
    fresh = served.select("k", F.lit("changed").alias("out"))
    assert incremental.canary_mismatches(served, fresh, ["k"], ["out"]).count() == 1
    assert sum(incremental.stripe(jobs, i, 4, "k").count() for i in range(4)) == 6
    plan = incremental.audit_plan({"a": 100, "b": 10}, ["m", "=p"], ["oracle", "value"])
    order = [j.name for j in incremental.job_order(plan)]
    assert len(order) == 14 and order.index("a/m/standard") < order.index("a/m/sweep") and len(incremental.plan_fingerprint(plan)) == 12
    with pytest.raises(ValueError):
        incremental.job_order([incremental.Job("x", "sweep", 1, ("y",)), incremental.Job("y", "sweep", 1, ("x",))])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"prompt_id": "1", "prompt_text": "Q?", "gold_object": "G", "object_aliases": ["g", "H"]}\n\n{"fact_id": "2", "prompt_text": "R?", "gold_object": "K", "predicate_id": "P1"}\n')
    facts = prompts.parse_prompts(prompts.scan_jsonl(spark, str(tmp_path / "p.jsonl"))).where("prompt is not null").orderBy("key").collect()
    assert [(f.key, f.ground_truth, f.relation) for f in facts] == [("1", "G", None), ("2", "K", "P1")]
    (tmp_path / "m.jsonl").write_text('{"deletion_manifest": {"entry_ids": []}, "entry_ids": ["x"]}\n{"oracle_entry_ids": ["b ", "a", "a"], "source_ids": "s"}\n')
    m = {tuple(r.entry_ids): r for r in prompts.parse_manifests(prompts.scan_raw(spark, str(tmp_path / "m.jsonl"))).collect()}
    assert set(m) == {(), ("a", "b")} and m["a", "b"].source_ids == ["s"]
    import hashlib
    import json

    want = json.dumps({"entry_ids": ["a", "b"], "source_ids": ["s"], "strategy": "oracle-entry", "metadata": {}}, sort_keys=True)
    assert m["a", "b"].manifest_id == hashlib.sha256(want.encode()).hexdigest()[:16]
    log = tmp_path / "x.partial.jsonl"
    log.write_text('{"fact_id": "1", "state": "FULL"}\n{"fact_id": "2", "sta')
    assert [r.fact_id for r in files.scan_partial(spark, str(log)).collect()] == ["1"]
    log.write_text('{"fact_id": "1", "sta\n{"fact_id": "2", "state": "FULL"}\n')
    with pytest.raises(Exception, match="broken line"):
        files.scan_partial(spark, str(log)).collect()
    rows = spark.createDataFrame([("a", "FULL"), ("a", "DEL-ON")], "fact_id string, state string")
    files.write_results(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("state = 'FULL'").count() == 1
    assert "| a | FULL |" in files.markdown_table(rows)
    incremental.resume_guard(spark, str(tmp_path / "guard"), {"rho": 1})
    incremental.resume_guard(spark, str(tmp_path / "guard"), {"rho": 1})
    with pytest.raises(incremental.StaleArtifacts):
        incremental.resume_guard(spark, str(tmp_path / "guard"), {"rho": 2})


def test_followup_helpers(spark):
    rows = spark.createDataFrame([("1", "x"), ("1", "x"), ("2", "y")], "fact_id string, answer string")
    assert {(r.fact_id, r.side) for r in followups.label_coverage(rows, rows.dropDuplicates(), ["fact_id"]).collect()} == {("1", "missing")}
    a = spark.createDataFrame([("k", 0.5, 0.1)], "k string, s double, l double")
    assert [r.metric for r in followups.tolerance_violations(a, a.withColumn("s", F.lit(0.502)), ["k"], ["s", "l"]).collect()] == ["s"]
