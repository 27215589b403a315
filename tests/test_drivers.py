"""Whole runs on a small study: audits, resume, sweep, attack, follow-ups, report stages, job plans and the command line."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memaudit import cli
from memaudit.operators import adversary, audit, drivers, incremental, jobs, metrics, neighbors, probe, search, suite
from memaudit.sources import files

CITIES = ["Paris", "Rome", "Oslo", "Bern"]


def study_rows(n=24, seed=3):
    """Facts in clusters of near vectors; every fact has an own entry, some have a twin that gives the answer otherwise."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 8))
    facts, entries = [], []
    for i in range(n):
        v = centres[i % 6] + 0.25 * r.normal(size=8)
        gold = CITIES[i % 4]
        facts.append((f"f{i}", f"Capital of land {i}?", gold, [f"{gold} city"], gold if i % 5 == 0 else "unknown", v.tolist(), f"land {i // 2}", "capital"))
        entries.append((f"e{i}", v.tolist(), gold if i % 7 else "nothing", f"s{i % 6}"))
        if i % 3 == 0:
            entries.append((f"t{i}", (v + 0.3 * r.normal(size=8)).tolist(), f"The capital is {gold}", f"s{(i + 1) % 6}"))
    return facts, entries


FACTS = "fact string, prompt string, ground_truth string, object_aliases array<string>, parametric string, vector array<double>, subject string, relation string"
ENTRIES = "entry_id string, vector array<double>, value string, source_id string"


@pytest.fixture(scope="module")
def data(spark):
    facts, entries = study_rows()
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(entries, ENTRIES)


def unit(v):
    return np.array(v) / np.linalg.norm(v)


def plain_audit(threshold=0.7, radius=None, predicates=()):
    """Outputs by fact and state, and skip reasons, from the fixture's rows in plain Python."""
    facts, entries = study_rows()
    out, skipped, closures = {}, {}, {}
    for fact, _, gold, _, said, v, *_ in facts:
        ranked = sorted(((-round(float(unit(v) @ unit(w)), 12), e, value, source) for e, w, value, source in entries))
        near = [x for x in ranked if -x[0] >= threshold]
        names = lambda value: gold.lower() in value.lower().split()  # noqa: E731, B023
        if not near:
            skipped[fact] = "no-retrieval"
        elif not names(near[0][2]):
            skipped[fact] = "no-answer-mention"
        else:
            seed = near[0]
            gone = {seed[1]}
            if "geometric" in predicates:
                gone |= {x[1] for x in ranked if -x[0] >= radius}
            if "value" in predicates:
                gone |= {x[1] for x in ranked if names(x[2])}
            if "provenance" in predicates:
                gone |= {x[1] for x in ranked if x[3] == seed[3]}
            closures[fact] = gone
            left = [x for x in near if x[1] not in gone]
            out[fact] = {"FULL": seed[2], "DEL-ON": left[0][2] if left else said, "DEL-OFF": said}
    return out, skipped, closures


def outputs(spark, path):
    got: dict = {}
    for x in spark.read.parquet(f"{path}/results").collect():
        assert x.state not in got.setdefault(x.fact_id, {})
        got[x.fact_id][x.state] = x.model_output
    return got


@pytest.mark.parametrize("predicates", [(), ("geometric",), ("geometric", "provenance", "value")])
def test_audit_matches_plain_python(spark, data, tmp_path, predicates):
    config = drivers.AuditConfig(predicates=predicates, radius=0.8)
    summary = drivers.run_backend_audit(*data, str(tmp_path), config)
    want, skipped, closures = plain_audit(0.7, 0.8, predicates)
    assert outputs(spark, tmp_path) == want and len(want) > 10
    assert {x.fact_id: x.reason for x in spark.read.parquet(f"{tmp_path}/skipped").collect()} == skipped and skipped
    assert summary["answer_mention_cohort_facts"] == len(want) and summary["coverage_skipped_facts"] == len(skipped) and summary["paired_count"] == len(want)
    rows = spark.read.parquet(f"{tmp_path}/results")
    assert {x.fact_id: set(x.manifest_entry_ids) for x in rows.where("state = 'FULL'").collect()} == closures
    written = files.scan_csv(spark, f"{tmp_path}/cross_state_metrics").first()
    assert float(written.parametric_leakage) == pytest.approx(summary["parametric_leakage"]) and written.closure_policy == config.policy
    assert files.scan_csv(spark, f"{tmp_path}/per_state_metrics").count() == 3


def test_audit_resumes_and_refuses_other_configurations(spark, data, tmp_path):
    facts, entries = data
    config = drivers.AuditConfig(predicates=("geometric",), radius=0.8)
    drivers.run_backend_audit(facts.where("fact < 'f2'"), entries, str(tmp_path), config)
    first = outputs(spark, tmp_path)
    # An interrupted fact has lost a state: it counts as not done, and is made anew.
    drivers.run_backend_audit(facts, entries, str(tmp_path), config)
    assert outputs(spark, tmp_path) == plain_audit(0.7, 0.8, ("geometric",))[0] and first.items() <= outputs(spark, tmp_path).items()
    again = drivers.run_backend_audit(facts, entries, str(tmp_path), config)
    assert again["paired_count"] == len(outputs(spark, tmp_path))
    assert spark.read.parquet(f"{tmp_path}/full_pass/full").count() == 24
    with pytest.raises(incremental.StaleArtifacts):
        drivers.run_backend_audit(facts, entries, str(tmp_path), drivers.AuditConfig(predicates=("value",)))


def test_audit_hooks_and_parametric_backend(spark, data, tmp_path):
    shout = drivers.Hooks(extract=F.upper, judge=lambda n, answers: F.coalesce(n != "", F.lit(False)))
    drivers.run_backend_audit(*data, str(tmp_path / "a"), drivers.AuditConfig(), shout)
    got = outputs(spark, tmp_path / "a")
    assert all(v == v.upper() for states in got.values() for v in states.values()) and len(got) == 24
    summary = drivers.run_backend_audit(*data, str(tmp_path / "b"), drivers.AuditConfig(backend="parametric"))
    assert summary["parametric_leakage"] == pytest.approx(5 / 24) and summary["retrieval_mediated_correctness"] == 0

    def nothing(cohort, scored, config):
        none = F.array().cast("array<string>")
        return cohort.select("fact", none.alias("entry_ids"), none.alias("source_ids"), F.lit("none").alias("strategy"), F.lit("{}").alias("metadata"), F.lit("x").alias("manifest_id"))

    none = drivers.run_backend_audit(*data, str(tmp_path / "c"), drivers.AuditConfig(), drivers.Hooks(manifests=nothing))
    reasons = {x.reason for x in spark.read.parquet(f"{tmp_path}/c/skipped").collect()}
    assert "empty-manifest" in reasons and none["answer_mention_cohort_facts"] == 0 and none["coverage_skipped_facts"] == 24


def test_sweep_matches_plain_python(spark, data, tmp_path):
    radii = (0.9, 0.8, 0.7)
    config = drivers.AuditConfig(radii=radii, neighbors=neighbors.NeighborConfig(ball=0.8, cap=3, min_count=1))
    summary = drivers.run_entanglement_sweep(*data, str(tmp_path), config)
    facts, entries = study_rows()
    want, _, _ = plain_audit()
    known = {f[0]: f for f in facts}
    holds = lambda fact, said: known[fact][2].lower() in said.lower().split()
    who = [f for f in want if holds(f, want[f]["FULL"])]
    cos = lambda v, w: round(float(unit(v) @ unit(w)), 12)
    curve = {}
    for t in who:
        ranked = sorted((-cos(known[t][5], known[o][5]), o) for o in who if o != t)[:3]
        near = [o for s, o in ranked if -s >= 0.8] or [ranked[0][1]]
        seed = min((-cos(known[t][5], w), e) for e, w, *_ in entries)[1]
        for rho in radii:
            gone = {e for e, w, *_ in entries if cos(known[t][5], w) >= rho} | {seed}

            def right(subject, gone=gone):
                left = sorted((-cos(known[subject][5], w), e, value) for e, w, value, _ in entries if e not in gone and cos(known[subject][5], w) >= 0.7)
                return holds(subject, left[0][2] if left else known[subject][4])

            curve[t, rho] = (float(not right(t)), round(sum(not right(o) for o in near) / len(near), 9), len(near))
    got = {(x.target_key, float(x.rho)): (float(x.efficacy), round(float(x.collateral), 9), int(x.neighbor_count)) for x in files.scan_csv(spark, f"{tmp_path}/entanglement_curves").collect()}
    assert got == curve and len(who) > 8
    assert summary["planned"] == sum((1 + n) for (_, _, n) in curve.values())
    assert summary["executed"] + summary["reused_full_pass"] + summary["reused_fingerprint"] == summary["planned"] and summary["executed"] < summary["planned"]
    assert spark.read.parquet(f"{tmp_path}/sweep").count() == summary["planned"]


def test_adversarial_evaluation(spark, data, tmp_path):
    attack = adversary.AdversarialConfig(rho=0.8, epsilons=(0.01, 0.05), templates=("verbatim", "hyphenated"), topology="single")
    summary = drivers.run_adversarial_eval(*data, str(tmp_path), drivers.AuditConfig(predicates=("geometric",), attack=attack))
    rows = {(r["epsilon"], r["template"]): r for r in summary["evasion"]}
    assert len(rows) == 4 and all(r["facts"] == summary["attacked_facts"] > 8 for r in rows.values())
    # A survivor at rho - epsilon beats everything that a geometric closure at rho left below it.
    near = rows[0.01, "verbatim"]
    assert near["correct_given_target_selected"] == 1.0 and near["selected_facts"] > near["facts"] / 2
    assert rows[0.01, "hyphenated"]["correct_given_target_selected"] == 0.0 and rows[0.05, "verbatim"]["selected_facts"] <= near["selected_facts"]
    assert files.scan_csv(spark, f"{tmp_path}/evasion").count() == 4 and files.scan_csv(spark, f"{tmp_path}/margins").count() == summary["attacked_facts"]
    # With the value predicate the backstop stops the verbatim survivor, not the hyphenated one.
    both = drivers.run_adversarial_eval(*data, str(tmp_path / "v"), drivers.AuditConfig(predicates=("geometric", "value"), attack=attack))
    found = {(r["epsilon"], r["template"]): r["selected_facts"] for r in both["evasion"]}
    assert found[0.01, "verbatim"] == 0 and found[0.01, "hyphenated"] > 0
    document = json.loads(spark.read.parquet(f"{tmp_path}/closures").first().document)
    assert document["predicates_active"] == ["geometric"] and document["entries"] and document["radius"] == 0.8


@pytest.fixture(scope="module")
def runs(spark, data, tmp_path_factory):
    path = tmp_path_factory.mktemp("runs")
    facts = data[0].withColumn("subject", F.concat(F.lit("land "), F.expr("cast(substring(fact, 2) as int) div 8"))).withColumn("ground_truth", F.element_at(F.array(*map(F.lit, CITIES)), (F.expr("cast(substring(fact, 2) as int)") % 4 + 1)))
    for name, predicates in (("base", ()), ("value", ("value",)), ("geometric", ("geometric",))):
        drivers.run_backend_audit(facts, data[1], f"{path}/{name}", drivers.AuditConfig(predicates=predicates, radius=0.8))
    return path


def test_followup_suite(spark, data, runs, tmp_path):
    read = lambda name: spark.read.parquet(f"{runs}/{name}/results")
    base = read("geometric")
    other = base.select("fact_id").distinct().withColumn("correct", F.crc32("fact_id") % 2 == 0)
    samples = data[0].select(F.col("fact").alias("sample_id"), "fact", "vector")
    sets = {"one": suite.Dataset(base, read("value"), {"small": other}, samples), "two": suite.Dataset(read("base"))}
    config = probe.ProbeConfig(folds=3, feature_dim=64)
    summary = suite.run_followups(spark, sets, str(tmp_path), config, 32)
    n = base.select("fact_id").distinct().count()
    assert summary["datasets"] == 2 and summary["facts"] == 2 * n and summary["probe_controls"] == 4 and len(summary["query_probe_skips"]) == 1
    table = lambda name: files.scan_csv(spark, f"{tmp_path}/{name}")
    diagnostics = {x.dataset: x for x in table("probe_dataset_diagnostics").collect()}
    assert int(diagnostics["one"].facts) == n and int(diagnostics["one"].canonical_groups) < n and int(diagnostics["one"].answers) == 4
    folds = table("probe_group_assignments").where("dataset = 'one'").groupBy("canonical_group").agg(F.count_distinct("canonical_fold").alias("k")).agg(F.max("k")).first()[0]
    assert folds == 1
    found = table("oracle_miss_adjudication").collect()
    assert len(found) == summary["oracle_candidates"]
    assert table("frequency_associations").count() == 2 * (2 + 1) and table("matched_model_summary").count() == 4
    assert "## Probe controls" in spark.read.text(f"{tmp_path}/report", wholetext=True).first()[0]
    if found:  # a reviewer's label outlives the next run
        marked = table("oracle_miss_adjudication").withColumn("review_label", F.lit("cue"))
        rows = [r.asDict() for r in marked.collect()]
        files.write_csv(spark.createDataFrame(rows, marked.schema), f"{tmp_path}/oracle_miss_adjudication")
        suite.run_followups(spark, sets, str(tmp_path), config, 32)
        assert {x.review_label for x in table("oracle_miss_adjudication").collect()} == {"cue"}


def test_report_stages(spark, data, runs):
    read = lambda name: spark.read.parquet(f"{runs}/{name}/results")
    base = read("base")
    written = {k: float(v) for k, v in files.scan_csv(spark, f"{runs}/base/cross_state_metrics").first().asDict().items() if v and v.replace(".", "").isdigit()}
    other = base.select("fact_id").distinct().withColumn("correct", F.lit(True)).limit(10)
    numbers = suite.stage_extract(base, written, {"small": other}, base)
    assert numbers["cohort"] == written["paired_count"] and numbers["baselines"]["small"] == {"rate_all": 1.0, "rate_on_cohort": 1.0, "rate_on_full_correct": 1.0, "n_common_cohort": 10}
    assert numbers["L_forbid_token"] == pytest.approx(written["parametric_leakage"])
    with pytest.raises(suite.ReportMismatch):
        suite.stage_extract(base, written | {"parametric_leakage": 0.9})
    policies = suite.stage_policies(suite.policy_results({"value": f"{runs}/value", "geometric": f"{runs}/geometric"}, spark))
    assert set(policies) == {"value", "geometric"} and policies["value"]["S_full"] <= 1
    survivors, counts = suite.stage_paraphrase(base)
    assert counts["retrieval_mediated"] == survivors.count() > 0
    labels = survivors.select("fact_id", F.lit("surface_variant").alias("label"), F.lit(1).alias("borderline"))
    assert suite.stage_paraphrase(base, labels)[1]["split"] == {"surface_variant": {"n": survivors.count(), "borderline": survivors.count()}}
    with pytest.raises(suite.UncoveredLabels):
        suite.stage_paraphrase(base, labels.where("fact_id <> 'f3'").unionByName(labels.limit(1)))
    facts = suite.audit_facts(read("value"))
    density = suite.stage_frequency(facts, {"small": other})
    assert density["facts"] == facts.count() and density["missing_closure"] == 0 and len(density["quartile_edges"]) == 3 and density["near_cap_share"] == 0
    samples = data[0].select(F.col("fact").alias("sample_id"), "fact", "vector")
    config = probe.ProbeConfig(folds=3, feature_dim=64)
    grouped = suite.stage_probe_grouped(base, samples, config)
    assert grouped["proposition"]["fold_groups"] < grouped["fact"]["fold_groups"]
    assert set(suite.stage_probe_controls(base, {"query": samples}, config)) == {"query"}
    chart = suite.stage_figures({"a & b": [(0.7, 0.1), (0.9, 0.4)]}, "E", "rho", "share")
    assert chart.startswith("<svg") and "a &amp; b" in chart


def test_probe_of_audit_outputs(spark, data, runs, tmp_path):
    results = spark.read.parquet(f"{runs}/base/results")
    samples = data[0].select(F.col("fact").alias("sample_id"), "fact", "vector")
    summary = probe.probe_audit_outputs(results, samples, str(tmp_path), probe.ProbeConfig(folds=3, feature_dim=64, fold_order="seeded"))
    assert summary["facts"] == summary["facts_common"] > 10 and summary["delta_rep"] == pytest.approx(summary["l_rep_hat"] - summary["l_hat"])
    assert files.scan_csv(spark, f"{tmp_path}/probe_per_fact").count() == summary["facts"]
    assert probe.probe_audit_outputs(results.where("fact_id in ('f1', 'f2')"), samples, str(tmp_path / "none")) is None
    twice = results.withColumn("ground_truth", F.when((F.col("state") == "FULL") & (F.col("fact_id") == "f1"), "other").otherwise(F.col("ground_truth")))
    with pytest.raises(Exception, match="unlike answers"):
        metrics.gold_labels(twice).collect()
    want = probe.shuffled_group_folds([f"g{i}" for i in range(7)], 3, 5)
    order = sorted(f"g{i}" for i in range(7))
    np.random.default_rng(5).shuffle(order)
    assert want == {g: i % 3 for i, g in enumerate(order)}


def test_job_plans_run_and_resume(spark, tmp_path):
    plan = [incremental.Job("a", "standard", 5), incremental.Job("b/x", "sweep", 5, ("a",)), incremental.Job("c", "policy", 9, ("b/x",)), incremental.Job("d", "parametric", 1)]
    ran, broken = [], {"b/x"}

    def work(job):
        if job.name in broken:
            raise RuntimeError("no luck")
        ran.append(job.name)
        return {"n": job.rows}

    quiet = lambda *words: None
    assert jobs.run_plan(spark, plan, work, str(tmp_path), quiet) == {"a": "ran", "b/x": "failed", "c": "blocked", "d": "ran"}
    assert jobs.status(spark, plan, str(tmp_path)) == {"a": "done", "b/x": "runnable", "c": "waiting", "d": "done"}
    broken.clear()
    assert jobs.run_plan(spark, plan, work, str(tmp_path), quiet) == {"a": "done", "b/x": "ran", "c": "ran", "d": "done"}
    assert sorted(ran) == ["a", "b/x", "c", "d"]
    with pytest.raises(incremental.StaleArtifacts):
        jobs.run_plan(spark, plan[:2], work, str(tmp_path), quiet)


def test_command_line(spark, data, tmp_path):
    facts, entries = data
    with open(tmp_path / "p.jsonl", "w") as f:
        for x in facts.collect():
            f.write(json.dumps({"prompt_id": x.fact, "prompt_text": x.prompt, "gold_object": x.ground_truth, "object_aliases": x.object_aliases, "subject": x.subject, "relation": x.relation}) + "\n")
    facts.select("fact", "vector").write.parquet(f"{tmp_path}/v")
    facts.select("fact", "parametric").write.parquet(f"{tmp_path}/said")
    entries.write.parquet(f"{tmp_path}/e")
    where = ["--prompts", f"{tmp_path}/p.jsonl", "--vectors", f"{tmp_path}/v", "--entries", f"{tmp_path}/e", "--answers", f"{tmp_path}/said"]
    summary = cli.main(["audit", *where, "--out", f"{tmp_path}/a", "--closure", "geometric", "--radius", "0.8", "--log", f"{tmp_path}/log"], spark)
    assert outputs(spark, tmp_path / "a") == plain_audit(0.7, 0.8, ("geometric",))[0] and summary["source_facts"] == 24
    assert json.loads((tmp_path / "log").read_text())["source_facts"] == 24
    states = cli.main(["study", *where, "--out", f"{tmp_path}/s", "--policies", "value", "--radius", "0.8"], spark)
    assert states == {"standard": "ran", "policy-value": "ran"}
    assert outputs(spark, tmp_path / "s/policy-value") == plain_audit(0.7, 0.8, ("value",))[0]
    assert cli.radii("0.9:0.8:0.05") == (0.9, 0.85, 0.8)
    swept = cli.main(["sweep", *where, "--out", f"{tmp_path}/w", "--radius-grid", "0.9,0.8", "--limit", "12"], spark)
    assert swept["facts"] == 12 and len(swept["curve"]) == 2
    told = cli.main(["followups", "--results", f"x={tmp_path}/a", "--folds", "3", "--out", f"{tmp_path}/f"], spark)
    assert told["datasets"] == 1
    with pytest.raises(SystemExit):
        cli.main(["audit", "--out", "x"], spark)


def test_blocks_of_queries_give_the_same_pairs(spark):
    r = random.Random(1)
    rows = [(i, (lambda v: (np.array(v) / np.linalg.norm(v)).tolist())([r.choice([-1.0, 0.5, 1.0]) for _ in range(4)])) for i in range(60)]
    q = spark.createDataFrame(rows, "fact long, vector array<double>")
    e = q.withColumnRenamed("fact", "entry_id").repartition(3)
    plain = {(a, b): round(float(np.dot(v, w)), 9) for a, v in rows for b, w in rows}
    for block in (1000, 13):
        got = {(x.fact, x.entry_id): round(x.score, 9) for x in search.score_pairs(q, e, 0.5, block=block).collect()}
        assert got == {k: s for k, s in plain.items() if s >= 0.5}
        top = {(x.fact, x["rank"]): x.entry_id for x in search.nearest(q, e, 3, block=block).collect()}
        assert top == {(a, k + 1): b for a, _ in rows for k, (_, b) in enumerate(sorted((-plain[a, b], b) for b, _ in rows)[:3])}


def test_budget_sinks_and_sidecars(spark, tmp_path):
    plan = spark.createDataFrame([(1, True)], "fact int, exceeded boolean")
    with pytest.raises(search.BudgetExceeded):
        search.require_budget(plan)
    assert search.require_budget(plan.where("not exceeded")).count() == 0
    rows = spark.createDataFrame([("a", "FULL", "event0", [1.0, 0.0])], "fact string, state string, event string, vector array<double>")
    files.write_npz(rows, str(tmp_path / "one_query_embeddings.npz"))
    assert files.read_npz(str(tmp_path / "one_query_embeddings.npz")).iloc[0].vector == [1.0, 0.0]
    assert files.discover_sidecar(spark, str(tmp_path), "one").endswith("one_query_embeddings.npz") and files.discover_sidecar(spark, str(tmp_path), "two") is None
    with pytest.raises(files.TooManyRows):
        files.markdown_table(spark.range(5), 4)
    files.write_union_csv(spark, str(tmp_path / "none"), spark.range(0))
    assert spark.read.text(str(tmp_path / "none")).count() <= 1
    files.write_union_csv(spark, str(tmp_path / "two"), spark.range(2), spark.range(1).withColumn("x", F.lit("a,b")))
    assert {(x.id, x.x) for x in files.scan_csv(spark, str(tmp_path / "two")).collect()} == {("0", None), ("1", None), ("0", "a,b")}
    with pytest.raises(files.CanaryMismatch):
        files.canary_report(spark.range(1), str(tmp_path / "canary"))
    assert spark.read.json(str(tmp_path / "canary")).count() == 1
    files.canary_report(spark.range(0), str(tmp_path / "fine"))
    (tmp_path / "x.bin").write_bytes(b"abc" * 500_000)
    import hashlib

    assert files.sha256_file(spark, str(tmp_path / "x.bin")) == hashlib.sha256(b"abc" * 500_000).hexdigest()
    (tmp_path / "b.partial.jsonl").write_text('{"fact_id": "1", "state": "late"}\n')
    (tmp_path / "a.partial.jsonl").write_text('{"fact_id": "1", "state": "early"}\n{"fact_id": "2", "state": "x"}\n{"fact_')
    both = files.scan_partials(spark, str(tmp_path / "*.partial.jsonl"), ["fact_id"])
    assert sorted((x.fact_id, x.state) for x in both.collect()) == [("1", "early"), ("2", "x")]


def test_gates_name_the_first_reason(spark):
    rows = [(1, ["x"], None, None, None), (2, ["x"], "e", False, False), (3, ["x"], "e", True, True), (4, ["x"], "e", True, None), (5, ["x"], "e", True, False), (6, [], "e", True, False)]
    df = spark.createDataFrame(rows, "fact int, gold_norms array<string>, selected_id string, mentions boolean, answer_visible_before_event boolean")
    got = {x.fact: x.skip_reason for x in df.select("fact", audit.skip_reason(F.col("mentions")).alias("skip_reason")).collect()}
    assert got == {1: "no-retrieval", 2: "no-answer-mention", 3: "answer-before-retrieval", 4: "unknown-alignment", 5: None, 6: "no-gold"} and set(got.values()) - {None} <= set(audit.SKIPS)
