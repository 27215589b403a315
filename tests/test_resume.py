"""Resumed runs and shared stores: what is refused, what is served, what is made once."""

import json

import pytest
from pyspark.sql import functions as F

from memaudit import cli
from memaudit.operators import adversary, audit, drivers, incremental, neighbors, search, vector_index
from memaudit.sources import files

from .test_drivers import ENTRIES, FACTS, outputs, plain_audit, study_rows

CONFIG = drivers.AuditConfig(predicates=("geometric",), radius=0.8)


@pytest.fixture(scope="module")
def data(spark):
    facts, entries = study_rows()
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(entries, ENTRIES)


def test_content_digest(spark):
    rows = [(i, f"v{i % 5}", [float(i)], {"a": i}) for i in range(50)] + [(None, None, None, None)]
    kind = "i int, v string, x array<double>, m map<string,int>"
    df = spark.createDataFrame(rows, kind)
    one = incremental.content_digest(df)
    assert one == incremental.content_digest(df.repartition(7).select("m", "x", "v", "i")) and one["rows"] == 51
    changed = [df.union(df.limit(1)), df.where("i <> 3 or i is null"), df.withColumn("v", F.when(F.col("i") == 3, "w").otherwise(F.col("v"))), df.withColumn("v", F.coalesce("v", F.lit(""))), df.withColumn("i", F.col("i").cast("long")), df.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))]
    assert all(incremental.content_digest(d) != one for d in changed)
    swapped = df.withColumn("v", F.when(F.col("i") == 1, "v2").when(F.col("i") == 2, "v1").otherwise(F.col("v")))
    two = incremental.content_digest(swapped)  # equal columns, other rows
    assert two["columns"] == one["columns"] and two["whole"] != one["whole"]


def test_commit_says_what_a_table_holds(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(5).write.parquet(at)
    assert not incremental.check_commit(spark.read.parquet(at), at)
    incremental.commit(spark.read.parquet(at), at)
    assert incremental.check_commit(spark.read.parquet(at), at)
    spark.range(1).write.mode("append").parquet(at)
    with pytest.raises(incremental.StaleArtifacts, match="committed"):
        incremental.check_commit(spark.read.parquet(at), at)
    incremental.drop_commit(spark, at)
    assert not incremental.check_commit(spark.read.parquet(at), at)


def test_resume_refuses_other_inputs_and_skips_once(spark, data, tmp_path):
    facts, entries = data
    at = str(tmp_path)
    drivers.run_backend_audit(facts.where("fact < 'f2'"), entries, at, CONFIG)
    with pytest.raises(incremental.StaleArtifacts, match="another configuration"):
        drivers.run_backend_audit(facts, entries.withColumn("value", F.concat("value", F.lit("!"))), at, CONFIG)
    with pytest.raises(incremental.StaleArtifacts, match="other inputs"):
        drivers.run_backend_audit(facts.withColumn("ground_truth", F.when(F.col("fact") == "f1", "Lima").otherwise(F.col("ground_truth"))), entries, at, CONFIG)
    with pytest.raises(incremental.StaleArtifacts):
        drivers.run_backend_audit(facts, entries, at, CONFIG, drivers.Hooks(identity="another judge"))
    for _ in range(2):
        summary = drivers.run_backend_audit(facts, entries, at, CONFIG)
    want, skipped, _ = plain_audit(0.7, 0.8, ("geometric",))
    assert outputs(spark, at) == want and summary["generated"] == 0
    rows = spark.read.parquet(f"{at}/skipped").collect()
    assert sorted((r.fact_id, r.reason) for r in rows) == sorted(skipped.items())
    spark.read.parquet(f"{at}/results").where("state = 'FULL'").limit(1).withColumn("fact_id", F.lit("forged")).write.mode("append").partitionBy("state").parquet(f"{at}/results")
    with pytest.raises(incremental.StaleArtifacts, match="committed"):
        drivers.run_backend_audit(facts, entries, at, CONFIG)


def test_forbid_token_is_an_own_output_or_refused(spark, data, tmp_path):
    facts, entries = data
    mode = drivers.AuditConfig(del_off_mode="forbid-token")
    with pytest.raises(ValueError, match="forbidden"):
        drivers.run_backend_audit(facts, entries, str(tmp_path / "a"), mode)
    half = facts.withColumn("forbidden", F.when(F.col("fact") != "f3", "x"))
    with pytest.raises(ValueError, match="forbidden"):
        drivers.run_backend_audit(half, entries, str(tmp_path / "b"), mode)
    summary = drivers.run_backend_audit(facts.withColumn("forbidden", F.concat(F.lit("I say "), F.col("ground_truth"))), entries, str(tmp_path / "c"), mode)
    got = outputs(spark, tmp_path / "c")
    assert got and all(states["DEL-OFF"].startswith("I say ") for states in got.values()) and summary["parametric_leakage"] == 1.0
    assert {f: s["DEL-ON"] for f, s in got.items()} == {f: s["DEL-ON"] for f, s in plain_audit()[0].items()}
    with pytest.raises(ValueError, match="del_off_mode"):
        drivers.run_backend_audit(facts, entries, str(tmp_path / "d"), drivers.AuditConfig(del_off_mode="other"))


def test_timing_is_computed_or_unknown(spark, data, tmp_path):
    facts, entries = data
    said = {"f1": "<FACT> land, capital, Rome </FACT> Rome", "f2": "Oslo, as <FACT> x </FACT> Oslo", "f3": "Bern", "f4": "<FACT> a </FACT><FACT> b </FACT> Paris"}
    full = F.element_at(F.create_map(*[x for kv in said.items() for x in map(F.lit, kv)]), F.col("fact"))
    drivers.run_backend_audit(facts.withColumn("full_output", full), entries, str(tmp_path), drivers.AuditConfig())
    reasons = {r.fact_id: r.reason for r in spark.read.parquet(f"{tmp_path}/skipped").collect()}
    want = plain_audit()[1]
    assert "f1" not in reasons and reasons["f2"] == "answer-before-retrieval" and reasons["f3"] == reasons["f4"] == "unknown-alignment"
    assert {f: r for f, r in reasons.items() if f not in said} == {f: r for f, r in want.items() if f not in said}


def test_bootstrap_manifests(spark, data, tmp_path):
    drivers.run_backend_audit(*data, str(tmp_path), drivers.AuditConfig())
    row = spark.read.parquet(f"{tmp_path}/results").where("fact_id = 'f1' and state = 'FULL'").first()
    assert row.manifest_strategy == "oracle-from-full" and json.loads(row.manifest_metadata) == {"audited_event_index": 0, "bootstrap": "FULL.selected_candidate", "selection_policy": "pre-answer-normalized-answer-mention"}
    import hashlib

    whole = {"entry_ids": row.manifest_entry_ids, "source_ids": [], "strategy": row.manifest_strategy, "metadata": json.loads(row.manifest_metadata)}
    assert row.manifest_id == hashlib.sha256(json.dumps(whole, sort_keys=True).encode()).hexdigest()[:16]


def test_phases_share_one_store(spark, data, tmp_path):
    facts, entries = data
    store = drivers.Store(str(tmp_path / "store"), canary_rate=1.0)
    radii = drivers.AuditConfig(radii=(0.9, 0.8), neighbors=neighbors.NeighborConfig(ball=0.8, cap=3, min_count=1))
    attack = drivers.AuditConfig(predicates=("geometric",), attack=adversary.AdversarialConfig(rho=0.8, epsilons=(0.01,), templates=("verbatim",), topology="single"))
    alone = drivers.run_entanglement_sweep(facts, entries, str(tmp_path / "alone"), radii)
    one = drivers.run_backend_audit(facts, entries, str(tmp_path / "audit"), CONFIG, store=store)
    assert one["generated"] == one["answer_mention_cohort_facts"] and one["served"] == 0
    two = drivers.run_entanglement_sweep(facts, entries, str(tmp_path / "sweep"), radii, store=store)
    assert two["served"] > 0 and two["canaries"] == two["served"] and two["served"] + two["generated"] == alone["generated"]
    assert two["curve"] == alone["curve"]
    again = drivers.run_entanglement_sweep(facts, entries, str(tmp_path / "sweep"), radii, store=store)
    assert again["generated"] == 0 and again["curve"] == alone["curve"]
    drivers.run_adversarial_eval(facts, entries, str(tmp_path / "attack"), attack, store=store)
    full = spark.read.parquet(f"{store.path}/full")
    assert full.count() == full.select("fact").distinct().count() == 24
    with pytest.raises(incremental.StaleArtifacts):
        drivers.run_backend_audit(facts, entries, str(tmp_path / "other"), drivers.AuditConfig(threshold=0.6), store=store)


def test_a_planted_mismatch_fails_the_run(spark, data, tmp_path):
    facts, entries = data
    store = drivers.Store(str(tmp_path / "store"), canary_rate=1.0)
    drivers.run_backend_audit(facts, entries, str(tmp_path / "one"), CONFIG, store=store)
    kept = [r.asDict() for r in spark.read.parquet(f"{store.path}/generations").collect()]
    kind = spark.read.parquet(f"{store.path}/generations").schema
    forged = [(*[r[c] for c in kind.names[: kind.names.index("output")]], "forged" if r["fact"] == kept[0]["fact"] else r["output"], *[r[c] for c in kind.names[kind.names.index("output") + 1 :]]) for r in kept]
    spark.createDataFrame(forged, kind).write.mode("overwrite").parquet(f"{store.path}/generations")
    with pytest.raises(files.CanaryMismatch):
        drivers.run_backend_audit(facts, entries, str(tmp_path / "two"), CONFIG, store=store)
    found = spark.read.json(f"{store.path}/generations.mismatches").collect()
    assert [(r.fact, r.output) for r in found] == [(kept[0]["fact"], "forged")]


def test_audit_through_an_index(spark, data, tmp_path):
    facts, entries = data
    index = vector_index.build(search.unit_rows(entries, "entry_id", "vector"))
    config = drivers.AuditConfig(predicates=("geometric", "provenance", "value"), radius=0.8)
    drivers.run_backend_audit(facts, entries, str(tmp_path / "a"), config, drivers.Hooks(index=index))
    assert outputs(spark, tmp_path / "a") == plain_audit(0.7, 0.8, config.predicates)[0]


def test_study_makes_full_once_and_reads_an_index(spark, data, tmp_path):
    facts, entries = data
    entries.write.parquet(str(tmp_path / "entries"))
    facts.select("fact", "vector").write.parquet(str(tmp_path / "vectors"))
    facts.select("fact", "parametric").write.parquet(str(tmp_path / "answers"))
    lines = [json.dumps({"prompt_id": r.fact, "prompt_text": r.prompt, "gold_object": r.ground_truth, "object_aliases": r.object_aliases, "subject": r.subject, "relation": r.relation}) for r in facts.collect()]
    (tmp_path / "prompts.jsonl").write_text("\n".join(lines))
    made = cli.main(["index", "--entries", str(tmp_path / "entries"), "--out", str(tmp_path / "index")], spark)
    assert made["entries"] == entries.count()
    args = ["--prompts", str(tmp_path / "prompts.jsonl"), "--vectors", str(tmp_path / "vectors"), "--answers", str(tmp_path / "answers"), "--entries", str(tmp_path / "entries"), "--index", str(tmp_path / "index"), "--radius", "0.8"]
    cli.main(["study", *args, "--policies", "geometric,value", "--out", str(tmp_path / "study")], spark)
    full = spark.read.parquet(f"{tmp_path}/study/store/full")
    assert full.count() == 24 == full.select("fact").distinct().count()
    keys = {r.fact: r.prompt for r in full.collect()}
    assert len(set(keys)) == 24 and audit.BACKENDS["echo"].looks_up_first
    assert spark.read.parquet(f"{tmp_path}/study/policy-geometric/results").count() > 30
