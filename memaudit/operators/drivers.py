"""Whole audits: from facts and entries to written results, metrics and curves, with resume and a shared FULL pass.

A run is one plan per step; what several steps read is written in the scratch folder, and what a run makes is written
under its own path beside the configuration and the digests of the inputs that made it. A second run over the same path
goes on where the first stopped: with more facts, but not with another configuration, other entries, or facts that were
changed. With a `store`, runs of all kinds share their FULL pass and their generations: a study makes each once.

facts: fact, prompt, ground_truth, object_aliases, parametric (what the model says without retrieval), vector, and where
known subject, relation, full_output (FULL's output, with its <FACT> blocks), forbidden (what the model says when it can't
start a retrieval) and answer_visible_before_event. entries: entry_id, vector, value, source_id.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memaudit.functions import stats
from memaudit.functions import text as T
from memaudit.sources import files
from memaudit.sources.prompts import manifest_id

from . import adversary, audit, closure, incremental, metrics, neighbors, search, sweep, vector_index
from .scratch import stored


@dataclass(frozen=True)
class AuditConfig:
    """What a run depends on; equal configurations give equal results."""

    backend: str = "echo"
    threshold: float = 0.7
    predicates: tuple[str, ...] = ()
    radius: float = 0.85
    envelope_top_k: int = 500
    max_closure_size: int = 10_000
    del_off_mode: str = "null-retrieval"
    neighbors: neighbors.NeighborConfig = neighbors.NeighborConfig()
    radii: tuple[float, ...] = ()
    attack: adversary.AdversarialConfig = adversary.AdversarialConfig()

    @property
    def closure(self) -> closure.ClosureConfig | None:
        if not self.predicates:
            return None
        return closure.ClosureConfig(predicates=self.predicates, radius=self.radius, envelope_top_k=self.envelope_top_k, max_closure_size=self.max_closure_size)

    @property
    def envelope(self) -> int:
        """Entries that value and provenance look at, near or far."""
        return self.envelope_top_k if self.predicates and set(self.closure.active) - {"geometric"} else 0

    @property
    def policy(self) -> str:
        return "+".join(self.closure.active) if self.predicates else "oracle"


@dataclass(frozen=True)
class Hooks:
    """What a caller may replace: the judge of support, what is taken as the answer of an output, the manifest builder
    (cohort, scored pairs, configuration to rows of fact, entry_ids, source_ids, strategy, metadata, manifest_id), and an
    index of the entries' vectors (ids as text), which is searched instead of all entries with the same results. identity
    names the judge and the extraction where a run is resumed or a store is shared."""

    judge: search.Judge = T.judge_norms
    extract: Callable[[Column], Column] = lambda output: output
    manifests: Callable[[DataFrame, DataFrame, AuditConfig], DataFrame] | None = None
    index: vector_index.VectorIndex | None = None
    identity: str = ""


@dataclass(frozen=True)
class Store:
    """Where runs share what they generate: FULL rows and generations under path; canary_rate of the served generations are
    made anew and compared."""

    path: str
    canary_rate: float = 0.0


def keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumn("fact", F.col("fact").cast("string"))


def prepared(facts: DataFrame) -> DataFrame:
    """facts with gold_norms, and full_output where the model's FULL output isn't just what it retrieved."""
    out = keyed(facts).withColumn("gold_norms", T.norm_set(F.col("ground_truth"), F.col("object_aliases")))
    for name, kind in (("full_output", "string"), ("subject", "string"), ("relation", "string"), ("forbidden", "string"), ("answer_visible_before_event", "boolean")):
        if name not in facts.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.withColumn("input_digest", incremental.row_digest(*[F.col(c) for c in INPUTS]))


#: The columns of a fact that its results depend on.
INPUTS = ("prompt", "ground_truth", "object_aliases", "parametric", "vector", "full_output", "subject", "relation", "forbidden", "answer_visible_before_event")
#: The strategy and metadata of a manifest that FULL's selection gives.
BOOTSTRAP = {"audited_event_index": 0, "bootstrap": "FULL.selected_candidate", "selection_policy": "pre-answer-normalized-answer-mention"}
BOOTSTRAP_STRATEGY = "oracle-from-full"


def timing(spec: audit.BackendSpec) -> Column:
    """Whether the answer was visible before the selected event: as given; else false where the reader made the output and
    looks up first; else by the text before the output's <FACT> block, if it has just one; else unknown (null)."""
    pieces = F.split("full_output", r"(?s)<FACT>.*?</FACT>", -1)
    shown = F.when(F.size(pieces) == 2, T.contains_norms(T.norm(F.get(pieces, F.lit(0))), F.col("gold_norms")))
    return F.coalesce("answer_visible_before_event", F.when(F.col("full_output").isNull(), F.lit(False) if spec.looks_up_first else F.lit(None).cast("boolean")).otherwise(shown))


def guard(path: str, config: AuditConfig, entries: DataFrame, hooks: Hooks, **more) -> None:
    """Refuse to go on at path with another configuration, reader, judge or other entries."""
    told = asdict(config) | {"reader": audit.BACKENDS[config.backend].identity, "hooks": hooks.identity} | more
    incremental.resume_guard(entries.sparkSession, path, told, {"entries": entries.select("entry_id", "vector", "value", "source_id")})


def scored_pairs(facts: DataFrame, entries: DataFrame, floor: float, envelope: int = 0, index: vector_index.VectorIndex | None = None) -> DataFrame:
    """fact, entry_id, score, value, value_norm, source_id at or over the floor, and of each fact's best `envelope`
    entries whatever their scores; ids as text; written once."""
    units = search.unit_rows(facts, "fact", "vector")
    named = entries.select(F.col("entry_id").cast("string").alias("entry_id"), "vector", "value", F.col("source_id").cast("string").alias("source_id"))
    targets = search.unit_rows(named, "entry_id", "vector")
    found = search.score_pairs(units, targets, floor) if index is None else vector_index.score_pairs(units, index, floor)
    if envelope:
        near = search.nearest(units, targets, envelope) if index is None else vector_index.nearest(units, index, envelope)[0]
        found = found.unionByName(near.where(F.col("score") < floor).drop("rank"))
    return stored(found.join(named.drop("vector").withColumn("value_norm", T.norm(F.col("value"))), "entry_id"), "pairs")


def full_pass(facts: DataFrame, scored: DataFrame, config: AuditConfig, path: str, hooks: Hooks = Hooks()) -> DataFrame:
    """FULL's selection, output and correctness of every fact; facts that path holds already aren't generated again.

    Rows are appended; where two runs wrote a fact, the first row counts. A fact that is there with other inputs is an error.
    """
    spark = facts.sparkSession
    rows_at = f"{path}/full"
    have = files.exists(spark, rows_at)
    wanted = todo = prepared(facts)
    if have:
        kept = spark.read.parquet(rows_at)
        incremental.refuse_changed(todo, kept, "fact")
        todo = incremental.remaining(todo, kept, ["fact"])
    spec = audit.BACKENDS[config.backend]
    todo = todo.withColumn("answer_visible_before_event", timing(spec))
    none = F.lit(None).cast("string")
    tops = best(scored, config.threshold) if spec.retrieves else None
    rows = todo.drop("vector").join(tops, "fact", "left") if tops is not None else todo.drop("vector").withColumns({c: none for c in ("selected_id", "selected_value", "selected_source")} | {"selected_score": F.lit(None).cast("double")})
    output = hooks.extract(F.coalesce("full_output", spec.reader(F.col("selected_value"), F.col("parametric"))))
    rows = rows.withColumn("output", output).withColumn("mentions", hooks.judge(T.norm(F.col("selected_value")), F.col("gold_norms"))).withColumn("full_correct", T.contains_norms(T.norm(F.col("output")), F.col("gold_norms")))
    rows.withColumn("written", F.current_timestamp()).write.mode("append").parquet(rows_at)
    every = incremental.union_first_wins([spark.read.parquet(rows_at).withColumnRenamed("written", "row_index")], ["fact"]).drop("row_index")
    return every.join(wanted.select("fact"), "fact", "left_semi")  # a shared store may hold more


def best(pairs: DataFrame, threshold: float, by: tuple[str, ...] = ("fact",)) -> DataFrame:
    """The best entry at or over the threshold, ties to the smaller id; ids are texts."""
    top = F.min_by(F.struct("entry_id", "value", "source_id", "score"), F.struct(-F.col("score"), F.col("entry_id")))
    found = pairs.where(F.col("score") >= threshold).groupBy(*by).agg(top.alias("s"))
    return found.select(*by, F.col("s.entry_id").alias("selected_id"), F.col("s.value").alias("selected_value"), F.col("s.source_id").alias("selected_source"), F.col("s.score").alias("selected_score"))


def oracle_manifests(cohort: DataFrame, scored: DataFrame, config: AuditConfig) -> DataFrame:
    """FULL's selected entry alone."""
    ids, none = F.array("selected_id"), F.array().cast("array<string>")
    strategy, metadata = F.lit(BOOTSTRAP_STRATEGY), F.lit(json.dumps(BOOTSTRAP, sort_keys=True, separators=(",", ":")))
    return cohort.select("fact", ids.alias("entry_ids"), none.alias("source_ids"), strategy.alias("strategy"), metadata.alias("metadata"), manifest_id(ids, none, strategy, metadata).alias("manifest_id"))


def _seeds(cohort: DataFrame) -> DataFrame:
    return cohort.select("fact", F.col("selected_id").alias("entry_id"), F.col("selected_source").alias("source_id"))


def family(cohort: DataFrame, scored: DataFrame, radii: list[float], config: closure.ClosureConfig) -> DataFrame:
    """Closures of the cohort at all radii, each at most max_closure_size entries, with `truncated`."""
    known = scored.join(cohort.select("fact", F.col("gold_norms").alias("answer_norms")), "fact")
    return closure.truncated(closure.caught(known, _seeds(cohort), radii, config), config.max_closure_size)


def closure_manifests(cohort: DataFrame, scored: DataFrame, config: AuditConfig) -> DataFrame:
    """The closure of each fact at the configured radius."""
    made = family(cohort, scored, [config.radius], config.closure)
    return closure.manifests(made, _seeds(cohort), config.closure, cohort.select("fact", "ground_truth", "object_aliases")).drop("rho")


def del_on(who: DataFrame, scored: DataFrame, manifests: DataFrame, config: AuditConfig, hooks: Hooks = Hooks(), by: tuple[str, ...] = ("fact",)) -> DataFrame:
    """(by, selected_*, output) of `who` (by, fact, parametric) with the entries, the sources and, if the manifest's
    metadata names a value target, the values that its manifest (by, ..., answer_norms or null) excludes."""
    rows = who.select(*by, *[c for c in ("fact",) if c not in by]).join(scored, "fact")
    named = manifests.select(*by, F.explode("entry_ids").alias("entry_id"))
    sources = manifests.select(*by, F.explode("source_ids").alias("source_id"))
    rows = search.exclude_sources(search.exclude_entries(rows, named, by), sources, by)
    backstop = manifests.where("answer_norms is not null").select(*by, F.col("answer_norms").alias("target_norms"))
    rows = rows.join(backstop, list(by), "left").where(~F.coalesce(hooks.judge(F.col("value_norm"), F.col("target_norms")), F.lit(False)))
    tops = best(rows, config.threshold, by)
    reader = audit.BACKENDS[config.backend].reader
    out = who.join(tops, list(by), "left")
    return out.withColumn("output", hooks.extract(reader(F.col("selected_value"), F.col("parametric"))))


def generations(jobs: DataFrame, scored: DataFrame, config: AuditConfig, hooks: Hooks, store: Store | None) -> tuple[DataFrame, dict]:
    """(fact, fingerprint, selected_id, selected_value, output) of jobs (fact, parametric, entry_ids, source_ids, answer_norms)
    and how many were served and made. Equal exclusions of a fact are one generation, whatever phase asks for it."""
    jobs = jobs.select("fact", "parametric", "entry_ids", "source_ids", "answer_norms").withColumn("fingerprint", exclusions())

    def make(todo: DataFrame) -> DataFrame:
        # What only hides ids and sources is decided on lists; a value target, or a page that is hidden whole, by joins.
        by, plain = ("fact", "fingerprint"), todo.where("answer_norms is null")
        quick = stored(listed_del_on(plain, ranked, config, hooks, by), "listed")
        rest = todo.where("answer_norms is not null").unionByName(todo.join(quick.where("open").select(*by), list(by), "left_semi"))
        slow = del_on(rest.select(*by, "parametric"), scored, rest.select(*by, "entry_ids", "source_ids", "answer_norms"), config, hooks, by)
        return quick.where("not open").drop("open").unionByName(slow.select(*by, "selected_id", "selected_value", "output"))

    ranked = stored(sweep.ranking(scored, config.threshold).select("fact", "place", "entry_id", "source_id", "value"), "ranking")

    at = f"{store.path}/generations" if store else None
    return incremental.generated(jobs, ["fact"], make, at, store.canary_rate if store else 0.0)


def listed_del_on(jobs: DataFrame, ranked: DataFrame, config: AuditConfig, hooks: Hooks, by: tuple[str, ...]) -> DataFrame:
    """(by, selected_id, selected_value, output, open) of jobs that hide ids and sources only: del_on() by survivors()."""
    found = sweep.survivors(jobs.select(*by, "entry_ids", "source_ids"), sweep.pages(ranked), list(by))
    rows = jobs.select(*by, "parametric").join(found, list(by)).join(ranked.select("fact", "place", F.col("entry_id").alias("selected_id"), F.col("value").alias("selected_value")), ["fact", "place"], "left")
    reader = audit.BACKENDS[config.backend].reader
    return rows.select(*by, "selected_id", "selected_value", hooks.extract(reader(F.col("selected_value"), F.col("parametric"))).alias("output"), "open")


def exclusions() -> Column:
    """What a generation depends on besides its fact: the ids, sources and values that its manifest hides."""
    return incremental.fingerprint(F.array_sort("entry_ids"), F.array_sort("source_ids"), F.array_sort("answer_norms"))


def shared_store(facts: DataFrame, entries: DataFrame, path: str, config: AuditConfig, hooks: Hooks, store: Store | None) -> Store:
    """The store of a run, its own if none is shared; refused if it was made with another reader, threshold or entries."""
    store = store or Store(f"{path}/full_pass")
    told = {"backend": config.backend, "threshold": config.threshold, "reader": audit.BACKENDS[config.backend].identity, "hooks": hooks.identity}
    incremental.resume_guard(facts.sparkSession, store.path, told, {"entries": entries.select("entry_id", "vector", "value", "source_id")})
    return store


def _backstopped(manifests: DataFrame, cohort: DataFrame) -> DataFrame:
    told = F.get_json_object("metadata", "$.value_target").isNotNull()
    return manifests.join(cohort.select("fact", "gold_norms"), "fact").withColumn("answer_norms", F.when(told, F.col("gold_norms"))).drop("gold_norms")


class InvalidResults(RuntimeError):
    """Results that break an invariant of the three states."""


def run_backend_audit(facts: DataFrame, entries: DataFrame, path: str, config: AuditConfig = AuditConfig(), hooks: Hooks = Hooks(), store: Store | None = None) -> dict:
    """The standard audit: FULL, the gate, manifests, DEL-ON and DEL-OFF, all written under path. Returns the summary.

    results (by state), skipped, coverage, cross_state_metrics, per_state_metrics. Facts of which all states are there
    already are left as they are; a fact that was interrupted counts as not done. With forbid-token, DEL-OFF is what facts
    give as `forbidden`; a fact without it is an error.
    """
    if config.del_off_mode not in DEL_OFF:
        raise ValueError(f"del_off_mode must be among {tuple(DEL_OFF)}")
    if config.del_off_mode == "forbid-token" and ("forbidden" not in facts.columns or not facts.where("forbidden is null").isEmpty()):
        raise ValueError("forbid-token needs `forbidden`, what the model says when it can't start a retrieval, of every fact")
    facts = keyed(facts)
    spark = facts.sparkSession
    spec = audit.BACKENDS[config.backend]
    audit.validate_modes(bootstrap=spec.retrieves, closure=config.predicates, backend=config.backend)
    guard(path, replace(config, radii=()), entries, hooks)
    store = shared_store(facts, entries, path, config, hooks, store)
    scored = scored_pairs(facts, entries, min(config.threshold, config.radius), config.envelope, hooks.index) if spec.retrieves else None
    full = stored(full_pass(facts, scored, config, store.path, hooks), "full-pass")
    results_at = f"{path}/results"
    todo, counts = full, {"served": 0, "generated": 0, "canaries": 0}
    if files.exists(spark, results_at):
        kept = spark.read.schema(RESULTS).parquet(results_at)
        incremental.check_commit(kept, results_at)
        incremental.refuse_changed(full.withColumnRenamed("fact", "fact_id"), kept, "fact_id")
        todo = incremental.remaining(full, incremental.complete_groups(kept, "fact_id").withColumnRenamed("fact_id", "fact"), ["fact"])
    if spec.retrieves:
        gated = todo.withColumn("skip_reason", audit.skip_reason(F.col("mentions")))
        cohort = gated.where("skip_reason is null")
        builder = hooks.manifests or (closure_manifests if config.predicates else oracle_manifests)
        made = stored(builder(cohort, scored, config), "manifests")
        empty = made.where((F.size("entry_ids") == 0) & (F.size("source_ids") == 0) & F.get_json_object("metadata", "$.value_target").isNull()).select("fact", F.lit(True).alias("bare"))
        gated = stored(gated.join(empty, "fact", "left").withColumn("skip_reason", F.coalesce("skip_reason", F.when(F.col("bare"), "empty-manifest"))).drop("bare"), "gated")
        cohort = gated.where("skip_reason is null")
        hidden = stored(_backstopped(made, cohort).join(cohort.select("fact", "parametric"), "fact").withColumn("fingerprint", exclusions()), "hidden")
        outputs, counts = generations(hidden, scored, config, hooks, store)
        on = outputs.join(hidden.select("fact", "fingerprint"), ["fact", "fingerprint"]).select("fact", F.col("output").alias("on_output"), F.col("selected_id").alias("on_id"), F.col("selected_value").alias("on_value"))
        rows = cohort.join(made, "fact").join(on, "fact")
    else:
        gated = todo.withColumn("skip_reason", F.lit(None).cast("string"))
        none = F.array().cast("array<string>")
        rows = gated.withColumns({"entry_ids": none, "source_ids": none, "strategy": F.lit("none"), "metadata": F.lit("{}"), "manifest_id": manifest_id(none, none, F.lit("none")), "on_output": F.col("parametric"), "on_id": F.lit(None).cast("string"), "on_value": F.lit(None).cast("string")})
    wide = stored(result_rows(rows, hooks, config.del_off_mode), "results")
    faults = metrics.validate_states(wide).limit(5).collect()
    if faults:
        raise InvalidResults(f"results break an invariant: {[tuple(r) for r in faults]}")
    incremental.drop_commit(spark, results_at)
    wide.write.mode("append").partitionBy("state").parquet(results_at)
    left_out = gated.where("skip_reason is not null").select(F.col("fact").alias("fact_id"), F.col("skip_reason").alias("reason"), F.col("prompt").alias("prompt_text"), F.col("ground_truth").alias("gold"), F.coalesce("selected_value", F.lit("")).alias("selected_value"))
    if files.exists(spark, f"{path}/skipped"):  # a fact that was skipped before is skipped once
        left_out = incremental.remaining(left_out, spark.read.schema(left_out.schema).parquet(f"{path}/skipped"), ["fact_id"])
    stored(left_out, "skipped").write.mode("append").parquet(f"{path}/skipped")
    # With their schemas, as a run without any result leaves no file.
    every, skipped = (spark.read.schema(df.schema).parquet(f"{path}/{name}") for df, name in ((wide, "results"), (left_out, "skipped")))
    incremental.commit(every.select("fact_id", "state", "input_digest", "model_output"), results_at)
    return summarize(every, skipped, path, config, facts.count()) | counts


#: The column that is DEL-OFF's output in each way to turn retrieval off.
DEL_OFF = {"null-retrieval": "parametric", "forbid-token": "forbidden"}
#: What a resumed run reads of its results: what their commit covers.
RESULTS = "fact_id string, state string, input_digest string, model_output string"


def result_rows(rows: DataFrame, hooks: Hooks = Hooks(), del_off_mode: str = "null-retrieval") -> DataFrame:
    """Result rows of three states with their traces: what was selected is the one retained candidate."""
    def trace(entry: Column, value: Column) -> Column:
        one = search.serialize_candidate(entry, value, F.col("gold_norms"), judge=hooks.judge)
        return F.struct(F.lit(True).alias("trace_available"), F.lit(True).alias("trace_complete"), F.when(entry.isNotNull(), F.array(one)).alias("retained_candidates"), entry.alias("selected_entry_id"), value.alias("selected_value"))

    null = F.lit(None).cast("string")
    arms = [("FULL", F.col("output"), trace(F.col("selected_id"), F.col("selected_value"))), ("DEL-ON", F.col("on_output"), trace(F.col("on_id"), F.col("on_value"))), ("DEL-OFF", hooks.extract(F.col(DEL_OFF[del_off_mode])), trace(null, null))]
    arm = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), o.alias("model_output"), t.alias("retrieval_trace")) for s, o, t in arms]))
    flat = rows.select(
        F.col("fact").cast("string").alias("fact_id"), F.col("fact").cast("string").alias("prompt_id"), "prompt", "ground_truth", "object_aliases", "subject", F.lit(None).cast("array<string>").alias("subject_aliases"), "relation", F.lit(None).cast("array<string>").alias("relation_aliases"),
        "manifest_id", F.col("entry_ids").alias("manifest_entry_ids"), F.col("source_ids").alias("manifest_source_ids"), F.col("strategy").alias("manifest_strategy"), F.col("metadata").alias("manifest_metadata"), F.lit(0).cast("long").alias("row_index"), "input_digest", "gold_norms", arm.alias("arm"),
    )
    # A triple's relation is unknown to a bare candidate, so only the judge's flag is evidence.
    kept = F.transform("arm.retrieval_trace.retained_candidates", lambda c: F.struct(c["entry_id"].alias("entry_id"), c["value"].alias("value"), null.alias("subject"), null.alias("relation"), c["value"].alias("object"), c["supports_target"].alias("supports_target"), F.lit(None).cast("boolean").alias("supports_target_fact")))
    t = F.col("arm.retrieval_trace")
    whole = F.struct(t["trace_available"].alias("trace_available"), t["trace_complete"].alias("trace_complete"), kept.alias("retained_candidates"), t["selected_entry_id"].alias("selected_entry_id"), t["selected_value"].alias("selected_value"))
    return flat.select(*[c for c in flat.columns if c not in ("arm", "gold_norms")], F.col("arm.state").alias("state"), F.col("arm.model_output").alias("model_output"), whole.alias("retrieval_trace"))


def summarize(results: DataFrame, skipped: DataFrame, path: str, config: AuditConfig, source_facts: int) -> dict:
    """Coverage and metrics of all results and skips, written as CSV under path; the summary as a dict."""
    spark = results.sparkSession
    reasons = {r["reason"]: r["n"] for r in skipped.groupBy("reason").agg(F.count_distinct("fact_id").alias("n")).collect()}
    total = metrics.metrics_total(results).first().asDict()
    audited = results.where("state = 'DEL-OFF'").select("fact_id").distinct().count()
    told = {"backend": config.backend, "closure_policy": config.policy, "closure_radius": config.radius if config.predicates else None, "del_off_mode": config.del_off_mode}
    summary = told | {"source_facts": source_facts, "answer_mention_cohort_facts": audited, "coverage_skipped_facts": sum(reasons.values())} | total
    files.write_rows(spark, [summary], f"{path}/cross_state_metrics")
    states = [told | r.asDict() for r in metrics.metrics_by_state(results).where("state is not null").orderBy("state").collect()]
    files.write_rows(spark, states, f"{path}/per_state_metrics")
    files.write_rows(spark, [{"reason": k, "facts": v} for k, v in sorted((reasons | {"audited": audited}).items())], f"{path}/coverage")
    return summary | {"skipped": reasons}


def primary(facts: DataFrame, scored: DataFrame, config: AuditConfig, path: str, hooks: Hooks) -> tuple[DataFrame, DataFrame]:
    """(all facts with skip_reason, the primary cohort) from the shared FULL pass; both written."""
    full = full_pass(facts, scored, config, path, hooks)
    units = search.unit_rows(facts, "fact", "vector")
    gated = stored(audit.primary_gate(full.join(units, "fact", "left")), "primary")
    return gated, gated.where("skip_reason is null")


def run_entanglement_sweep(facts: DataFrame, entries: DataFrame, path: str, config: AuditConfig, hooks: Hooks = Hooks(), store: Store | None = None) -> dict:
    """The radius sweep: each target's geometric closures, its neighbours under its manifests, curves and gaps.

    Each subject is generated once per distinct manifest of a target, however many radii share it; a subject whose FULL
    candidates no manifest touches keeps its FULL output.
    """
    facts = keyed(facts)
    spark = facts.sparkSession
    radii = sorted(config.radii, reverse=True)
    audit.validate_modes(closure=("geometric",), sweep=True, backend=config.backend)
    guard(path, config, entries, hooks)
    store = shared_store(facts, entries, path, config, hooks, store)
    scored = scored_pairs(facts, entries, min(config.threshold, *radii), index=hooks.index)
    gated, who = primary(facts, scored, config, store.path, hooks)
    near = stored(neighbors.cosine_neighbors(who.select("fact", "vector"), config.neighbors) if config.neighbors.mode == "cosine" else neighbors.same_source_neighbors(who.select("fact", F.col("selected_source").alias("source_id")), config.neighbors.cap), "neighbors")
    shape = closure.ClosureConfig(predicates=("geometric",), radius=radii[0], envelope_top_k=config.envelope_top_k, max_closure_size=config.max_closure_size)
    made = closure.manifests(family(who, scored, radii, shape), _seeds(who), shape)
    # What a generation depends on are the ids and sources, not the radius: equal ones are one run.
    made = stored(made.withColumn("fingerprint", incremental.fingerprint(F.col("entry_ids"), F.col("source_ids"))), "sweep-manifests")
    jobs = sweep.sweep_jobs(who.select("fact"), near, radii)
    planned_jobs = stored(jobs.join(made.select(F.col("fact").alias("target"), "rho", "fingerprint"), ["target", "rho"]), "sweep-jobs")
    runs = planned_jobs.select("subject", "fingerprint").distinct().withColumn("job", F.xxhash64("subject", "fingerprint"))
    lists = made.groupBy("fingerprint").agg(F.first("entry_ids").alias("entry_ids"), F.first("source_ids").alias("source_ids"))
    told = who.select(F.col("fact").alias("subject"), "parametric", "gold_norms", F.col("output").alias("full_output"))
    work = runs.join(lists, "fingerprint").join(told, "subject")
    seen = scored.where(F.col("score") >= config.threshold).groupBy(F.col("fact").alias("subject")).agg(F.collect_set("entry_id").alias("seen_ids"), F.collect_set("source_id").alias("seen_sources"))
    touched = F.coalesce(F.arrays_overlap("seen_ids", "entry_ids"), F.lit(False)) | F.coalesce(F.arrays_overlap("seen_sources", "source_ids"), F.lit(False))
    work = stored(work.join(seen, "subject", "left").withColumn("touched", touched).drop("seen_ids", "seen_sources"), "sweep-work")
    fresh = stored(work.where("touched").withColumnRenamed("subject", "fact").withColumn("answer_norms", F.lit(None).cast("array<string>")).withColumn("made", exclusions()), "sweep-fresh")
    runs_made, counts = generations(fresh, scored, config, hooks, store)
    made_runs = fresh.select("job", "fact", F.col("made").alias("fingerprint")).join(runs_made, ["fact", "fingerprint"]).select("job", "output")
    outputs = work.join(made_runs, "job", "left").withColumn("output", F.when(F.col("touched"), F.col("output")).otherwise(F.col("full_output")))
    outputs = stored(outputs.select("subject", "fingerprint", T.contains_norms(T.norm(F.col("output")), F.col("gold_norms")).alias("correct"), "touched"), "sweep-outputs")
    rows = stored(planned_jobs.join(outputs, ["subject", "fingerprint"]), "sweep-rows")
    rows.write.mode("overwrite").partitionBy("rho").parquet(f"{path}/sweep")
    curve = stored(sweep.entanglement_curve(rows, near, who.where("full_correct").select("fact")), "curve")
    gaps = stored(sweep.entanglement_gap(curve), "gaps")
    files.write_neighbors(near, asdict(config.neighbors), f"{path}/neighbors")
    files.write_entanglement(curve, gaps, path)
    planned, executed = planned_jobs.count(), outputs.where("touched").count()
    reasons = {r["skip_reason"]: r["count"] for r in gated.where("skip_reason is not null").groupBy("skip_reason").count().collect()}
    summary = {"facts": gated.count(), "swept_facts": who.count(), "skipped_by_reason": reasons, "radii": radii, "planned": planned, "executed": executed, "reused_full_pass": outputs.where("not touched").count()}
    summary |= counts
    summary["reused_fingerprint"] = planned - executed - summary["reused_full_pass"]
    summary["curve"] = [r.asDict() for r in sweep.rollup(curve, gaps).orderBy(F.desc("rho")).collect()]
    files.write_document(spark, f"{path}/summary", summary)
    return summary


def run_adversarial_eval(facts: DataFrame, entries: DataFrame, path: str, config: AuditConfig, hooks: Hooks = Hooks(), store: Store | None = None) -> dict:
    """The re-injection evaluation at the attack's radius: baseline, DEL-OFF and one attack per epsilon and template."""
    facts = keyed(facts)
    spark = facts.sparkSession
    rho = config.attack.rho
    config = replace(config, predicates=config.predicates or ("geometric",), radius=rho)
    audit.validate_modes(closure=config.closure.active, adversarial=True, backend=config.backend)
    guard(path, config, entries, hooks)
    store = shared_store(facts, entries, path, config, hooks, store)
    scored = scored_pairs(facts, entries, min(config.threshold, rho), config.envelope, hooks.index)
    gated, who = primary(facts, scored, config, store.path, hooks)
    made = family(who, scored, [rho], config.closure)
    gone = stored(closure.manifests(made, _seeds(who), config.closure, who.select("fact", "ground_truth", "object_aliases")), "attack-manifests")
    lists = _backstopped(gone, who)
    left = search.exclude_entries(scored, lists.select("fact", F.explode("entry_ids").alias("entry_id")))
    left = search.exclude_sources(left.join(who.select("fact"), "fact", "left_semi"), lists.select("fact", F.explode("source_ids").alias("source_id")))
    answers = lists.where("answer_norms is not null").select("fact", "answer_norms")
    left = stored(search.exclude_values(left, answers), "attack-left")
    injected = stored(adversary.build_injections(who.select("fact", "vector", F.col("ground_truth").alias("answer")), config.attack), "injections")
    # Synthetic rows face the value backstop like any other, though not the filters of ids and sources.
    live = search.exclude_values(injected.withColumn("value_norm", T.norm(F.col("value"))), answers).drop("value_norm")
    attacks, before = adversary.attack(who.select("fact", "vector", "gold_norms", "parametric"), left, live, config.threshold, injected.select("fact", "epsilon", "template").distinct())
    attacks, before = stored(attacks, "attacks"), stored(before, "baseline")
    off = who.select("fact", T.contains_norms(T.norm(hooks.extract(F.col("parametric"))), F.col("gold_norms")).alias("correct"))
    shape = closure.geometry(scored.join(who.select("fact"), "fact", "left_semi"), made, _seeds(who), "provenance" in config.closure.active)
    evasion = stored(adversary.evasion_table(attacks, before, rho, config.attack.topology), "evasion")
    margins = stored(adversary.margin_table(shape, adversary.r_of_fact(before, off), rho), "margins")
    files.write_adversarial(evasion, margins, path)
    files.closure_documents(made, gone, shape, config.closure).write.mode("overwrite").parquet(f"{path}/closures")
    known = margins.where("margin is not null and r_f is not null").select((-F.col("margin")).alias("x"), "r_f")
    curve = stats.auroc(known, "x", "r_f").first()
    reasons = {r["skip_reason"]: r["count"] for r in gated.where("skip_reason is not null").groupBy("skip_reason").count().collect()}
    summary = {"facts": gated.count(), "attacked_facts": who.count(), "skipped_by_reason": reasons, "attacks": attacks.count(), "margin_auroc": curve["auroc"] if curve else None, "evasion": [r.asDict() for r in evasion.orderBy("epsilon", "template").collect()]}
    files.write_document(spark, f"{path}/summary", summary)
    return summary
