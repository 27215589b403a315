"""The follow-up suite and the report over finished audits: diagnostics, matched models, frequencies, oracle misses,
probe controls, and the numbers of a study, recomputed from result rows and checked against what the runs wrote."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memaudit.functions import stats
from memaudit.functions import text as T
from memaudit.sources import files

from . import audit, followups, metrics, probe
from .scratch import stored

#: Cohorts of the tables, and the counts at which an envelope is nearly full.
COHORTS, NEAR_CAP = ("answer_mention", "full_correct"), 450


@dataclass(frozen=True)
class Dataset:
    """One data set's inputs: result rows of the audit, of the value policy (for oracle misses), correctness of other
    models under FULL (fact_id, correct), and query vectors (sample_id, fact, vector)."""

    results: DataFrame
    value_results: DataFrame | None = None
    models: dict[str, DataFrame] = field(default_factory=dict)
    samples: DataFrame | None = None


def audit_facts(results: DataFrame) -> DataFrame:
    """One row a fact: its texts, canonical group, correctness in each state (null where absent), DEL-ON's selection and
    the closure's counts, from the manifest's metadata. The first row of a fact and state counts."""
    rows = metrics.scored(followups.first_wins(results, ["fact_id", "state"]))
    of = lambda c, s: F.max(F.when(F.col("state") == s, c))
    out = rows.groupBy("fact_id").agg(
        *[F.min_by(c, "state").alias(c) for c in ("prompt", "ground_truth", "object_aliases", "subject", "relation", "manifest_metadata")],
        *[of(F.col("correct"), s).alias(a) for s, a in zip(metrics.STATES, ("full_correct", "del_on_correct", "del_off_correct"))],
        of(F.col("retrieval_trace.selected_entry_id"), "DEL-ON").alias("selected_id"), of(F.col("retrieval_trace.selected_value"), "DEL-ON").alias("selected_value"),
    )
    count = lambda k: F.get_json_object("manifest_metadata", f"$.{k}").cast("long")
    out = out.withColumns({"answer_bearing_neighbors_top_k": count("entry_counts.value"), "geometric_neighbors": count("entry_counts.geometric"), "retrieval_envelope_top_k": count("envelope_top_k")})
    return out.drop("manifest_metadata").withColumn("canonical_group", T.proposition_group(F.col("fact_id"), F.col("subject"), F.col("relation"), F.col("ground_truth")))


def group_assignments(facts: DataFrame, config: probe.ProbeConfig) -> DataFrame:
    """(fact_id, canonical_group, group_size, legacy_fold, canonical_fold): folds by fact, and by canonical group."""
    truth = facts.select(F.col("fact_id").alias("fact"))
    legacy, _ = probe._folds(truth, config, None)
    grouped, _ = probe._folds(truth, config, facts.select(F.col("fact_id").alias("fact"), F.col("canonical_group").alias("group")))
    both = grouped.join(legacy.select("fact", F.col("fold").alias("legacy_fold")), "fact")
    return both.select(F.col("fact").alias("fact_id"), F.col("group").alias("canonical_group"), "group_size", "legacy_fold", F.col("fold").alias("canonical_fold"))


def oracle_miss_rows(facts: DataFrame) -> DataFrame:
    """Full-correct facts that survive deletion by a selected candidate, with the lexical signal and blank review columns."""
    known = facts.where("full_correct and del_on_correct and selected_value is not null")
    answers = T.alias_set(F.col("ground_truth"), F.col("object_aliases"))
    rows = known.withColumn("answers", answers).withColumn("value_norm", T.norm(F.col("selected_value"))).withColumn("answer_norms", T.norms(F.col("answers")))
    rows = rows.withColumn("lexical_similarity", followups.seq_ratio("value_norm", "answer_norms")).withColumn("signal", followups.variant_signal(F.col("selected_value"), F.col("answers"), F.col("lexical_similarity")))
    return rows.select("fact_id", "canonical_group", "subject", "relation", "prompt", "ground_truth", "object_aliases", "selected_id", "selected_value", "lexical_similarity", F.col("signal").alias("automatic_review_signal"), F.lit("").alias("review_label"), F.lit("").alias("review_notes"))


def run_followups(spark: SparkSession, datasets: dict[str, Dataset], path: str, config: probe.ProbeConfig = probe.ProbeConfig(), prompt_dim: int = 512) -> dict:
    """Ten tables, a report and a manifest under path. Review labels that an earlier run's table holds are kept."""
    tables: dict[str, list[DataFrame]] = {k: [] for k in ("probe_group_assignments", "matched_memorization_per_fact", "frequency_bins", "matched_model_summary", "oracle_miss_adjudication", "probe_controls_per_fact")}
    rows: dict[str, list[dict]] = {k: [] for k in ("probe_dataset_diagnostics", "frequency_associations", "oracle_miss_summary", "probe_controls_summary")}
    skips: list[str] = []
    for name, data in datasets.items():
        tag = lambda df: df.select(F.lit(name).alias("dataset"), *df.columns)  # noqa: E731, B023
        facts = stored(audit_facts(data.results), "facts")
        if not facts.where("full_correct is not null").isEmpty():
            folds = stored(group_assignments(facts, config), "fold-assignments")
        else:
            raise ValueError(f"{name} has no FULL rows")
        tables["probe_group_assignments"].append(tag(folds))
        study = facts.join(folds.select("fact_id", F.col("legacy_fold").alias("fold")), "fact_id").select("fold", F.col("canonical_group").alias("group"), T.norm(F.col("ground_truth")).alias("answer"), F.coalesce("relation", F.lit("")).alias("relation"))
        study = stored(study, "diagnosed")
        priors = followups.majority_priors(study).drop("facts").first().asDict()
        rows["probe_dataset_diagnostics"].append({"dataset": name} | followups.probe_diagnostics(study).first().asDict() | {"folds": config.folds} | priors)

        # Each model's correctness beside the audited one's own without retrieval, on the same facts.
        joined = followups.matched_models(facts, *data.models.items())
        joined = stored(joined.withColumn("frequency_bin", T.frequency_bin(F.col("answer_bearing_neighbors_top_k"))), "matched")
        models = ["del_off_correct", *[f"{m}_correct" for m in data.models]]
        tables["matched_memorization_per_fact"].append(tag(joined.select("fact_id", "canonical_group", "subject", "relation", "ground_truth", "full_correct", *models, "answer_bearing_neighbors_top_k", "retrieval_envelope_top_k", "geometric_neighbors", "frequency_bin")))
        known = joined.where("answer_bearing_neighbors_top_k is not null")
        tables["frequency_bins"].append(tag(followups.frequency_bin_summary(known, "answer_bearing_neighbors_top_k", models)))
        rows["frequency_associations"] += [{"dataset": name} | r for r in followups.frequency_association(known, "answer_bearing_neighbors_top_k", models)]
        tables["matched_model_summary"].append(tag(followups.matched_model_summary(joined, models)))

        if data.value_results is not None:
            survivors = audit_facts(data.value_results)
            found = stored(oracle_miss_rows(survivors), "oracle-misses")
            marked = survivors.join(found.select("fact_id", F.col("automatic_review_signal").alias("signal")), "fact_id", "left")
            rows["oracle_miss_summary"].append({"dataset": name} | followups.oracle_miss(marked).first().asDict())
            tables["oracle_miss_adjudication"].append(tag(found))

        labels = metrics.gold_labels(data.results).withColumnRenamed("fact_id", "fact")
        groups = facts.select(F.col("fact_id").alias("fact"), F.col("canonical_group").alias("group"))
        behavior = stored(metrics.behavioral_mean(data.results), "behavior")
        prompts = probe.hashed_prompt_vectors(facts, prompt_dim, "fact_id", "prompt").select(F.concat(F.lit("prompt-bow:"), "fact_id").alias("sample_id"), F.col("fact_id").alias("fact"), "vector")
        controls = [(f"hashed-prompt-{prompt_dim}", prompts, "canonical-proposition", groups)]
        if data.samples is not None:
            controls += [("query", data.samples, "legacy-fact-id", None), ("query", data.samples, "canonical-proposition", groups)]
        else:
            skips.append(f"{name}: query-embedding sidecar not found")
        for what, samples, split, by in controls:
            per_fact, summary = probe.control_probe(what, samples, labels, behavior, config, by, split)
            tables["probe_controls_per_fact"].append(tag(per_fact))
            rows["probe_controls_summary"].append({"dataset": name} | summary)

    old = f"{path}/oracle_miss_adjudication"
    for name, frames in tables.items():
        if name == "oracle_miss_adjudication" and frames and files.exists(spark, old):
            before = stored(files.scan_csv(spark, old), "earlier-labels")
            frames = [followups.preserve_labels(files.union_by_name(*frames), before, ["dataset", "fact_id"], ["review_label", "review_notes"])]
        files.write_union_csv(spark, f"{path}/{name}", *frames)
    for name, told in rows.items():
        files.write_rows(spark, told, f"{path}/{name}")
    report = followup_report(rows, tables)
    files.write_text(spark, f"{path}/report", report)
    warning = "answer_bearing_neighbors_top_k is query-local answer density, not a global proposition-frequency count"
    files.write_document(spark, f"{path}/analysis_manifest", {"datasets": list(datasets), "query_probe_skips": skips, "frequency_warning": warning})
    return {"datasets": len(datasets), "facts": sum(f.count() for f in tables["matched_memorization_per_fact"]), "oracle_candidates": sum(r["candidates"] for r in rows["oracle_miss_summary"]), "probe_controls": len(rows["probe_controls_summary"]), "query_probe_skips": skips}


def followup_report(rows: dict[str, list[dict]], tables: dict[str, list[DataFrame]]) -> str:
    """The suite's summaries as Markdown."""
    parts = ["# Follow-up analyses\n"]
    for title, told in (("Probe data sets", rows["probe_dataset_diagnostics"]), ("Frequency associations", rows["frequency_associations"]), ("Oracle misses", rows["oracle_miss_summary"]), ("Probe controls", rows["probe_controls_summary"])):
        names = list(dict.fromkeys(k for r in told for k in r))
        parts.append(f"## {title}\n\n" + (files.markdown(names, [[r.get(n) for n in names] for r in told]) if told else "None.\n"))
    if tables["matched_model_summary"]:
        parts.append("## Matched models\n\n" + files.markdown_table(files.union_by_name(*tables["matched_model_summary"])))
    return "\n".join(parts)


# The report's stages. Each recomputes its numbers from rows and returns them.


class ReportMismatch(RuntimeError):
    """A recomputed number differs from the one that a run wrote."""


def _check(name: str, found: float | None, written: float | None, tolerance: float = 5e-4) -> None:
    if written is not None and (found is None or abs(found - written) > tolerance):
        raise ReportMismatch(f"{name}: {found} recomputed, {written} written")


RATES = {"L": "o", "R": "n and not o", "I": "not n and o", "S": "n"}


def _rates(pivoted: DataFrame, where: str) -> dict:
    row = pivoted.where(where).agg(F.count("*").alias("n"), *[F.avg(F.expr(e).cast("double")).alias(k) for k, e in RATES.items()]).first()
    return row.asDict()


def _pivoted(results: DataFrame) -> DataFrame:
    rows = metrics.scored(followups.first_wins(results, ["fact_id", "state"]))
    return metrics.pivot_states(rows, ("fact_id",))


def stage_extract(results: DataFrame, written: dict, baselines: dict[str, DataFrame] | None = None, forbid_token: DataFrame | None = None) -> dict:
    """Rates over the cohort and its full-correct part, checked against the metrics that the run wrote, and other models'
    rates on exactly these facts. written: a row of cross-state metrics. baselines: fact_id, correct."""
    facts = stored(_pivoted(results), "pivoted")
    eligible, full = "n is not null and o is not null", "n is not null and o is not null and coalesce(f, false)"
    cohort, over_full = _rates(facts, eligible), _rates(facts, full)
    for key, name in (("L", "parametric_leakage"), ("R", "retrieval_mediated_correctness"), ("I", "retrieval_interference")):
        _check(key, cohort[key], written.get(name))
        _check(f"{key} given full", over_full[key] if over_full["n"] else 0.0, written.get(f"{name}_given_full"))
    _check("S given full", over_full["S"] if over_full["n"] else 0.0, written.get("post_deletion_survival_given_full"))
    out = {"cohort": cohort["n"], "full_correct": over_full["n"], "over_cohort": cohort, "over_full_correct": over_full, "artifact": written.get("retrieval_artifact_rate"), "baselines": {}, "L_forbid_token": _rates(_pivoted(forbid_token), "o is not null")["L"] if forbid_token is not None else None}
    for name, df in (baselines or {}).items():
        both = facts.join(df.select("fact_id", F.col("correct").alias("b")), "fact_id")
        rate = lambda where: both.where(where).agg(F.avg(F.col("b").cast("double"))).first()[0]  # noqa: E731, B023
        out["baselines"][name] = {"rate_all": df.agg(F.avg(F.col("correct").cast("double"))).first()[0], "rate_on_cohort": rate(eligible), "rate_on_full_correct": rate(full), "n_common_cohort": both.where(eligible).count()}
    return out


def stage_policies(runs: dict[str, DataFrame]) -> dict:
    """S, R, I and L over full-correct facts for each policy's result rows."""
    out = {}
    for policy, results in runs.items():
        r = _rates(_pivoted(results), "n is not null and o is not null and coalesce(f, false)")
        out[policy] = {"n_full_correct": r["n"]} | {f"{k}_full": r[k] for k in "SRIL"}
    return out


def stage_probe_controls(results: DataFrame, samples: dict[str, DataFrame], config: probe.ProbeConfig = probe.ProbeConfig()) -> dict:
    """The probe's score on each representation, folds by fact: (sample_id, fact, vector) by name."""
    labels = stored(metrics.gold_labels(results).withColumnRenamed("fact_id", "fact"), "probe-labels")
    behavior = metrics.behavioral_mean(results)
    return {name: probe.control_probe(name, s, labels, behavior, config)[1] for name, s in samples.items()}


def stage_probe_grouped(results: DataFrame, samples: DataFrame, config: probe.ProbeConfig = probe.ProbeConfig()) -> dict:
    """The same representation with folds by fact and by canonical proposition: what repeated facts add to the score."""
    facts = audit_facts(results)
    labels = stored(metrics.gold_labels(results).withColumnRenamed("fact_id", "fact"), "probe-labels")
    groups = facts.select(F.col("fact_id").alias("fact"), F.col("canonical_group").alias("group"))
    behavior = metrics.behavioral_mean(results)
    return {split: probe.control_probe("query", samples, labels, behavior, config, by, split)[1] for split, by in (("fact", None), ("proposition", groups))}


class UncoveredLabels(RuntimeError):
    """Adjudicated labels and survivors don't agree."""


def stage_paraphrase(value_results: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(survivors of the value policy that only retrieval explains, with what was selected; counts and the adjudicated
    split). labels: fact_id, label, borderline: they must cover exactly these survivors."""
    facts = audit_facts(value_results)
    eligible = facts.where("del_on_correct is not null and del_off_correct is not null and coalesce(full_correct, false)")
    survivors = eligible.where("del_on_correct")
    mediated = stored(survivors.where("not del_off_correct").select("fact_id", F.col("ground_truth").alias("gold"), "object_aliases", "prompt", "selected_id", "selected_value"), "survivors")
    out = {"full_correct": eligible.count(), "survivors": survivors.count(), "retrieval_mediated": mediated.count()}
    if labels is not None:
        apart = followups.label_coverage(mediated, labels, ["fact_id"]).limit(5).collect()
        if apart:
            raise UncoveredLabels(f"labels and survivors differ: {[tuple(r) for r in apart]}")
        out["split"] = {r["label"]: {"n": r["n"], "borderline": r["borderline"]} for r in followups.survivor_split(labels).collect()}
    return mediated, out


def stage_frequency(facts: DataFrame, models: dict[str, DataFrame]) -> dict:
    """Answer density (answer-bearing entries of a fact's envelope) against each model's unaided correctness on the same
    facts: quartile edges, the share near the envelope's cap, rank correlation and rate per quartile.

    facts: fact_id, answer_bearing_neighbors_top_k (null where the closure is missing), del_off_correct.
    """
    known = facts.where("answer_bearing_neighbors_top_k is not null")
    joined = followups.matched_models(known, *models.items())
    names = {"audited": "del_off_correct"} | {m: f"{m}_correct" for m in models}
    joined = joined.withColumns({c: F.coalesce(F.col(c), F.lit(False)).cast("double") for c in names.values()})
    joined = stored(joined, "density")
    edges = stats.quartile_edges(joined, "answer_bearing_neighbors_top_k")
    bins = {r["bin"]: r for r in stats.quartile_bins(joined, "answer_bearing_neighbors_top_k", list(names.values()), NEAR_CAP).collect()}
    n = joined.count()
    near = joined.where(F.col("answer_bearing_neighbors_top_k") >= NEAR_CAP).count()
    out = {"facts": n, "missing_closure": facts.count() - n, "quartile_edges": edges, "near_cap_share": near / n if n else None}
    for name, column in names.items():
        rho = stats.spearman(joined, "answer_bearing_neighbors_top_k", column).first()
        out[name] = {"spearman": rho["spearman"] if rho else None, "L_by_quartile": [bins[i][f"mean_{column}"] if i in bins else None for i in range(4)]}
    return out


def stage_figures(curves: dict[str, list[tuple[float, float]]], title: str, x: str, y: str) -> str:
    """A line chart of a few summary curves as an SVG text; points are (x, y)."""
    colours = ("#1f77b4", "#d95f02", "#2ca02c", "#7570b3", "#8c8c8c", "#e7298a")
    points = [p for c in curves.values() for p in c]
    if not points:
        raise ValueError("a chart needs a point")
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*points))
    at = lambda p: (60 + 520 * (p[0] - x0) / ((x1 - x0) or 1), 340 - 280 * (p[1] - y0) / ((y1 - y0) or 1))
    safe = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;")
    out = ['<svg xmlns="http://www.w3.org/2000/svg" width="720" height="400" font-family="sans-serif" font-size="12">', f'<text x="60" y="30" font-size="15">{safe(title)}</text>', '<path d="M60 60V340H580" fill="none" stroke="#444"/>']
    out += [f'<text x="60" y="358">{x0:.3g}</text><text x="560" y="358">{x1:.3g}</text><text x="290" y="385">{safe(x)}</text>', f'<text x="20" y="340">{y0:.3g}</text><text x="20" y="64">{y1:.3g}</text><text x="8" y="50">{safe(y)}</text>']
    for i, (name, curve) in enumerate(curves.items()):
        c = colours[i % len(colours)]
        line = " ".join(f"{a:.1f},{b:.1f}" for a, b in map(at, sorted(curve)))
        out.append(f'<polyline points="{line}" fill="none" stroke="{c}" stroke-width="2"/><text x="592" y="{70 + 18 * i}" fill="{c}">{safe(name)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


def policy_results(runs: dict[str, str], spark: SparkSession) -> dict[str, DataFrame]:
    """Result rows of the audits under each policy's path."""
    return {policy: spark.read.parquet(f"{runs[policy]}/results") for policy in audit.POLICIES if policy in runs}
