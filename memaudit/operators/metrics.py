"""Cross-state metrics: one pivot of results to facts, one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memaudit.functions import text as T

from .scratch import stored

STATES = ("FULL", "DEL-ON", "DEL-OFF")
KEY = ("fact_id", "prompt_id", "prompt", "ground_truth", "manifest_id")
ROW_SCORES = {"exact_match_rate": "exact_match", "contains_match_rate": "contains_match", "unknown_rate": "unknown", "precision_rate": "precision", "recall_rate": "recall", "f1_rate": "f1"}


def scored(results: DataFrame, aliases: str | None = "object_aliases") -> DataFrame:
    """results with a struct `scores` of each row's answer scores and the boolean `correct`."""
    more = F.col(aliases) if aliases else None
    out = results.withColumn("scores", T.score_prediction(F.col("model_output"), F.col("ground_truth"), more))
    return out.withColumn("correct", F.col("scores.contains_match") == 1.0)


def pivot_states(rows: DataFrame, key: tuple[str, ...] = KEY, order: str = "row_index", correct: str = "correct", more: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: f, n, o (correctness under FULL, DEL-ON, DEL-OFF, null where the state is absent) and the columns
    `more` of the DEL-ON row. Of several rows for a state the last by `order` wins. Nulls in the key are equal."""
    last = lambda c, s: F.max_by(F.when(F.col("state") == s, c), F.when(F.col("state") == s, F.col(order)))
    return rows.groupBy(*key).agg(*[last(F.col(correct), s).alias(a) for s, a in zip(STATES, "fno")], *[last(F.col(c), "DEL-ON").alias(c) for c in more])


_RATES = {
    "parametric_leakage": "o",
    "retrieval_mediated_correctness": "n and not o",
    "retrieval_interference": "not n and o",
}


def pair_aggregates(eligible: str = "n is not null and o is not null", full: str = "f") -> list[Column]:
    """Aggregates over pivoted facts; rates are 0.0 over an empty denominator."""
    ok, ok_full = F.expr(eligible), F.expr(f"({eligible}) and coalesce({full}, false)")

    def rate(what: str, where: Column) -> Column:
        return F.coalesce(F.avg(F.when(where, F.expr(what).cast("double"))), F.lit(0.0))

    out = [F.count_if(ok).alias("paired_count"), F.count_if(ok_full).alias("full_correct_paired_count")]
    for name, what in _RATES.items():
        out += [rate(what, ok).alias(name), rate(what, ok_full).alias(f"{name}_given_full")]
    return [*out, rate("n", ok_full).alias("post_deletion_survival_given_full")]


def gold_evidence(result: DataFrame) -> Column:
    """True if a retained candidate is flagged as support, or its subject, relation and object all are the fact's."""
    def same(c: Column) -> Column:
        triple = T.values_equivalent(c["subject"], F.col("subject"), None, F.col("subject_aliases")) & T.values_equivalent(c["relation"], F.col("relation"), None, F.col("relation_aliases")) & T.values_equivalent(c["object"], F.col("ground_truth"), None, F.col("object_aliases"))
        known = F.col("subject").isNotNull() & F.col("relation").isNotNull() & c["subject"].isNotNull() & c["relation"].isNotNull()
        flagged = F.coalesce(c["supports_target"], F.lit(False)) | F.coalesce(c["supports_target_fact"], F.lit(False))
        return flagged | (known & triple)

    return F.coalesce(F.exists(F.col("retrieval_trace.retained_candidates"), same), F.lit(False))


def trace_is_complete(trace: str = "retrieval_trace") -> Column:
    """Available and not known to be incomplete."""
    return F.coalesce(F.col(f"{trace}.trace_available"), F.lit(False)) & F.coalesce(F.col(f"{trace}.trace_complete"), F.lit(True))


def metrics_total(results: DataFrame, traces: bool = True) -> DataFrame:
    """All metrics in one row: row scores over all rows, cross-state rates over pivoted facts, artifacts over complete traces."""
    rows = stored(scored(results), "scored")
    means = rows.agg(F.count("*").alias("count"), *[F.coalesce(F.avg(f"scores.{s}"), F.lit(0.0)).alias(n) for n, s in ROW_SCORES.items()])
    if traces:
        rows = rows.withColumn("complete", trace_is_complete()).withColumn("evidence", gold_evidence(rows))
    facts = pivot_states(rows, more=("complete", "evidence") if traces else ())
    pairs = pair_aggregates()
    if traces:
        for suffix, where in (("", "true"), ("_given_full", "coalesce(f, false)")):
            ok = F.expr(f"n is not null and o is not null and coalesce(complete, false) and {where}")
            count = "retrieval_artifact_eligible_count" if not suffix else "retrieval_artifact_full_eligible_count"
            pairs += [F.count_if(ok).alias(count), F.coalesce(F.avg(F.when(ok, F.expr("n and not evidence").cast("double"))), F.lit(0.0)).alias(f"retrieval_artifact_rate{suffix}")]
    return means.crossJoin(facts.agg(*pairs))


def metrics_by_state(results: DataFrame) -> DataFrame:
    """Row scores per state and overall (state null); a single state has no pairs, so paired metrics there are 0."""
    rows = stored(scored(results), "scored")
    means = rows.rollup("state").agg(F.grouping("state").alias("__all"), F.count("*").alias("count"), *[F.coalesce(F.avg(f"scores.{s}"), F.lit(0.0)).alias(n) for n, s in ROW_SCORES.items()])
    facts = pivot_states(rows).agg(*pair_aggregates())
    names = facts.columns
    joined = means.crossJoin(facts)
    return joined.select("state", "count", *ROW_SCORES, *[F.when(F.col("__all") == 1, F.col(c)).otherwise(F.lit(0).cast(facts.schema[c].dataType)).alias(c) for c in names])


def behavioral_mean(results: DataFrame) -> DataFrame:
    """Mean correctness under DEL-OFF per fact."""
    return scored(results).where("state = 'DEL-OFF'").groupBy("fact_id").agg(F.avg(F.col("correct").cast("double")).alias("behavioral_l"))


def gold_labels(results: DataFrame) -> DataFrame:
    """(fact_id, ground_truth, aliases) of result rows; a fact with two unlike answers is an error."""
    rows = results.groupBy("fact_id").agg(F.min_by("ground_truth", "row_index").alias("ground_truth"), F.min_by("object_aliases", "row_index").alias("aliases"), F.count_distinct(T.norm(F.col("ground_truth"))).alias("n"))
    fine = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("unlike answers for fact "), F.col("fact_id").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(fine).drop("n")


def delta_rep(per_fact: DataFrame, behavior: DataFrame) -> DataFrame:
    """Mean representation score less mean behavioural leakage on facts that have both; nulls if there are none."""
    both = per_fact.where("l_rep is not null").join(behavior, "fact_id")
    return both.agg(F.count("*").alias("facts_common"), F.avg("l_rep").alias("l_rep_hat"), F.avg("behavioral_l").alias("l_hat"), (F.avg("l_rep") - F.avg("behavioral_l")).alias("delta_rep"))


def validate_states(results: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Violations, one row each (fact_id, problem); an empty result is a valid one.

    Each fact has each state once; question, answer and manifest agree across its states; under DEL-OFF nothing is
    retained or selected; under DEL-ON no retained candidate is in the manifest.
    """
    key = ["fact_id", "prompt_id"]
    same = results.groupBy(*key).agg(
        F.array_sort(F.collect_list("state")).alias("got"),
        F.count_distinct(F.struct("prompt", "ground_truth")).alias("texts"),
        F.count_distinct(F.coalesce("manifest_id", F.lit(""))).alias("manifests"),
    )
    wanted = F.array_sort(F.array(*map(F.lit, states)))
    checks = same.select("fact_id", F.explode(F.array(F.when(F.col("got") != wanted, F.lit("states")), F.when(F.col("texts") > 1, F.lit("identity")), F.when(F.col("manifests") > 1, F.lit("manifest")))).alias("problem"))
    found = [checks]
    if "retrieval_trace" in results.columns:
        kept = F.coalesce(F.col("retrieval_trace.retained_candidates"), F.array())
        found.append(results.where((F.col("state") == "DEL-OFF") & (F.size(kept) > 0)).select("fact_id", F.lit("del-off retrieves").alias("problem")))
        if "manifest_entry_ids" in results.columns:
            ids = F.transform(kept, lambda c: c["entry_id"])
            found.append(results.where((F.col("state") == "DEL-ON") & F.arrays_overlap(ids, F.col("manifest_entry_ids"))).select("fact_id", F.lit("del-on retains a deleted entry").alias("problem")))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.where(F.col("problem").isNotNull())
