"""The three-state audit as one lazy plan: gate, manifests, retrieval with exclusions, readers, results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memaudit.functions import text as T

from . import search
from .metrics import STATES, pair_aggregates

POLICIES = ("oracle", "geometric", "value", "provenance", "hybrid")

Reader = Callable[[Column, Column], Column]


def echo_reader(selected_value: Column, fallback: Column) -> Column:
    """Answers with the selected value, else with what the model says without one."""
    return F.coalesce(selected_value, fallback)


def parametric_reader(selected_value: Column, fallback: Column) -> Column:
    """Answers from its parameters in every state."""
    return fallback


@dataclass(frozen=True)
class BackendSpec:
    """A reader and what is known of it. looks_up_first: it retrieves before it says anything, so an output that it makes
    of a retrieved value can't show the answer before. identity: what else its outputs depend on, such as its version."""

    name: str
    reader: Reader
    retrieves: bool = True
    looks_up_first: bool = True
    identity: str = ""


#: Readers by name; register() adds to it.
BACKENDS: dict[str, BackendSpec] = {}


def register(spec: BackendSpec) -> BackendSpec:
    if spec.name in BACKENDS:
        raise ValueError(f"{spec.name} is registered already")
    BACKENDS[spec.name] = spec
    return spec


register(BackendSpec("echo", echo_reader))
register(BackendSpec("parametric", parametric_reader, False))


def validate_modes(*, bootstrap: bool = False, closure: tuple[str, ...] = (), sweep: bool = False, adversarial: bool = False, shards: int = 1, backend: str = "echo") -> None:
    """Which options go together; raises ValueError."""
    rules = [
        (closure and not (bootstrap or sweep or adversarial), "a closure needs the bootstrap from FULL"),
        (sweep and tuple(closure) != ("geometric",), "a sweep is geometric only"),
        (adversarial and "geometric" not in closure, "the adversarial evaluation needs the geometric predicate"),
        (sweep and adversarial, "sweep and adversarial exclude each other"),
        (sweep and shards > 1, "a sweep isn't split by prompts"),
        (not BACKENDS[backend].retrieves and (bootstrap or closure or sweep or adversarial), "a parametric backend retrieves nothing"),
    ]
    for bad, why in rules:
        if bad:
            raise ValueError(why)


def best(pairs: DataFrame, threshold: float, keep: Column | None = None, by: tuple[str, ...] = ("fact",)) -> DataFrame:
    """(by, selected_id, selected_value, selected_source, selected_score): the best entry at or over the threshold that
    `keep` allows; one pass with an aggregate, no sort. Ties to the smaller id."""
    ok = F.col("score") >= threshold
    rows = pairs.where(ok if keep is None else ok & keep)
    top = F.max_by(F.struct("entry_id", "value", "source_id", "score"), F.struct(F.col("score"), -F.col("entry_id")))
    return rows.groupBy(*by).agg(top.alias("s")).select(*by, F.col("s.entry_id").alias("selected_id"), F.col("s.value").alias("selected_value"), F.col("s.source_id").alias("selected_source"), F.col("s.score").alias("selected_score"))


#: Why a fact isn't audited, in the order in which the first that holds is given.
SKIPS = {
    "no-gold": "the fact has no answer",
    "no-retrieval": "FULL produced no selected entry ID",
    "no-answer-mention": "FULL selected entry did not pass the answer-mention heuristic",
    "answer-before-retrieval": "FULL answer was already visible before the answer-mention event",
    "unknown-alignment": "FULL answer-mention event has unknown temporal alignment",
    "full-wrong": "FULL answer was incorrect",
    "no-vector": "FULL produced no query embedding",
    "empty-manifest": "manifest builder produced an empty manifest",
}


def skip_reason(mentions: Column, *more: tuple[Column, str]) -> Column:
    """The common reasons; answer_visible_before_event is three-valued, and only a known false is in time."""
    seen = F.col("answer_visible_before_event")
    rules = [
        (F.size("gold_norms") == 0, "no-gold"), (F.col("selected_id").isNull(), "no-retrieval"), (~F.coalesce(mentions, F.lit(False)), "no-answer-mention"),
        (F.coalesce(seen, F.lit(False)), "answer-before-retrieval"), (seen.isNull(), "unknown-alignment"), *more,
    ]
    out = F.when(*[rules[0][0], rules[0][1]])
    for bad, why in rules[1:]:
        out = out.when(bad, why)
    return out


def gate(facts: DataFrame, full: DataFrame) -> DataFrame:
    """facts with FULL's selection and skip_reason: null for the cohort, else the first reason that holds.

    facts: fact, gold, gold_norms, answer_visible_before_event (of the selected event, from event_timing); a boolean
    `empty_manifest`, if there is one, is the last reason. Reasons are keys of SKIPS.
    """
    rows = facts.join(full, "fact", "left").withColumn("__v", T.norm(F.col("selected_value")))
    more = [(F.col("empty_manifest"), "empty-manifest")] if "empty_manifest" in facts.columns else []
    return rows.withColumn("skip_reason", skip_reason(T.judge_norms(F.col("__v"), F.col("gold_norms")), *more)).drop("__v")


def primary_gate(facts: DataFrame) -> DataFrame:
    """The gate of sweep and attack: also right under FULL and with a query vector. Adds skip_reason.

    facts: fact, gold_norms, selected_id, mentions, answer_visible_before_event, full_correct, vector.
    """
    wrong = (~F.coalesce(F.col("full_correct"), F.lit(False)), "full-wrong")
    return facts.withColumn("skip_reason", skip_reason(F.col("mentions"), wrong, (F.col("vector").isNull(), "no-vector")))


def coverage(gated: DataFrame) -> DataFrame:
    """Facts per skip reason, `audited` for the cohort."""
    return gated.groupBy(F.coalesce("skip_reason", F.lit("audited")).alias("reason")).agg(F.count("*").alias("facts"))


def excluded(policy: str, radius: float) -> Column:
    """Whether a policy hides an entry from a fact's retrieval; the seed is hidden under all."""
    seed = F.col("entry_id") == F.col("selected_id")
    parts = {
        "oracle": [],
        "geometric": [F.col("score") >= radius],
        "value": [F.col("mentions")],
        "provenance": [F.coalesce(F.col("source_id") == F.col("selected_source"), F.lit(False))],
    }
    parts["hybrid"] = [p for ps in list(parts.values()) for p in ps]
    out = seed
    for p in parts[policy]:
        out = out | p
    return out


def contenders(cohort: DataFrame, queries: DataFrame, entries: DataFrame, threshold: float, radius: float, policies: tuple[str, ...] = POLICIES) -> DataFrame:
    """Pairs among which every policy finds the best entry that it leaves: three_states' pairs, of the size of the cohort.

    queries: fact, vector. entries: entry_id, vector, source_id, value, value_norm. Policies with a radius look below it,
    the others at the best; a fact of whose page a policy hides everything is searched further down (search.paged).
    """
    who = cohort.select("fact", "gold_norms", "selected_id", "selected_source")
    judge = lambda p: p.withColumn("mentions", T.judge_norms(F.col("value_norm"), F.col("gold_norms")))
    asked, out = queries.join(who.select("fact"), "fact", "left_semi"), None
    for group, below in ((("oracle", "value", "provenance"), None), (("geometric", "hybrid"), radius)):
        own = [p for p in group if p in policies]
        if own:
            kept = [(~excluded(p, radius), 1) for p in own]
            rows = search.paged(asked, entries, None, judge, threshold, below, ("source_id", "value", "value_norm"), kept=kept, own=who).select("fact", "entry_id", "score", "source_id", "value", "value_norm")
            out = rows if out is None else out.unionByName(rows)
    return out


def three_states(cohort: DataFrame, pairs: DataFrame, threshold: float, radius: float, policies: tuple[str, ...] = POLICIES, reader: Reader = echo_reader, full_output: Column | None = None) -> DataFrame:
    """(policy, fact, gold_norms, f, n, o): correctness of each cohort fact in the three states under every policy.

    cohort: fact, gold_norms, parametric, selected_*. pairs: fact, entry_id, score, source_id, value, value_norm: only
    those at or over the threshold matter. All policies come from one aggregate over the pairs, one top entry each.
    """
    seen = pairs.where(F.col("score") >= threshold).join(cohort.select("fact", "gold_norms", "selected_id", "selected_source"), "fact")
    seen = seen.withColumn("mentions", T.judge_norms(F.col("value_norm"), F.col("gold_norms")))
    order = F.struct(F.col("score"), -F.col("entry_id"))
    tops = seen.groupBy("fact").agg(*[F.max_by(F.when(~excluded(p, radius), F.col("value")), F.when(~excluded(p, radius), order)).alias(p) for p in policies])
    rows = cohort.join(tops, "fact", "left")
    right = lambda answer: T.contains_norms(T.norm(answer), F.col("gold_norms"))
    full = full_output if full_output is not None else reader(F.col("selected_value"), F.col("parametric"))
    rows = rows.withColumn("f", right(full)).withColumn("o", right(F.col("parametric")))
    arms = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), reader(F.col(p), F.col("parametric")).alias("answer")) for p in policies]))
    return rows.select("fact", "f", "o", "gold_norms", arms.alias("arm")).select(F.col("arm.policy").alias("policy"), "fact", "f", right(F.col("arm.answer")).alias("n"), "o", F.col("arm.answer").alias("del_on_output"))


def del_off_sensitivity(runs: dict[str, DataFrame]) -> DataFrame:
    """(mode, n, l): leakage of each way to turn retrieval off; runs: mode to rows with model_output and gold_norms."""
    out = None
    for mode, rows in runs.items():
        one = rows.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"), F.avg(T.contains_norms(T.norm(F.col("model_output")), F.col("gold_norms")).cast("double")).alias("l"))
        out = one if out is None else out.unionByName(one)
    return out


def policy_matrix(states: DataFrame) -> DataFrame:
    """One row per policy: pairs, full-correct pairs and the rates L, R, I and S."""
    named = {"paired_count": "paired", "full_correct_paired_count": "full_correct", "parametric_leakage": "l", "retrieval_mediated_correctness": "r", "retrieval_interference": "i", "post_deletion_survival_given_full": "s_given_full"}
    out = states.groupBy("policy").agg(*pair_aggregates())
    return out.select("policy", *[(F.col(a) if a.endswith("count") else F.round(a, 6)).alias(b) for a, b in named.items()])


def results_rows(cohort: DataFrame, outputs: dict[str, Column], key: str = "fact") -> DataFrame:
    """Result rows, one per fact and state, of a frame with one column expression of output per state."""
    arms = F.array(*[F.struct(F.lit(s).alias("state"), outputs[s].alias("model_output")) for s in STATES])
    return cohort.withColumn("__arm", F.explode(arms)).select("*", "__arm.state", "__arm.model_output").drop("__arm")


def full_unaffected(full_candidates: DataFrame, manifests: DataFrame) -> DataFrame:
    """Facts of which no FULL candidate is hit by the manifest's ids, sources or value backstop: their FULL row can be copied.

    full_candidates: fact, entry_id, source_id, value_norm. manifests: fact, entry_ids, source_ids, answer_norms (or null).
    """
    hit = F.array_contains("entry_ids", F.col("entry_id")) | F.coalesce(F.array_contains("source_ids", F.col("source_id")), F.lit(False)) | F.coalesce(T.judge_norms(F.col("value_norm"), F.col("answer_norms")), F.lit(False))
    touched = full_candidates.join(manifests, "fact").where(hit).select("fact")
    return manifests.select("fact").distinct().join(touched, "fact", "left_anti")


def unaffected(facts: DataFrame, candidates: DataFrame, hit: Column) -> DataFrame:
    """full_unaffected() where hit, over a candidate's row, tells whether the manifest hits it: facts without a hit one."""
    return facts.select("fact").distinct().join(candidates.where(hit).select("fact").distinct(), "fact", "left_anti")


def dedupe_generations(jobs: DataFrame, generate: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("subject", "fingerprint")) -> DataFrame:
    """Run an expensive reader once per distinct key and join its outputs back to all jobs."""
    return jobs.join(generate(jobs.select(*keys).distinct()), list(keys))


def last_row_wins(rows: DataFrame, keys: list[str], order: str = "row_index") -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__r = 1").drop("__r")
