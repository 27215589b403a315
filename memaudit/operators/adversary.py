"""Adversarial re-injection: synthetic survivors just outside a closure, and how often they bring a fact back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memaudit.functions import vectors
from memaudit.functions.text import contains_norms, judge_mentions, norm

TEMPLATES = ("verbatim", "hyphenated", "letter-spaced", "prefix-cue")
TOPOLOGIES = ("single", "aliased", "collided", "saturated")


@dataclass(frozen=True)
class AdversarialConfig:
    rho: float = 0.85
    epsilons: tuple[float, ...] = (0.01, 0.02, 0.05)
    templates: tuple[str, ...] = TEMPLATES
    topology: str = "single"
    count: int = 3
    seed: int = 0

    def __post_init__(self):
        if set(self.templates) - set(TEMPLATES) or self.topology not in TOPOLOGIES or self.count < 1:
            raise ValueError("unknown template or topology, or count below 1")


def _halves(token: Column) -> tuple[Column, Column]:
    cut = F.greatest(F.lit(1), F.floor(F.length(token) / 2)).cast("int")
    return F.substr(token, F.lit(1), cut), F.substr(token, cut + 1, F.length(token))


def survivor_value(answer: Column, template: Column) -> Column:
    """A text that conveys the answer; all templates but the first evade a judge of whole words. The sentences are fixed values."""
    words = F.filter(F.split(answer, r"\s+"), lambda w: w != "")
    hyphenated = F.array_join(F.transform(words, lambda w: F.concat_ws("-", *_halves(w))), " ")
    spaced = F.array_join(F.transform(words, lambda w: F.array_join(F.split(w, ""), " ")), "  ")
    head, tail = _halves(F.coalesce(F.get(words, F.lit(0)), answer))
    return (
        F.when(template == "verbatim", F.concat(F.lit("The answer is "), answer, F.lit(".")))
        .when(template == "hyphenated", F.concat(F.lit("The answer is "), hyphenated, F.lit(".")))
        .when(template == "letter-spaced", F.concat(F.lit("The answer is spelled "), spaced, F.lit(".")))
        .when(template == "prefix-cue", F.concat(F.lit("The answer starts with '"), head, F.lit("' and ends with '"), tail, F.lit("' ("), F.length(answer).cast("string"), F.lit(" characters in total).")))
        .otherwise(F.raise_error(F.lit("unknown survivor template")))
    )


def template_evades(answer: Column, template: Column, aliases: Column | None = None) -> Column:
    return ~judge_mentions(survivor_value(answer, template), answer, aliases)


def survivor_key(query: Column, direction: Column, cosine: Column) -> Column:
    """A unit vector of the given cosine to a unit query: cosine x query + sqrt(1 - cosine^2) x u, where u is the part of
    `direction` at right angles to the query, at length 1. Null if direction is along the query."""
    c = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))

    def made(u: Column) -> Column:
        across = vectors.let(vectors.dot(u, query), lambda along: vectors.add_scaled(u, query, -along))
        return vectors.let(vectors.normalized(across), lambda a: vectors.add_scaled(F.transform(query, lambda x: x * c), a, F.sqrt(1 - c * c)))

    return vectors.let(direction, made)


def seeded_direction(seed: Column, dim: Column) -> Column:
    """A direction of dim components in (-1, 1) that only depends on the seed text; the same on every run and executor."""
    unit = lambda i: (F.pmod(F.xxhash64(seed, i), F.lit(2_000_003)) - 1_000_001) / 1_000_001.0
    return F.transform(F.sequence(F.lit(1), dim), unit)


def build_injections(facts: DataFrame, config: AdversarialConfig = AdversarialConfig()) -> DataFrame:
    """(fact, epsilon, template, entry_id, vector, value, target_cosine, decoy): the entries injected for each attack.

    facts: fact, vector (unit), answer. single: one survivor at rho - epsilon. aliased: count of them. collided and
    saturated: one survivor and count decoys of other answers, at the survivor's cosine or at rho + epsilon.
    """
    copies = config.count if config.topology == "aliased" else 1
    decoys = config.count if config.topology in ("collided", "saturated") else 0
    slots = F.array(*[F.struct(F.lit(False).alias("decoy"), F.lit(i).alias("i")) for i in range(copies)], *[F.struct(F.lit(True).alias("decoy"), F.lit(i).alias("i")) for i in range(decoys)])
    rows = facts.withColumn("epsilon", F.explode(F.array(*[F.lit(float(e)) for e in config.epsilons])))
    rows = rows.withColumn("template", F.explode(F.array(*map(F.lit, config.templates)))).withColumn("slot", F.explode(slots))
    near = F.lit(config.rho) - F.col("epsilon")
    ring = near if config.topology != "saturated" else F.least(F.lit(1.0), F.lit(config.rho) + F.col("epsilon"))
    rows = rows.select("*", "slot.decoy", "slot.i").withColumn("target_cosine", F.when(F.col("decoy"), ring).otherwise(near))
    name = F.when(F.col("decoy"), F.concat(F.lit("adv-decoy-"), F.col("i"))).otherwise(F.concat(F.lit("adv-"), F.col("template"), F.lit("-"), F.col("i")))
    said = F.when(F.col("decoy"), F.concat(F.lit("The answer is decoy-"), F.col("i"), F.lit("."))).otherwise(survivor_value(F.col("answer"), F.col("template")))
    rows = rows.withColumn("entry_id", name).withColumn("value", said)
    seed = F.concat_ws("|", F.lit(str(config.seed)), F.col("fact").cast("string"), "template", "entry_id")
    rows = rows.withColumn("direction", seeded_direction(seed, F.size("vector")))
    return rows.select("fact", "epsilon", "template", "entry_id", survivor_key(F.col("vector"), F.col("direction"), F.col("target_cosine")).alias("vector"), "value", "target_cosine", "decoy")


def attack(queries: DataFrame, left: DataFrame, injected: DataFrame, threshold: float, arms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(attacks: fact, epsilon, template, selected, value, correct; baseline: fact, value, correct) of echo readers.

    queries: fact, vector (unit), gold_norms, parametric. left: fact, entry_id (text), score, value: what deletion left.
    injected: rows of build_injections. Injected vectors are scored against their query like any entry and face the
    threshold; the best of a query's rows wins, ties to stored entries, then survivors, then decoys, each by id.
    selected: a survivor that isn't a decoy won. arms (fact, epsilon, template) names the attacks where a backstop left
    some without any injected row.
    """
    best = lambda rows, *by: rows.groupBy(*by).agg(F.min_by(F.struct("entry_id", "value", "target", "score", "sort"), F.struct(-F.col("score"), F.col("sort"), F.col("entry_id"))).alias("top"))
    said = lambda rows: rows.withColumn("value", F.coalesce("top.value", "parametric")).withColumn("correct", contains_norms(norm(F.col("value")), F.col("gold_norms")))
    who = queries.select("fact", "gold_norms", "parametric")
    kept = left.where(F.col("score") >= threshold).select("fact", "entry_id", "score", "value", F.lit(False).alias("target"), F.lit(0).alias("sort"))
    baseline = said(who.join(best(kept, "fact"), "fact", "left")).select("fact", "value", "correct")
    live = injected.join(queries.select("fact", F.col("vector").alias("query")), "fact").withColumn("score", F.round(vectors.dot(F.col("vector"), F.col("query")), 12))
    live = live.where(F.col("score") >= threshold).select("fact", "epsilon", "template", "entry_id", "score", "value", (~F.col("decoy")).alias("target"), F.when(F.col("decoy"), 2).otherwise(1).alias("sort"))
    arms = injected.select("fact", "epsilon", "template").distinct() if arms is None else arms
    # What deletion left competes as one row: only its best can win.
    rest = best(kept, "fact").select("fact", "top.entry_id", "top.score", "top.value", "top.target", "top.sort")
    rows = live.unionByName(arms.join(rest, "fact"))
    tops = best(rows, "fact", "epsilon", "template")
    out = said(arms.join(who, "fact").join(tops, ["fact", "epsilon", "template"], "left"))
    return out.select("fact", "epsilon", "template", F.coalesce("top.target", F.lit(False)).alias("selected"), "value", "correct"), baseline


def r_of_fact(baseline: DataFrame, del_off: DataFrame) -> DataFrame:
    """(fact, r_f): right after deletion with retrieval and wrong without; only facts with both runs."""
    return baseline.select("fact", F.col("correct").alias("b")).join(del_off.select("fact", F.col("correct").alias("o")), "fact").select("fact", (F.col("b") & ~F.col("o")).alias("r_f"))


def evasion_table(attacks: DataFrame, baseline: DataFrame, rho: float, topology: str) -> DataFrame:
    """Per epsilon and template: facts, target selections and rates; a rate over nothing is null.

    attacks: fact, epsilon, template, correct, selected (a synthetic target entry won). baseline: fact, correct; a fact
    without one counts as wrong.
    """
    rows = attacks.join(baseline.select("fact", F.col("correct").alias("before")), "fact", "left").withColumn("before", F.coalesce("before", F.lit(False)))
    share = lambda c: F.avg(c.cast("double"))
    gain, loss, sel = F.col("correct") & ~F.col("before"), F.col("before") & ~F.col("correct"), F.col("selected")
    return rows.groupBy("epsilon", "template").agg(
        F.count("*").alias("facts"), F.count_if(sel).alias("selected_facts"), share(sel).alias("target_selected_rate"), share(F.col("before")).alias("baseline_correct_rate"),
        share(F.col("correct")).alias("evasion_rate"), share(F.col("correct")).alias("post_attack_correct_rate"), share(gain).alias("attack_gain_rate"), share(loss).alias("attack_regression_rate"),
        F.avg(F.when(sel, F.col("correct").cast("double"))).alias("correct_given_target_selected"), F.avg(F.when(sel, gain.cast("double"))).alias("gain_given_target_selected"),
    ).select(F.lit(float(rho)).alias("rho"), "epsilon", "template", F.lit(topology).alias("topology"), "facts", "selected_facts", "target_selected_rate", "baseline_correct_rate", "evasion_rate", "post_attack_correct_rate", "attack_gain_rate", "attack_regression_rate", "correct_given_target_selected", "gain_given_target_selected")


def margin_table(geometry: DataFrame, r_f: DataFrame, rho: float) -> DataFrame:
    """(fact, rho, s_del, s_surv, margin, r_f); r_f is null where a run is missing."""
    return geometry.where(F.col("rho") == rho).select("fact", "rho", "s_del", "s_surv", "margin").join(r_f, "fact", "left")
