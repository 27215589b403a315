"""Follow-up statistics over audited facts: diagnostics, priors, bins, associations, oracle misses, splits."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from memaudit.functions import stats
from memaudit.functions import text as T

MODELS = ("co", "standard", "small")


@F.pandas_udf(DoubleType())
def seq_ratio(value: pd.Series, answers: pd.Series) -> pd.Series:
    """Greatest matching-blocks ratio of a value to its answers (a quadratic string alignment that SQL lacks)."""
    return pd.Series([max((difflib.SequenceMatcher(None, v or "", a or "").ratio() for a in (xs if xs is not None else [])), default=0.0) for v, xs in zip(value, answers)])


def variant_signal(value: Column, answers: Column, ratio: Column) -> Column:
    """Why a value may be a variant of an answer: acronym, similar text, token subset, else review."""
    v = T.norm(value)
    acronym = F.exists(answers, lambda a: (v != "") & ((v == T.acronym(a)) | (T.norm(a) == T.acronym(value))))
    subset = F.exists(answers, lambda a: T.token_subset(value, a))
    return F.when(acronym, "acronym").when(ratio >= 0.86, "similar").when(subset, "token-subset").otherwise("review")


#: Folds that every count is laid beside.
MOST_FOLDS = 1_000


def majority_priors(facts: DataFrame, by: str = "relation", fold: str = "fold", answer: str = "answer") -> DataFrame:
    """Out-of-fold priors, one row: accuracy of the commonest answer overall and per relation (ties to the smaller answer)
    and the share of facts whose answer is seen out of fold. Counts out of a fold are the totals less the fold's own.
    More than MOST_FOLDS folds are an error."""
    folds = facts.select(fold).distinct()
    n_folds = folds.count()
    if n_folds > MOST_FOLDS:
        raise ValueError(f"{n_folds} folds; at most {MOST_FOLDS} are compared")

    def modes(keys: list[str]) -> DataFrame:
        inside = facts.groupBy(*keys, answer, fold).agg(F.count("*").alias("inside"))
        every = facts.groupBy(*keys, answer).agg(F.count("*").alias("n"))
        grid = every.crossJoin(F.broadcast(folds))
        counts = grid.join(inside, [*keys, answer, fold], "left").withColumn("n", F.col("n") - F.coalesce("inside", F.lit(0))).where("n > 0")
        return counts.groupBy(*keys, fold).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(answer).alias("a")))["a"].alias("mode"))

    whole = modes([]).withColumnRenamed("mode", "global_mode")
    own = modes([by]).withColumnRenamed("mode", "own_mode")
    inside = facts.groupBy(answer, fold).agg(F.count("*").alias("inside"))
    seen = facts.groupBy(answer).agg(F.count("*").alias("n"))
    rows = facts.join(whole, fold, "left").join(own, [by, fold], "left").join(inside, [answer, fold]).join(seen, answer)
    hit = lambda c: F.avg(F.coalesce(F.col(c) == F.col(answer), F.lit(False)).cast("double"))
    return rows.agg(F.count("*").alias("facts"), hit("global_mode").alias("global_prior"), hit("own_mode").alias("relation_prior"), F.avg((F.col("n") > F.col("inside")).cast("double")).alias("answer_seen"))


def probe_diagnostics(facts: DataFrame, group: str = "group", legacy_fold: str = "fold", answer: str = "answer", relation: str = "relation") -> DataFrame:
    """One row: facts, distinct answers and relations, chance, commonest answer's share, entropy, and how groups repeat."""
    sizes = facts.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(legacy_fold).alias("folds"))
    many = F.col("n") > 1
    shape = sizes.agg(F.count("*").alias("canonical_groups"), F.count_if(many).alias("duplicate_groups"), F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("facts_in_duplicate_groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_canonical_group"), F.count_if(many & (F.col("folds") > 1)).alias("duplicate_groups_split_by_legacy_folds"))
    ent = stats.answer_entropy(facts, answer).select("answers", F.col("majority_share").alias("empirical_top_answer_rate"), F.col("entropy").alias("normalized_answer_entropy"))
    total = facts.agg(F.count("*").alias("facts"), F.count_distinct(relation).alias("relations"))
    return total.crossJoin(ent).crossJoin(shape).withColumn("uniform_chance", F.when(F.col("answers") > 0, 1.0 / F.col("answers")))


def matched_models(main: DataFrame, *others: tuple[str, DataFrame]) -> DataFrame:
    """Each fact of main with the correctness other models have for it, null where they lack it."""
    out = main
    for name, df in others:
        out = out.join(df.select("fact_id", F.col("correct").alias(f"{name}_correct")), "fact_id", "left")
    return out


def cohort_rows(df: DataFrame, full: str = "full_correct") -> DataFrame:
    """Rows once per cohort they belong to: answer_mention (all) and full_correct."""
    cohorts = F.array(F.lit("answer_mention"), F.when(F.coalesce(F.col(full), F.lit(False)), F.lit("full_correct")))
    return df.withColumn("cohort", F.explode(F.filter(cohorts, lambda c: c.isNotNull())))


def frequency_bin_summary(df: DataFrame, frequency: str, outcomes: list[str], full: str = "full_correct") -> DataFrame:
    """Per cohort and frequency bin: facts and mean outcomes; empty bins don't appear, absent outcomes don't count."""
    rows = cohort_rows(df, full).withColumn("bin", T.frequency_bin(F.col(frequency)))
    return rows.groupBy("cohort", "bin").agg(F.count("*").alias("facts"), *[F.avg(F.col(o).cast("double")).alias(f"{o}_rate") for o in outcomes])


def matched_model_summary(df: DataFrame, outcomes: list[str], full: str = "full_correct") -> DataFrame:
    return cohort_rows(df, full).groupBy("cohort").agg(F.count("*").alias("facts"), *[F.avg(F.col(o).cast("double")).alias(f"{o}_rate") for o in outcomes])


def frequency_association(df: DataFrame, frequency: str, outcomes: list[str], full: str = "full_correct") -> list[dict]:
    """Per cohort and model, empty cohorts too: facts, correct, Spearman, odds ratio per doubling with its interval."""
    out = []
    for cohort in ("answer_mention", "full_correct"):
        rows = df if cohort == "answer_mention" else df.where(F.coalesce(F.col(full), F.lit(False)))
        for o in outcomes:
            mine = rows.where(F.col(o).isNotNull())
            n, right = mine.agg(F.count("*"), F.count_if(F.col(o))).first()
            rho = stats.spearman(mine.withColumn("__o", F.col(o).cast("double")), frequency, "__o").first()
            out.append({"cohort": cohort, "model": o, "facts": n, "correct": right, "spearman": rho["spearman"] if rho else None} | {k: v for k, v in stats.logit_per_doubling(mine, frequency, o).items() if k != "n"})
    return out


def oracle_miss(facts: DataFrame) -> DataFrame:
    """One row: full-correct facts, survivors after deletion, those with a selected candidate, rates and lexical signals."""
    full = F.coalesce(F.col("full_correct"), F.lit(False))
    surv = full & F.coalesce(F.col("del_on_correct"), F.lit(False))
    cand = surv & F.col("selected_value").isNotNull()
    lexical = cand & (F.col("signal") != "review")
    return facts.agg(F.count_if(full).alias("full_correct"), F.count_if(surv).alias("survivors"), F.count_if(cand).alias("candidates"), F.try_divide(F.count_if(surv), F.count_if(full)).alias("survival_rate"), F.try_divide(F.count_if(cand), F.count_if(full)).alias("candidate_rate"), F.count_if(lexical).alias("lexical_signals"))


def survivor_split(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("borderline").cast("int")).alias("borderline"))


def label_coverage(rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without a label and labels without a row, each once for every time it occurs too often: empty if they agree."""
    a, b = rows.select(*keys), labels.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def preserve_labels(rows: DataFrame, previous: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows with the review columns of an earlier run where it has them."""
    old = previous.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns]).dropDuplicates(keys)
    out = rows.join(old, keys, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c) if c in rows.columns else F.lit("")))
    return out.drop(*[f"__{c}" for c in columns])


def intersect_cohort(*frames: DataFrame, key: str = "fact_id") -> DataFrame:
    out = frames[0].select(key).distinct()
    for df in frames[1:]:
        out = out.intersect(df.select(key))
    return out


def tolerance_violations(computed: DataFrame, stored: DataFrame, keys: list[str], values: list[str], tolerance: float = 5e-4) -> DataFrame:
    """(keys, metric, computed, stored) where the two differ by more than the tolerance or one side is missing."""
    long = lambda df, name: df.select(*keys, F.explode(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[F.col(v).cast("double") for v in values]))).alias("metric", name))
    both = long(computed, "computed").join(long(stored, "stored"), [*keys, "metric"], "full")
    apart = F.abs(F.col("computed") - F.col("stored")) > tolerance
    return both.where(apart | (F.col("computed").isNull() != F.col("stored").isNull()))


def cast_numeric(df: DataFrame) -> DataFrame:
    """String columns as doubles where every non-null value is a number; others are dropped."""
    names = [c for c, k in df.dtypes if k == "string"]
    if not names:
        return df
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(c) for c in names]).first()
    return df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) if c in names else F.col(c) for c in df.columns if c not in names or not bad[c]])


def first_wins(df: DataFrame, keys: list[str], order: str = "row_index") -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")


def cap_per_group(df: DataFrame, group: str, order: str, cap: int) -> DataFrame:
    """The first cap rows of each group in order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__r") <= cap).drop("__r")
