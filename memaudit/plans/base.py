"""Audit frames made from the driver's tables, and the same as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memaudit.functions import text as T
from memaudit.operators import audit, search
from memaudit.operators.scratch import stored

THRESHOLD, RADIUS, FLOOR = 0.25, 0.30, 0.20
GRID = [0.45, 0.4, 0.35, 0.3, 0.25, 0.2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it has fewer partitions: a small single-file table is otherwise one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, vector, value, value_norm, source_id."""
    e = spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("entry_id"), "embedding", F.concat(F.lit("label "), F.col("label")).alias("value"), (F.col("vec_id") % 25).alias("source_id"))
    unit = search.unit_rows(e.withColumn("r", F.struct("entry_id", "value", "source_id")), "r", "embedding")
    return unit.select("r.*", "vector").withColumn("value_norm", T.norm(F.col("value")))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact, vector, gold, gold_norms, parametric, garbled, answer_visible_before_event, source_id: every vector is a fact."""
    e = spread(table(spark, sf_dir, "embeddings"))
    visible = F.when(F.col("vec_id") % 17 == 0, F.lit(None).cast("boolean")).otherwise(F.col("vec_id") % 13 == 0)
    shift = F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)
    gold = F.concat(F.lit("label "), (F.col("label") + shift) % 10)
    said = F.concat(F.lit("label "), (F.col("vec_id") * 3 + 1) % 10)
    rows = e.select(F.struct(F.col("vec_id").alias("fact"), gold.alias("gold"), said.alias("parametric"), (F.col("vec_id") % 11 == 0).alias("garbled"), visible.alias("answer_visible_before_event"), (F.col("vec_id") % 25).alias("source_id")).alias("r"), "embedding")
    return search.unit_rows(rows, "r", "embedding").select("r.*", "vector").withColumn("gold_norms", T.norm_set(F.col("gold")))


#: Columns of entries that pairs get.
CARRY = ("value", "value_norm", "source_id")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).select("fact", "vector")


def pairs(spark: SparkSession, sf_dir: str, floor: float = FLOOR, queries: DataFrame | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """fact, entry_id, score, value, value_norm, source_id, own of pairs at or over the floor, streamed: as many as the square
    of the vectors, so for plans that aggregate them where they are scored, or return them all."""
    return search.score_pairs(units(spark, sf_dir) if queries is None else queries, entries(spark, sf_dir), floor, own=own, carry=CARRY)


def best_pairs(spark: SparkSession, sf_dir: str, k: int, floor: float = FLOOR, below: float | None = None) -> DataFrame:
    """pairs() of each fact's k best, with rank; written."""
    return stored(search.nearest(units(spark, sf_dir), entries(spark, sf_dir), k, floor, below=below, carry=CARRY), "best")


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated facts (all, with skip_reason) and FULL's selection; written."""
    return stored(audit.gate(facts(spark, sf_dir).drop("vector", "source_id"), audit.best(best_pairs(spark, sf_dir, 1, THRESHOLD), THRESHOLD)), "cohort")


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort(spark, sf_dir).where("skip_reason is null")


def states(spark: SparkSession, sf_dir: str, policies: tuple[str, ...] = audit.POLICIES, who: DataFrame | None = None) -> DataFrame:
    """The three states of each policy; who (audited) where the caller has it already."""
    who = audited(spark, sf_dir) if who is None else who
    scored = audit.contenders(who, units(spark, sf_dir), entries(spark, sf_dir), THRESHOLD, RADIUS, policies)
    full = F.when(F.col("garbled"), F.lit("unknown")).otherwise(F.col("selected_value"))
    return audit.three_states(who, scored, THRESHOLD, RADIUS, policies, full_output=full)


def sql_norm(x: str) -> str:
    """Normal form of a SQL text expression."""
    return f"array_to_string({sql_tokens(x)}, ' ')"


def sql_tokens(x: str) -> str:
    folded = f"replace(translate(lower(coalesce({x}, '')), 'ςſµ', 'σsμ'), 'ß', 'ss')"
    return f"regexp_extract_all({folded}, '{T.TOKEN.replace(chr(39), chr(39) * 2)}')"


def sql_holds(whole: str, phrase: str) -> str:
    return f"({phrase} <> '' AND contains(' ' || {whole} || ' ', ' ' || {phrase} || ' '))"


def sql_judge(value: str, answer: str) -> str:
    return f"({sql_holds(value, answer)} OR (length({value}) >= 3 AND {sql_holds(answer, value)}))"


#: Vectors, entries, facts and pairs.
SQL_PAIRS = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT vec_id AS entry_id, 'label ' || label AS value, vec_id % 25 AS source_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
f AS (SELECT vec_id AS fact, 'label ' || ((label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10) AS gold,
      'label ' || ((vec_id * 3 + 1) % 10) AS parametric, vec_id % 11 = 0 AS garbled,
      CASE WHEN vec_id % 17 = 0 THEN NULL ELSE vec_id % 13 = 0 END AS visible, vec_id % 25 AS source_id, v, sqrt(list_dot_product(v, v)) AS n FROM v),
allp AS (SELECT f.fact, e.entry_id, round(list_dot_product(f.v, e.v) / (f.n * e.n), 12) AS score, e.value, e.source_id, f.gold, f.parametric, f.garbled
      FROM f CROSS JOIN e),
p AS (SELECT * FROM allp WHERE score >= 0.2)
"""

#: FULL's selection and the cohort.
SQL_COHORT = (
    SQL_PAIRS
    + """,
sel AS (SELECT fact, entry_id AS selected_id, value AS selected_value, source_id AS selected_source, score AS selected_score FROM (
      SELECT *, row_number() OVER (PARTITION BY fact ORDER BY score DESC, entry_id) AS r FROM p WHERE score >= 0.25) WHERE r = 1),
gated AS (SELECT f.fact, f.gold, f.parametric, f.garbled, sel.selected_id, sel.selected_value, sel.selected_source,
      CASE WHEN sel.selected_id IS NULL THEN 'no-retrieval' WHEN sel.selected_value <> f.gold THEN 'no-answer-mention'
      WHEN f.visible THEN 'answer-before-retrieval' WHEN f.visible IS NULL THEN 'unknown-alignment' END AS skip_reason
      FROM f LEFT JOIN sel ON f.fact = sel.fact),
cohort AS (SELECT * FROM gated WHERE skip_reason IS NULL)
"""
)

#: The three states of each policy: values here are single labels, so mentions are equalities.
SQL_STATES = (
    SQL_COHORT
    + """,
policies AS (SELECT unnest(['oracle', 'geometric', 'value', 'provenance', 'hybrid']) AS policy),
cand AS (SELECT policy, p.fact, p.entry_id, p.value, p.score FROM p JOIN cohort c ON p.fact = c.fact CROSS JOIN policies
      WHERE p.score >= 0.25 AND p.entry_id <> c.selected_id
      AND NOT (policy IN ('geometric', 'hybrid') AND p.score >= 0.30)
      AND NOT (policy IN ('value', 'hybrid') AND p.value = c.gold)
      AND NOT (policy IN ('provenance', 'hybrid') AND p.source_id = c.selected_source)),
top AS (SELECT policy, fact, value FROM (SELECT *, row_number() OVER (PARTITION BY policy, fact ORDER BY score DESC, entry_id) AS r FROM cand) WHERE r = 1),
states AS (SELECT po.policy, c.fact, c.gold, coalesce(t.value, c.parametric) AS del_on_output,
      (CASE WHEN c.garbled THEN 'unknown' ELSE c.selected_value END) = c.gold AS f, coalesce(t.value, c.parametric) = c.gold AS n, c.parametric = c.gold AS o
      FROM cohort c CROSS JOIN policies po LEFT JOIN top t ON t.policy = po.policy AND t.fact = c.fact)
"""
)
