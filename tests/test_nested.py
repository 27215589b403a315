"""Nesting of a closure family, checked where its rows are scored."""

import numpy as np
from pyspark.sql import functions as F

from memaudit.operators import closure
from memaudit.plans import registry


def test_missing_radii_are_nesting_violations(spark):
    r, grid = np.random.default_rng(7), [0.9, 0.6, 0.3]
    rows = [(f, e, float(np.round(r.uniform(-1, 1), 2)), e % 3, f"label {e % 4}", f"label {e % 4}", ["label 1"]) for f in range(5) for e in range(40)]
    scored = spark.createDataFrame(rows, "fact long, entry_id long, score double, source_id long, value string, value_norm string, answer_norms array<string>")
    seeds = spark.createDataFrame([(f, 3 * f, f % 3) for f in range(5)], "fact long, entry_id long, source_id long")
    config = closure.ClosureConfig(radius=0.6, envelope_top_k=6)
    whole, lists = closure.caught(scored, seeds, grid, config), closure.caught_radii(scored, seeds, grid, config)
    told = lambda df: sorted(map(tuple, df.select("fact", "rho", "entry_id").collect()))
    assert told(lists.select("fact", F.explode("radii").alias("rho"), "entry_id")) == told(whole)
    want = told(closure.nesting_violations(whole.where("not (rho = 0.6 and entry_id % 2 = 0)")))
    torn = F.when(F.col("entry_id") % 2 == 0, F.array_remove("radii", 0.6)).otherwise(F.col("radii"))
    assert want and told(lists.select("fact", F.explode(closure.missing_radii(torn, grid)).alias("rho"), "entry_id")) == want


def test_nested_family_is_streamed(spark):
    """Above the product of blocks, no row of the family is shuffled, joined or written."""
    plan = registry.QUERIES["nested_family"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("CartesianProduct")]
    assert "Exchange" not in above and "Join" not in above and "Union" not in above
