"""Survivors on lists against a plain search, with pages so short that jobs stay open."""

import random

from pyspark.sql import functions as F

from memaudit.operators import sweep


def test_survivors_and_open_jobs(spark):
    r = random.Random(8)
    scored = [(f"f{i}", f"e{e}", round(r.random(), 2), r.choice(["s1", "s2", None])) for i in range(12) for e in range(r.randrange(0, 9))]
    radii = [0.9, 0.6, 0.3]
    hidden = [(f"t{t}", f"e{e}", r.choice(radii)) for t in range(4) for e in r.sample(range(9), r.randrange(0, 8))]
    jobs = [(f"t{t}", f"f{i}") for t in range(5) for i in range(12)]
    ranked = sweep.ranking(spark.createDataFrame(scored, "subject string, entry_id string, score double, source_id string").withColumn("value", F.col("entry_id")), 0.2, "subject")
    lost = spark.createDataFrame(hidden, "target string, entry_id string, since double")
    lists = lost.groupBy("target").agg(F.collect_list("entry_id").alias("entry_ids"), F.collect_list("since").alias("entry_from"))
    work = spark.createDataFrame(jobs, "target string, subject string").join(lists, "target", "left").withColumn("source_ids", F.array().cast("array<string>"))
    order = {f: sorted((-s, e, src) for x, e, s, src in scored if x == f and s >= 0.2) for f in {j[1] for j in jobs}}
    since = {(t, e): s for t, e, s in hidden}
    want = {(t, f, rho): next((k for k, (_, e, _) in enumerate(order[f], 1) if since.get((t, e), -1) < rho), None) for t, f in jobs for rho in radii}
    for page in (2, 50):
        found = sweep.survivors(work, sweep.pages(ranked, "subject", page), ["target", "subject"], "subject", radii)
        assert found.where("open").isEmpty() == (page == 50)
        got = {(x.target, x.subject, x.rho): x.place for x in sweep.settled(found, ranked, lost, ["target", "subject"], "target", "subject").collect()}
        assert got == want
    # Without radii: ids and sources together; a null source is never hidden.
    plain = work.withColumn("source_ids", F.array(F.lit("s1"), F.lit(None).cast("string")))
    got = {(x.target, x.subject): x.place for x in sweep.survivors(plain, sweep.pages(ranked, "subject"), ["target", "subject"], "subject").collect()}
    assert got == {(t, f): next((k for k, (_, e, s) in enumerate(order[f], 1) if (t, e) not in since and s != "s1"), None) for t, f in jobs}
