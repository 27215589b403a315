"""The stateful completion of facts against the batch metrics: shuffled arrival, restarts, repeats, facts that never complete."""

import random

import pytest
from pyspark.sql import functions as F

from memaudit.operators import metrics
from memaudit.streaming import complete, ingest

KIND = "fact_id string, state string, prompt_id string, prompt string, ground_truth string, manifest_id string, object_aliases array<string>, model_output string, row_index long, written timestamp"


def test_facts_leave_once_and_whole(spark, tmp_path):
    r = random.Random(2)
    facts = [(f"f{i}", s, None, "q", "Paris", None, ["Paname"] if i % 3 else None, r.choice(["Paris", "in Paname", "unknown", "Rome", None]), 0) for i in range(60) for s in metrics.STATES]
    r.shuffle(facts)
    rows = [(*x, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i, x in enumerate(facts)]
    gone = [x for x in rows if not (x[0] in ("f7", "f8") and x[1] == "FULL")]  # these never complete
    kind = KIND.replace("timestamp", "string")
    frame = lambda x: spark.createDataFrame(x, kind).withColumn("written", F.to_timestamp("written"))
    (tmp_path / "in").mkdir()
    at = str(tmp_path / "in")
    stream = spark.readStream.schema(frame(rows).schema).option("maxFilesPerTrigger", 1).parquet(at)

    def go():
        ingest.append_stream(complete.complete_facts(stream, "written", "1 hour", 3_600_000), f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
        return {x.fact_id: x for x in spark.read.schema(complete.OUT).parquet(f"{tmp_path}/table").collect()}

    frame(gone[:90]).coalesce(1).write.mode("append").parquet(at)
    first = go()
    frame(gone[90:] + [x for x in gone[:90] if x[0] == next(iter(first), "f1")]).coalesce(1).write.mode("append").parquet(at)  # and a repeat of one that left
    second = go()
    assert 0 < len(first) < len(second) == 58 and all(x.complete and x.rows == 3 for x in second.values())
    whole = frame([x for x in rows if x[0] not in ("f7", "f8")])
    got, want = complete.totals(spark.read.schema(complete.OUT).parquet(f"{tmp_path}/table")).first().asDict(), metrics.metrics_total(whole, traces=False).first().asDict()
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    # Time goes on: the incomplete facts leave with what they have.
    late = [("z", "FULL", None, "q", "Paris", None, None, "Paris", 0, "2024-01-02 00:00:00")]
    frame(late).coalesce(1).write.mode("append").parquet(at)
    third = go()
    assert {f: x.missing for f, x in third.items() if not x.complete} == {"f7": ["FULL"], "f8": ["FULL"]} and len(third) == 60
    assert spark.read.schema(complete.OUT).parquet(f"{tmp_path}/table").count() == 60
