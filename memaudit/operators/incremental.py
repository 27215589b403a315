"""Incremental execution: guards, resume, reuse by fingerprint, canaries, shards, job plans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memaudit.functions.text import crc_sample

from .scratch import stored

SCHEMA_VERSION = 3


class StaleArtifacts(RuntimeError):
    """Stored results were made with another configuration or schema."""


def config_fingerprint(config: dict, length: int = 16) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:length]


#: Seeds of the two hashes of a row or column.
SEEDS = (11, 23)


def _hashes(*columns: Column) -> list[Column]:
    """Two 64-bit hashes; a null counts, and so does where it stands. A map is hashed as JSON."""
    return [F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)]) for seed in SEEDS]


def row_digest(*columns: Column) -> Column:
    """128 bits over a row's values, as text."""
    return F.concat_ws("-", *[F.hex(h) for h in _hashes(*columns)])


def content_digest(df: DataFrame) -> dict:
    """What df holds, whatever the order of its rows and columns: rows, and per column its type and the sums of two hashes
    of its values, besides those of whole rows. One aggregate; repeated rows count."""
    names = sorted(df.columns)
    plain = [F.to_json(F.col(f"`{c}`")) if df.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in names]
    wide = lambda h: F.sum(h.cast("decimal(20,0)"))
    sums = [wide(h).alias(f"c{i}_{j}") for i, c in enumerate([*[[p] for p in plain], plain]) for j, h in enumerate(_hashes(*c))]
    got = df.agg(F.count("*").alias("rows"), *sums).first()
    told = lambda i: [str(got[f"c{i}_{j}"]) for j in range(len(SEEDS))]
    return {"rows": got["rows"], "columns": {c: [df.schema[c].dataType.simpleString(), *told(i)] for i, c in enumerate(names)}, "whole": told(len(names))}


def commit(df: DataFrame, path: str) -> dict:
    """Write what the table at path now holds (df) into `path`.commit: the last thing that a run writes of a table."""
    told = {"schema_version": SCHEMA_VERSION, **content_digest(df)}
    df.sparkSession.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.commit")
    return told


def check_commit(df: DataFrame, path: str) -> bool:
    """Whether the table at path (df) was committed; StaleArtifacts if it isn't what its commit says.

    A table without a commit is of a run that was interrupted: what it holds whole is taken, the rest is made anew.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.commit")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return False
    told = spark.read.text(f"{path}.commit", wholetext=True).first()
    if told is None:
        return False
    if json.loads(told[0]) != {"schema_version": SCHEMA_VERSION, **content_digest(df)}:
        raise StaleArtifacts(f"{path} isn't what was committed there")
    return True


def drop_commit(spark: SparkSession, path: str) -> None:
    """Before a table is appended to: until its next commit it counts as interrupted."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.commit")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def refuse_changed(now: DataFrame, kept: DataFrame, key: str, digest: str = "input_digest") -> None:
    """StaleArtifacts if a key of kept has another digest in now: results of other inputs are never mixed with new ones."""
    old = kept.select(key, F.col(digest).alias("__old")).distinct()
    bad = now.select(key, digest).join(old, key).where(~F.col(digest).eqNullSafe(F.col("__old"))).select(key).limit(3).collect()
    if bad:
        raise StaleArtifacts(f"stored results of {[r[0] for r in bad]} were made of other inputs")


def resume_guard(spark: SparkSession, path: str, config: dict, inputs: dict[str, DataFrame] | None = None) -> None:
    """Check the configuration stored beside results at path, and the contents of inputs, against the current ones; store
    them if there are none."""
    config = config | {"inputs": {name: content_digest(df) for name, df in inputs.items()}} if inputs else config
    wanted = json.dumps({"schema_version": SCHEMA_VERSION, "config": config}, sort_keys=True)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/config")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        told = spark.read.text(str(where.toString()), wholetext=True).first()
        if told is None or json.loads(told[0]) != json.loads(wanted):
            raise StaleArtifacts(f"{path} holds results of another configuration")
    else:
        spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(where.toString())


def fingerprint(*parts: Column) -> Column:
    """One hash over what a generation depends on: sorted ids, sources, backstop, target."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def remaining(jobs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that no stored row covers."""
    return jobs.join(done.select(*keys).distinct(), keys, "left_anti")


def complete_groups(rows: DataFrame, key: str = "fact_id", states: tuple[str, ...] = ("FULL", "DEL-ON", "DEL-OFF")) -> DataFrame:
    """Rows of facts that have every state: an interrupted fact counts as not done."""
    ok = rows.groupBy(key).agg(F.array_sort(F.collect_set("state")).alias("s")).where(F.col("s") == F.array_sort(F.array(*map(F.lit, states))))
    return rows.join(ok, key, "left_semi")


def union_first_wins(parts: Iterable[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several logs, of equal keys the one of the earliest log (then of the least row_index)."""
    tagged = [p.withColumn("__p", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    order = ["__p", *(["row_index"] if "row_index" in out.columns else [])]
    return out.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r", "__p")


def reuse(jobs: DataFrame, kept: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(served, to generate): jobs with a stored row of equal keys and fingerprint, of the first source; and the rest.

    kept has keys, fingerprint, source_pos and results; served carries them, stamped with the job's own columns.
    """
    on = [*keys, "fingerprint"]
    first = kept.withColumn("__r", F.row_number().over(Window.partitionBy(*on).orderBy("source_pos"))).where("__r = 1").drop("__r")
    served = jobs.join(first, on).withColumn("provenance", F.lit("reused"))
    return served, jobs.join(first.select(*on), on, "left_anti").withColumn("provenance", F.lit("generated"))


def generated(jobs: DataFrame, keys: list[str], make, path: str | None = None, rate: float = 0.0, report: str | None = None, compared: tuple[str, ...] = ("output",)) -> tuple[DataFrame, dict]:
    """Results of jobs (keys, fingerprint, and what make needs), each distinct (keys, fingerprint) made once for all phases.

    make(jobs) gives keys, fingerprint and the results. With a path, results are taken from the table there and new ones
    appended to it, so a second call goes on where the first stopped and other phases are served. Of the served ones a
    sample (crc of key and fingerprint, `rate`) is made anew in the same pass; one that differs fails the run, with both
    sides in `report`. Returns all results and the counts of served, generated and canary rows.
    """
    from memaudit.sources.files import canary_report, exists

    on = [*keys, "fingerprint"]
    spark = jobs.sparkSession
    jobs = jobs.dropDuplicates(on)
    if path is None:
        made = stored(make(jobs).withColumn("provenance", F.lit("generated")), "generated")
        return made, {"served": 0, "generated": made.count(), "canaries": 0}
    have = exists(spark, path)
    old = spark.read.parquet(path).drop("provenance", "written") if have else None
    token = F.concat_ws("|", *[F.col(c).cast("string") for c in on])
    if old is not None:
        old = old.dropDuplicates(on)  # two runs may have made one generation at once; equal fingerprints give equal results
        known = jobs.join(old.select(*on, F.lit(True).alias("__known")), on, "left")
    else:
        known = jobs.withColumn("__known", F.lit(None).cast("boolean"))
    marked = stored(known.withColumn("__canary", F.col("__known").isNotNull() & crc_sample(token, rate)), "generation-jobs")
    todo = marked.where("__known is null or __canary").drop("__known")
    fresh = stored(make(todo.drop("__canary")).join(todo.select(*on, "__canary"), on), "fresh")
    checks = fresh.where("__canary")
    if old is not None and rate > 0:
        canary_report(canary_mismatches(old, checks, on, list(compared)), report or f"{path}.mismatches")
    new = fresh.where(~F.col("__canary")).drop("__canary")
    n_new, n_checks = new.count(), checks.count()
    if n_new:
        new.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)
    served = marked.where("__known").select(*on)
    results = new.withColumn("provenance", F.lit("generated"))
    if old is not None:
        results = results.unionByName(old.join(served, on, "left_semi").withColumn("provenance", F.lit("reused")))
    return results, {"served": served.count(), "generated": n_new, "canaries": n_checks}


def canaries(served: DataFrame, token: Column, rate: float) -> DataFrame:
    """The served rows that are also generated anew to check the reuse."""
    return served.where(crc_sample(token, rate))


def canary_mismatches(served: DataFrame, fresh: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Both sides of every canary that came out otherwise."""
    f = fresh.select(*keys, *[F.col(c).alias(f"fresh_{c}") for c in compared])
    differ = F.lit(False)
    for c in compared:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"fresh_{c}"))
    return served.select(*keys, *compared).join(f, keys).where(differ)


def reuse_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("state", "provenance").agg(F.count("*").alias("n"))


def stripe(df: DataFrame, shard: int, shards: int, index: str = "row_index") -> DataFrame:
    """Every shards-th row from place shard on."""
    if not 0 <= shard < shards:
        raise ValueError("shard must be in [0, shards)")
    return df.where(F.pmod(F.col(index), F.lit(shards)) == shard)


def stripe_radii(radii: list[float], shard: int, shards: int) -> list[float]:
    return radii[shard::shards]


@dataclass(frozen=True)
class Job:
    name: str
    phase: str
    rows: int = 0
    after: tuple[str, ...] = ()


#: Relative cost of a row in each phase; they only order runnable jobs.
PHASE_COST = {"standard": 3, "sweep": 18, "adversarial": 13, "del-off": 3, "policy": 12, "parametric": 3}


def job_order(jobs: list[Job]) -> list[Job]:
    """Jobs in an order that respects `after`; of runnable ones the costliest first, then by name. Cycles are errors."""
    by_name = {j.name: j for j in jobs}
    if len(by_name) != len(jobs):
        raise ValueError("job names must be unique")
    for j in jobs:
        if missing := set(j.after) - set(by_name):
            raise ValueError(f"{j.name} waits for unknown jobs {sorted(missing)}")
    done: list[Job] = []
    names: set[str] = set()
    while len(done) < len(jobs):
        ready = [j for j in jobs if j.name not in names and set(j.after) <= names]
        if not ready:
            raise ValueError("jobs wait for one another in a circle")
        best = min(ready, key=lambda j: (-j.rows * PHASE_COST.get(j.phase, 1), j.name))
        done.append(best)
        names.add(best.name)
    return done


def plan_fingerprint(jobs: list[Job]) -> str:
    return config_fingerprint({j.name: [j.phase, j.rows, sorted(j.after)] for j in jobs}, 12)


def audit_plan(datasets: dict[str, int], models: list[str], policies: list[str]) -> list[Job]:
    """The jobs of a full study: per set and memory model a standard audit, then del-off control, sweep, adversarial and
    one job per policy, which wait for it; per set and parametric model (named with a leading =) one job."""
    out = []
    for d, n in datasets.items():
        for m in models:
            if m.startswith("="):
                out.append(Job(f"{d}/{m[1:]}/parametric", "parametric", n))
                continue
            first = f"{d}/{m}/standard"
            out.append(Job(first, "standard", n))
            out += [Job(f"{d}/{m}/{p}", p, n, (first,)) for p in ("del-off", "sweep", "adversarial")]
            out += [Job(f"{d}/{m}/policy-{p}", "policy", n, (first,)) for p in policies]
    return out
