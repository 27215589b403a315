"""Command line: audit, sweep, adversarial, followups and study over files that Spark can read.

    python -m memaudit.cli audit --prompts p.jsonl --vectors vectors.parquet --entries entries.parquet --out runs/a

Prompts are JSON lines (prompt_id or fact_id, prompt_text, gold_object, aliases, subject, relation). Vectors are Parquet
rows of fact and vector; entries are entry_id, vector, value, source_id. Answers without retrieval, where known, are
Parquet rows of fact and parametric.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memaudit.operators import adversary, audit, closure, drivers, incremental, jobs, neighbors, probe, search, suite, vector_index
from memaudit.sources import files, prompts


def radii(text: str) -> tuple[float, ...]:
    """0.95:0.70:0.05, or a list with commas."""
    if ":" in text:
        return tuple(closure.radius_grid(*map(float, text.split(":"))))
    return tuple(float(t) for t in text.split(","))


def names(text: str) -> tuple[str, ...]:
    return tuple(t for t in text.split(",") if t)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="memaudit", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = out.add_subparsers(dest="verb", required=True)
    common = argparse.ArgumentParser(add_help=False)
    for flag in ("--prompts", "--vectors", "--entries", "--out"):
        common.add_argument(flag, required=True)
    common.add_argument("--answers")
    common.add_argument("--limit", type=int)
    common.add_argument("--shard", help="i/n: every n-th fact from i on")
    common.add_argument("--backend", default="echo", choices=sorted(audit.BACKENDS))
    common.add_argument("--threshold", type=float, default=0.7)
    common.add_argument("--closure", type=names, default=())
    common.add_argument("--radius", type=float, default=0.85)
    common.add_argument("--envelope-top-k", type=int, default=500)
    common.add_argument("--max-closure-size", type=int, default=10_000)
    common.add_argument("--del-off-mode", default="null-retrieval", choices=("null-retrieval", "forbid-token"))
    common.add_argument("--index", help="an index of the entries' vectors, made by the verb index")
    common.add_argument("--store", help="FULL rows and generations that runs share (study: its own unless given)")
    common.add_argument("--canary-rate", type=float, default=0.0, help="share of the served generations that are made anew and compared")
    common.add_argument("--log")
    one = verbs.add_parser("audit", parents=[common], help="three states of every fact")
    one.add_argument("--probe", action="store_true", help="also probe the vectors for the answers")
    sweep = verbs.add_parser("sweep", parents=[common], help="geometric closures at all radii, with neighbours")
    sweep.add_argument("--radius-grid", type=radii, required=True)
    sweep.add_argument("--neighbor-mode", default="cosine", choices=("cosine", "same-source"))
    sweep.add_argument("--neighbor-ball", type=float, default=0.5)
    sweep.add_argument("--neighbor-cap", type=int, default=20)
    sweep.add_argument("--neighbor-min", type=int, default=5)
    attack = verbs.add_parser("adversarial", parents=[common], help="synthetic survivors just outside the closures")
    attack.add_argument("--epsilons", type=lambda t: tuple(map(float, names(t))), default=(0.01, 0.02, 0.05))
    attack.add_argument("--templates", type=names, default=adversary.TEMPLATES)
    attack.add_argument("--topology", default="single", choices=adversary.TOPOLOGIES)
    attack.add_argument("--count", type=int, default=3)
    attack.add_argument("--seed", type=int, default=0)
    study = verbs.add_parser("study", parents=[common], help="a standard audit and one for each policy, resumable")
    study.add_argument("--policies", type=names, default=("geometric", "value", "provenance"))
    index = verbs.add_parser("index", help="an exact index of the entries' vectors")
    index.add_argument("--entries", required=True)
    index.add_argument("--out", required=True)
    index.add_argument("--cells", type=int, help="cells, the square root of the entries if not given")
    more = verbs.add_parser("followups", help="tables and a report over finished audits")
    more.add_argument("--results", action="append", required=True, help="name=path of an audit")
    more.add_argument("--value-results", action="append", default=[], help="name=path of its value-policy audit")
    more.add_argument("--samples", action="append", default=[], help="name=path of sample_id, fact, vector")
    more.add_argument("--models", action="append", default=[], help="name:model=path of fact_id, correct")
    more.add_argument("--folds", type=int, default=5)
    more.add_argument("--out", required=True)
    return out


def load_facts(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Facts of the prompt file with their vectors and answers; a key that repeats is an error."""
    rows = prompts.parse_prompts(prompts.scan_jsonl(spark, args.prompts)).withColumnRenamed("key", "fact")
    rows = prompts.require_unique(rows, "fact")
    if args.shard:
        shard, shards = map(int, args.shard.split("/"))
        rows = incremental.stripe(rows.withColumn("place", F.crc32("fact")), shard, shards, "place").drop("place")
    if args.limit:
        rows = prompts.prefix(rows, args.limit, "fact")
    keyed = lambda path: spark.read.parquet(path).withColumn("fact", F.col("fact").cast("string"))
    out = rows.join(keyed(args.vectors).select("fact", "vector"), "fact", "left")
    said = keyed(args.answers).select("fact", "parametric") if args.answers else None
    out = out.join(said, "fact", "left") if said is not None else out.withColumn("parametric", F.lit("unknown"))
    return out.withColumn("parametric", F.coalesce("parametric", F.lit("unknown")))


def config_of(args: argparse.Namespace) -> drivers.AuditConfig:
    more: dict = {}
    if args.verb == "sweep":
        more = {"radii": args.radius_grid, "neighbors": neighbors.NeighborConfig(args.neighbor_mode, args.neighbor_ball, args.neighbor_cap, args.neighbor_min)}
    if args.verb == "adversarial":
        more = {"attack": adversary.AdversarialConfig(args.radius, args.epsilons, args.templates, args.topology, args.count, args.seed)}
    return drivers.AuditConfig(args.backend, args.threshold, args.closure, args.radius, args.envelope_top_k, args.max_closure_size, args.del_off_mode, **more)


def hooks_of(spark: SparkSession, args: argparse.Namespace) -> drivers.Hooks:
    return drivers.Hooks(index=vector_index.read(spark, args.index)) if args.index else drivers.Hooks()


def store_of(args: argparse.Namespace) -> drivers.Store | None:
    return drivers.Store(args.store, args.canary_rate) if args.store else None


def build_index(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The index of an entries table, ids as text; what it holds."""
    named = spark.read.parquet(args.entries).withColumn("entry_id", F.col("entry_id").cast("string"))
    made = vector_index.build(search.unit_rows(named, "entry_id", "vector"), args.cells)
    vector_index.write(made, args.out)
    return {"entries": made.n_entries, "cells": len(made.centroids), "shells": made.shells.num_rows}


def study(spark: SparkSession, args: argparse.Namespace, facts: DataFrame, entries: DataFrame, log) -> dict:
    """The standard audit, then one audit a policy, as jobs that a second call takes up again."""
    n = facts.count()
    plan = [incremental.Job("standard", "standard", n), *[incremental.Job(f"policy-{p}", "policy", n, ("standard",)) for p in args.policies]]

    def work(job: incremental.Job) -> dict:
        args.closure = () if job.name == "standard" else ("geometric", "value", "provenance") if job.name == "policy-hybrid" else (job.name.removeprefix("policy-"),)
        return drivers.run_backend_audit(facts, entries, f"{args.out}/{job.name}", config_of(args), hooks_of(spark, args), store_of(args) or drivers.Store(f"{args.out}/store", args.canary_rate))

    return jobs.run_plan(spark, plan, work, args.out, log)


def pairs(values: list[str]) -> dict[str, str]:
    return dict(v.split("=", 1) for v in values)


def followups(spark: SparkSession, args: argparse.Namespace) -> dict:
    value, samples, models = pairs(args.value_results), pairs(args.samples), pairs(args.models)
    data = {}
    for name, path in pairs(args.results).items():
        own = {k.split(":", 1)[1]: spark.read.parquet(v) for k, v in models.items() if k.split(":", 1)[0] == name}
        found = samples.get(name) or files.discover_sidecar(spark, path, name)
        data[name] = suite.Dataset(spark.read.parquet(f"{path}/results"), spark.read.parquet(f"{value[name]}/results") if name in value else None, own, spark.read.parquet(found) if found else None)
    return suite.run_followups(spark, data, args.out, probe.ProbeConfig(folds=args.folds))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("memaudit").getOrCreate()
    if args.verb == "followups":
        return followups(spark, args)
    if args.verb == "index":
        return build_index(spark, args)
    log = files.AuditLogger(args.log)
    facts, entries = load_facts(spark, args), spark.read.parquet(args.entries)
    if args.verb == "study":
        return study(spark, args, facts, entries, log)
    run = {"audit": drivers.run_backend_audit, "sweep": drivers.run_entanglement_sweep, "adversarial": drivers.run_adversarial_eval}[args.verb]
    summary = run(facts, entries, args.out, config_of(args), hooks_of(spark, args), store_of(args))
    if args.verb == "audit" and args.probe:
        samples = facts.select(F.col("fact").alias("sample_id"), "fact", "vector")
        summary["probe"] = probe.probe_audit_outputs(spark.read.parquet(f"{args.out}/results"), samples, args.out)
    log(json.dumps(summary, default=str, sort_keys=True))
    return summary


if __name__ == "__main__":
    main(sys.argv[1:])
