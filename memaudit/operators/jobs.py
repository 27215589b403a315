"""A study's jobs, run in order and resumed: every finished job leaves a mark under the plan's fingerprint."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import SparkSession

from memaudit.sources import files

from .incremental import Job, StaleArtifacts, job_order, plan_fingerprint

Work = Callable[[Job], object]


def _mark(path: str, job: Job) -> str:
    return f"{path}/done/{job.name.replace('/', '__')}"


def status(spark: SparkSession, jobs: list[Job], path: str) -> dict[str, str]:
    """Each job as done, runnable or waiting."""
    done = {j.name for j in jobs if files.exists(spark, _mark(path, j))}
    return {j.name: "done" if j.name in done else "runnable" if set(j.after) <= done else "waiting" for j in job_order(jobs)}


def run_plan(spark: SparkSession, jobs: list[Job], work: Work, path: str, log: Callable[..., None] = print) -> dict[str, str]:
    """Run all jobs whose mark is missing, costliest first among those that may run. Returns each job's state: done (it
    was before), ran, failed, or blocked (it waits for a failed one).

    A failed job stops what waits for it and nothing else; a second call takes up where this one ended. A path that
    holds another plan is refused.
    """
    ordered, plan = job_order(jobs), f"{path}/plan"
    print_ = plan_fingerprint(jobs)
    if files.exists(spark, plan):
        if json.loads(spark.read.text(plan, wholetext=True).first()[0])["fingerprint"] != print_:
            raise StaleArtifacts(f"{path} holds another plan")
    else:
        files.write_document(spark, plan, {"fingerprint": print_, "jobs": [[j.name, j.phase, j.rows, list(j.after)] for j in ordered]})
    state: dict[str, str] = {}
    for job in ordered:
        if files.exists(spark, _mark(path, job)):
            state[job.name] = "done"
        elif any(state[a] in ("failed", "blocked") for a in job.after):
            state[job.name] = "blocked"
        else:
            log(f"{job.name}: begins")
            try:
                told = work(job)
            except Exception as e:  # a job's own failure is reported, and the others still run
                state[job.name] = "failed"
                log(f"{job.name}: failed: {e}")
                continue
            files.write_document(spark, _mark(path, job), {"job": job.name, "result": told})
            state[job.name] = "ran"
            log(f"{job.name}: done")
    return state
