"""Entanglement: what deleting a fact at each radius does to it and to its neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import search

#: Pairs of a block whose hidden score is computed at a time.
PAIRS = 10_000
#: A subject's best candidates that travel as one list. A job that hides all of them, where there are more, stays open.
PAGE = 4096


def ranking(scored: DataFrame, threshold: float, key: str = "fact") -> DataFrame:
    """scored at or over the threshold with `place` from 1: score descending, ties to the smaller id."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "entry_id")
    return scored.where(F.col("score") >= threshold).withColumn("place", F.row_number().over(order))


def pages(ranked: DataFrame, key: str = "fact", page: int = PAGE) -> DataFrame:
    """(key, ids, sources, more): the entries and sources of each key's first `page` places, and whether there are further ones."""
    kept = ranked.where(F.col("place") <= page + 1).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "entry_id", "source_id"))).alias("held"))
    first = F.slice("held", 1, page)
    return kept.select(key, F.transform(first, lambda x: x["entry_id"]).alias("ids"), F.transform(first, lambda x: x["source_id"]).alias("sources"), (F.size("held") > page).alias("more"))


def survivors(jobs: DataFrame, listed: DataFrame, by: list[str], key: str = "fact", radii: list[float] | None = None) -> DataFrame:
    """(by, place, open), with radii (by, rho, place, open): the first place of the job's key that the job doesn't hide.

    jobs: by, key, entry_ids, source_ids; with radii also entry_from, the largest radius at which each of entry_ids is
    hidden (it is at all smaller ones). listed: pages(). place is null if nothing is left; open marks jobs that hide a
    whole page of a key that has more, which this can't decide. One row a job meets one page: what is shuffled grows with
    the jobs, not with jobs x candidates.
    """
    work = jobs.join(listed, key, "left").select(*by, "entry_ids", "source_ids", *(["entry_from"] if radii else []), "ids", "sources", "more")
    kinds = [jobs.schema[c].dataType for c in by]
    steps = [float(r) for r in radii] if radii else [None]
    schema = pa.schema([*((c, to_arrow_type(k)) for c, k in zip(by, kinds)), *([("rho", pa.float64())] if radii else []), ("place", pa.int32()), ("open", pa.bool_())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            rows, rho, place, opened = [], [], [], []
            for i in range(b.num_rows):
                ids, hidden = column["ids"][i].values, column["entry_ids"][i].values
                more = bool(column["more"][i].as_py())
                at = pc.index_in(ids, value_set=hidden) if ids is not None and hidden is not None else None
                for r in steps:
                    if ids is None:
                        left = np.zeros(0, bool)
                    elif at is None:
                        left = np.ones(len(ids), bool)
                    else:
                        found = at.fill_null(-1).to_numpy(zero_copy_only=False)
                        left = found < 0
                        if r is not None and len(hidden):
                            since = column["entry_from"][i].values.to_numpy(zero_copy_only=False)
                            left |= since[np.maximum(found, 0)] < r
                    sources = column["source_ids"][i].values
                    if len(left) and sources is not None and len(sources):
                        left &= ~pc.is_in(column["sources"][i].values, value_set=sources.drop_null()).to_numpy(zero_copy_only=False)
                    first = int(left.argmax()) + 1 if left.any() else None
                    rows.append(i)
                    rho.append(r)
                    place.append(first)
                    opened.append(first is None and more)
            if rows:
                own = [b.column(k).take(pa.array(rows)) for k in range(len(by))]
                yield pa.RecordBatch.from_arrays([*own, *([pa.array(rho, pa.float64())] if radii else []), pa.array(place, pa.int32()), pa.array(opened)], schema=schema)

    ddl = ", ".join([*(f"{c} {k.simpleString()}" for c, k in zip(by, kinds)), *(["rho double"] if radii else []), "place int, open boolean"])
    return work.mapInArrow(run, ddl)


def settled(found: DataFrame, ranked: DataFrame, hidden: DataFrame, by: list[str], target: str, key: str) -> DataFrame:
    """survivors(radii=...) with its open jobs decided by joins, however many candidates they hide.

    hidden: target, entry_id, since (the largest radius that hides it).
    """
    todo = found.where("open").select(*by, "rho").join(ranked.select(key, "place", "entry_id"), key).join(hidden.select(target, "entry_id", "since"), [target, "entry_id"], "left")
    late = todo.where("since is null or since < rho").groupBy(*by, "rho").agg(F.min("place").alias("late"))
    return found.join(late, [*by, "rho"], "left").select(*by, "rho", F.coalesce("place", "late").alias("place"))


def geometric_survivors(jobs: DataFrame, entries: DataFrame, by: list[str], radii: list[float], threshold: float, carry: tuple[str, ...] = (), entry_col: str = "entry_id") -> DataFrame:
    """(by, rho, entry_col, score, carry): of each job and radius the best entry at or over the threshold that the target's
    geometric closure leaves, ties to the smaller id; no row where it leaves none.

    jobs: by, vector (the subject's), target_vector and seed (the target's own entry, hidden at every radius). entries:
    entry_col, vector, carry. An entry is hidden at rho if its cosine to target_vector is at least rho. Blocks of jobs
    meet blocks of entries; a job keeps one entry a radius, and of a pair that could be better than one of these the
    target's cosine is taken there. Jobs of equal vectors, as a subject's are, lie together, and such a vector is scored
    once. Neither candidates nor closures are written: what is shuffled has the jobs' size.
    """
    n = len(radii)
    own, kinds = [f"own{i}" for i in range(len(by))], [jobs.schema[c].dataType for c in by]
    fields = [*zip(by, kinds), (entry_col, entries.schema[entry_col].dataType), *((c, entries.schema[c].dataType) for c in carry)]
    schema = pa.schema([*((c, to_arrow_type(k)) for c, k in fields), ("rho", pa.float64()), ("score", pa.float64())])
    ddl = ", ".join([*(f"{c} {k.simpleString()}" for c, k in fields), "rho double", "score double"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, held, waiting = None, None, None, []

        def settle() -> None:
            nonlocal held, waiting
            if waiting:
                held, waiting = search.best_held(held, pa.concat_tables(waiting), 1, low), []

        def rows() -> Iterator[pa.RecordBatch]:
            settle()
            if held is not None and held.num_rows:
                q, e, s, *rest = (c.combine_chunks() for c in held.columns)
                job, at = np.divmod(np.asarray(q), n)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(job)) for c in names), e, *rest, pa.array(np.array(radii, float)[at]), s], schema=schema)

        for name, column, x, y in search.block_pairs(stream):
            if name != block:
                if block is not None:
                    yield from rows()
                block, names, held, waiting = name, [column(f"q_{c}") for c in own], None, []
                target = column("q_target_vector").to_numpy(zero_copy_only=False).reshape(len(x), -1)
                low = np.full((len(x), n), float(threshold))
                low[np.ix_((target == x).all(axis=1), np.array(radii) <= threshold)] = np.inf  # hides all that it retrieves
                low, seeds = low.ravel(), column("q_seed")
                _, first, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
                order = np.argsort(which.ravel(), kind="stable")  # jobs by vector
                sizes = np.bincount(which.ravel(), minlength=len(first))
                begins = np.cumsum(sizes) - sizes
            ids, some = column("e_ids"), x[first]
            least = np.minimum.reduceat(low.reshape(-1, n).min(axis=1)[order], begins)
            for u, e, s in search.hits(some, y, least):
                for part in range(0, len(u), PAIRS):
                    k = sizes[u[part : part + PAIRS]]
                    at = np.repeat(np.arange(part, part + len(k)), k)
                    q = order[np.repeat(begins[u[part : part + PAIRS]] - (np.cumsum(k) - k), k) + np.arange(len(at))]
                    ok = s[at] >= low.reshape(-1, n).min(axis=1)[q]
                    at, q = at[ok], q[ok]
                    for cut in range(0, len(q), PAIRS):
                        job, entry, score = q[cut : cut + PAIRS], e[at[cut : cut + PAIRS]], s[at[cut : cut + PAIRS]]
                        better = (score[:, None] >= low.reshape(-1, n)[job]).any(axis=1)  # floors may have risen
                        job, entry, score = job[better], entry[better], score[better]
                        ent = pa.array(entry)
                        hidden = search.pair_scores(target, y, job, entry)
                        free = ~pc.fill_null(pc.equal(ids.take(ent), seeds.take(pa.array(job))), False).to_numpy(zero_copy_only=False)
                        ok = [np.flatnonzero(free & (hidden < rho) & (score >= low[job * n + i])) for i, rho in enumerate(radii)]
                        slot, pair = np.concatenate([job[w] * n + i for i, w in enumerate(ok)]), np.concatenate(ok)
                        np.maximum.at(low, slot, score[pair])
                        pair, slot = pair[(last := score[pair] >= low[slot])], slot[last]
                        if len(pair):
                            found = pa.array(entry[pair])
                            waiting.append(pa.table({"q": pa.array(slot, pa.int64()), "e": ids.take(found), "s": pa.array(score[pair]), **{c: column(f"e_{c}").take(found) for c in carry}}))
                            if sum(t.num_rows for t in waiting) >= search.WAITING:
                                settle()
                np.minimum.reduceat(low.reshape(-1, n).min(axis=1)[order], begins, out=least)
        if block is not None:
            yield from rows()

    q = jobs.select(F.col(by[0]).alias("ids"), "vector", *[F.col(c).alias(o) for c, o in zip(by, own)], "target_vector", "seed")
    together = [F.xxhash64("vector"), *own]
    q = q.repartitionByRange(*together).sortWithinPartitions(*together)
    e = entries.select(F.col(entry_col).alias("ids"), "vector", *carry)
    met = search.met(search.packed(q, ("ids", *own, "target_vector", "seed"), 2 * search.QUERY_BLOCK), search.packed(e, ("ids", *carry)), run, ddl)
    best = met.groupBy(*by, "rho").agg(F.min(F.struct((-F.col("score")).alias("down"), entry_col, *carry)).alias("b"))
    return best.select(*by, "rho", f"b.{entry_col}", (-F.col("b.down")).alias("score"), *[f"b.{c}" for c in carry])


def sweep_jobs(targets: DataFrame, neighbors: DataFrame, radii: list[float]) -> DataFrame:
    """(target, subject, role, rho): each target and its neighbours under the target's manifest at every radius."""
    own = targets.select(F.col("fact").alias("target"), F.col("fact").alias("subject"), F.lit("target").alias("role"))
    near = neighbors.join(targets, "fact", "left_semi").select(F.col("fact").alias("target"), F.col("neighbor").alias("subject"), F.lit("neighbor").alias("role"))
    return own.unionByName(near).withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in radii])))


def distinct_runs(jobs: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(subject, fingerprint): what must be generated; equal manifests of one subject share a run.

    fingerprints: target, rho, fingerprint.
    """
    return jobs.join(fingerprints, ["target", "rho"]).select("subject", "fingerprint").distinct()


def entanglement_curve(sweep: DataFrame, neighbors: DataFrame, full_correct: DataFrame) -> DataFrame:
    """(target, rho, efficacy, collateral, neighbor_count, neighbors_observed, neighbors_full_correct, gap_term).

    sweep: target, rho, role, subject, correct (the last row wins upstream). Targets that are wrong under FULL are left
    out; only neighbours right under FULL can break; collateral is over all neighbours, 0 without any. All of a target's
    neighbours that are right under FULL count as neighbors_full_correct, observed at a radius or not.
    """
    right = full_correct.select(F.col("fact").alias("subject"), F.lit(True).alias("was_right")).distinct()
    rows = sweep.join(right.select(F.col("subject").alias("target")), "target", "left_semi").join(right, "subject", "left")
    known = neighbors.select(F.col("fact").alias("target"), F.col("neighbor").alias("subject")).distinct().join(right, "subject", "left")
    sizes = known.groupBy("target").agg(F.count("*").alias("neighbor_count"), F.count("was_right").alias("neighbors_full_correct"))
    near = F.col("role") == "neighbor"
    was = F.coalesce(F.col("was_right"), F.lit(False))
    sums = rows.groupBy("target", "rho").agg(
        F.max(F.when(F.col("role") == "target", (~F.col("correct")).cast("double"))).alias("efficacy"),
        F.count_distinct(F.when(near, F.col("subject"))).alias("neighbors_observed"),
        F.count_distinct(F.when(near & was & ~F.col("correct"), F.col("subject"))).alias("broken"),
    )
    out = sums.where("efficacy is not null").join(sizes, "target", "left").na.fill(0, ["neighbor_count", "neighbors_full_correct"])
    out = out.withColumn("collateral", F.when(F.col("neighbor_count") > 0, F.col("broken") / F.col("neighbor_count")).otherwise(F.lit(0.0)))
    return out.select("target", "rho", "efficacy", "collateral", "neighbor_count", "neighbors_observed", "neighbors_full_correct", ((1 - F.col("efficacy")) + F.col("collateral")).alias("gap_term"))


def entanglement_gap(curve: DataFrame) -> DataFrame:
    """(target, gap, gap_rho, gap_eligible): the least gap term over the radii, ties to the largest; null without neighbours."""
    best = curve.groupBy("target").agg(F.min(F.struct("gap_term", (-F.col("rho")).alias("down"))).alias("b"), F.max("neighbor_count").alias("n"))
    ok = F.col("n") > 0
    return best.select("target", F.when(ok, F.col("b.gap_term")).alias("gap"), F.when(ok, -F.col("b.down")).alias("gap_rho"), ok.alias("gap_eligible"))


def entanglement_rollup(curve: DataFrame) -> DataFrame:
    """Mean efficacy and collateral per radius."""
    return curve.groupBy("rho").agg(F.count("*").alias("targets"), F.avg("efficacy").alias("mean_efficacy"), F.avg(F.when(F.col("neighbor_count") > 0, F.col("collateral"))).alias("mean_collateral"))


def rollup(curve: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per radius the means of the curve, each row with the study's eligible targets and their gap shares."""
    return entanglement_rollup(curve).crossJoin(F.broadcast(gap_shares(gaps)))  # one row


def gap_shares(gaps: DataFrame) -> DataFrame:
    """Over eligible targets: how many, the share without a gap and the share with a gap of at least one."""
    ok = F.col("gap_eligible")
    return gaps.agg(F.count_if(ok).alias("eligible"), F.avg(F.when(ok, (F.col("gap") == 0).cast("double"))).alias("share_zero"), F.avg(F.when(ok, (F.col("gap") >= 1).cast("double"))).alias("share_one"))
