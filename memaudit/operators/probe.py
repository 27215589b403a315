"""Representation probe: group-disjoint folds, ridge regression from summed Gramians, ranking and classification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memaudit.functions import text as T

from .joins import hot_join
from .scratch import stored


@dataclass(frozen=True)
class ProbeConfig:
    mode: str = "ranking"
    folds: int = 5
    seed: int = 0
    ridge_lambda: float = 1.0
    feature_dim: int = 2048
    fold_order: str = "hash"

    def __post_init__(self):
        if self.mode not in ("ranking", "classification") or self.folds < 2 or self.ridge_lambda <= 0:
            raise ValueError("mode is ranking or classification, folds at least 2, ridge_lambda positive")
        if self.fold_order not in ("hash", "seeded"):
            raise ValueError("fold_order is hash (distributed) or seeded (numpy's shuffle, on the driver)")


#: Bytes that the weights of all folds, or the answers' features, may take on the driver and in a task.
MATRIX_BYTES = 1 << 30
#: Rows whose answers a task expands at once, answers it scores at once, rows it scores at once, bytes of class sums it holds.
SUM_ROWS, ANSWER_BLOCK, SCORE_ROWS, SUM_BYTES = 256, 4_096, 64, 64 << 20
#: Groups that the seeded shuffle may order on the driver.
SEEDED_GROUPS = 1_000_000
#: Labelled facts below which an audit's outputs aren't probed.
LEAST_FACTS = 4


def assign_group_folds(groups: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """(group, fold): folds of near equal numbers of groups, by the place of a group in a seeded order. Distributed.

    The order is by a hash of seed and group; places come from ranks within hash ranges plus the ranges' offsets, so no
    single task sees all groups.
    """
    marked = groups.select("group").distinct().withColumn("h", F.xxhash64(F.lit(seed), "group")).withColumn("range", F.shiftright("h", 52))
    sizes = marked.groupBy("range").agg(F.count("*").alias("n"))
    starts = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    placed = marked.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("h", "group"))).join(F.broadcast(starts), "range")
    return placed.select("group", F.pmod(F.col("start") + F.col("place") - 1, F.lit(folds)).cast("int").alias("fold"))


def shuffled_group_folds(groups: list[str], folds: int, seed: int = 0) -> dict[str, int]:
    """The same on the driver by numpy's generator: sorted groups, shuffled by the seed, dealt round."""
    order = sorted(groups)
    np.random.default_rng(seed).shuffle(order)
    return {g: i % folds for i, g in enumerate(order)}


def ridge_fit(x: np.ndarray, y: np.ndarray, lam: float) -> np.ndarray:
    """W that solves (X'X + lam I) W = X'Y."""
    return np.linalg.solve(x.T @ x + lam * np.eye(x.shape[1]), x.T @ y)


def _scores(rows: np.ndarray, starts: np.ndarray, features: np.ndarray, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Inner products of rows with sparse answers, ANSWER_BLOCK of them at once: (first answer, rows x answers)."""
    for at in range(0, len(starts) - 1, ANSWER_BLOCK):
        cut = starts[at : at + ANSWER_BLOCK + 1]
        own = slice(cut[0], cut[-1])
        yield at, np.add.reduceat(rows[:, features[own]] * weights[own], cut[:-1] - cut[0], axis=1)


def _best(rows: np.ndarray, starts: np.ndarray, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each row's best answer; of equal ones the first."""
    top, place = np.full(len(rows), -np.inf), np.zeros(len(rows), "int64")
    for at, found in _scores(rows, starts, features, weights):
        own = found.argmax(1)
        value = found[np.arange(len(rows)), own]
        better = value > top
        top[better], place[better] = value[better], at + own[better]
    return place


def _summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial vectors (keys, value) of tasks to their sums; a key has at most a few partial vectors a task."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1].assign(value=[np.sum(np.stack(frame["value"]), 0)])

    return parts.groupBy(*keys).applyInPandas(add, parts.schema)


def gram_sums(rows: DataFrame, d: int, k: int) -> DataFrame:
    """(fold, i, value): per fold row i of X'X and, after it, of X'Y; rows: fold, vector of d numbers, features and weights
    of the row's sparse y, of k numbers. A task holds one matrix of d x (d + k) a fold, whatever the number of answers."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict[int, np.ndarray] = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                held = own.setdefault(int(fold), np.zeros((d, d + k)))
                for at in range(0, len(part), SUM_ROWS):
                    cut = part.iloc[at : at + SUM_ROWS]
                    x, y = np.stack(cut["vector"]), np.zeros((len(cut), k))
                    held[:, :d] += x.T @ x
                    if k:
                        y[np.repeat(np.arange(len(cut)), cut["features"].map(len)), np.concatenate(list(cut["features"]))] = np.concatenate(list(cut["weights"]))
                        held[:, d:] += x.T @ y
        for fold, held in own.items():
            yield pd.DataFrame({"fold": fold, "i": range(d), "value": list(held)})

    parts = rows.select("fold", "vector", *["features", "weights"] * bool(k)).mapInPandas(sums, "fold int, i int, value array<double>")
    return _summed(parts, ["fold", "i"])


def class_sums(rows: DataFrame) -> DataFrame:
    """(fold, answer_norm, value): the sum of an answer's vectors in a fold. A task passes its sums on when they hold
    SUM_BYTES."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: dict = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([(int(f), a, v) for (f, a), v in own.items()], columns=["fold", "answer_norm", "value"])
            own.clear()
            return frame

        for frame in frames:
            for key, part in frame.groupby(["fold", "answer_norm"]):
                own[key] = own.get(key, 0) + np.stack(part["vector"]).sum(0)
                if len(own) * 8 * len(own[key]) > SUM_BYTES:
                    yield out()
        if own:
            yield out()

    parts = rows.select("fold", "answer_norm", "vector").mapInPandas(sums, "fold int, answer_norm string, value array<double>")
    return _summed(parts, ["fold", "answer_norm"])


def _folds(truth: DataFrame, config: ProbeConfig, fold_groups: DataFrame | None) -> tuple[DataFrame, int]:
    """(fact, group, group_size, fold) and the number of folds, at most one a group; a fact without a group is its own."""
    facts = truth.select(F.col("fact").cast("string").alias("fact")).distinct()
    if fold_groups is None:
        placed = facts.withColumn("group", F.col("fact"))
    else:
        given = fold_groups.select(F.col("fact").cast("string").alias("fact"), F.col("group").cast("string").alias("group")).dropDuplicates(["fact"])
        placed = facts.join(given, "fact", "left").withColumn("group", F.coalesce("group", "fact"))
    sizes = placed.groupBy("group").agg(F.count("*").alias("group_size"))
    n = sizes.count()
    if n < 2:
        raise ValueError(f"the probe needs at least two groups, not {n}")
    folds = min(config.folds, n)
    if config.fold_order == "hash":
        dealt = assign_group_folds(sizes, folds, config.seed)
    elif n <= SEEDED_GROUPS:
        seeded = shuffled_group_folds([r["group"] for r in sizes.select("group").collect()], folds, config.seed)
        dealt = truth.sparkSession.createDataFrame(list(seeded.items()), "group string, fold int")
    else:
        raise ValueError(f"{n} groups are too many for the seeded order; take fold_order='hash'")
    return placed.join(sizes, "group").join(dealt, "group"), folds


def run_probe(samples: DataFrame, labels: DataFrame, config: ProbeConfig = ProbeConfig(), fold_groups: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(per fact: fact, answer, fold, fold_group, fold_group_size, samples, predicted, label_unseen, l_rep; summary).

    samples: sample_id, fact, vector; labels: fact, ground_truth, aliases (or none). fold_groups: fact, group; a fact
    without one is a group of its own, and a fact's samples share a fold. Vectors are L2-normalised, zero ones dropped.
    Candidates are the distinct normal forms of the answers. Ranking: they travel as sparse features, so that millions fit
    the bound in bytes; X'X and X'Y of a fold are summed on executors, and the driver gets d x (d + feature_dim) numbers a
    fold. Classification: a class is a column of W, so classes x d x folds numbers must fit the bound.
    W of a fold comes from the total less the fold's sums. A label is unseen if all its rows are in the fact's fold.
    """
    from .search import unit_rows

    spark = samples.sparkSession
    more = F.col("aliases") if "aliases" in labels.columns else None
    truth = labels.withColumn("answer_norm", T.norm(F.col("ground_truth"))).withColumn("answer_norms", T.norm_set(F.col("ground_truth"), more)).where(F.col("answer_norm") != "")
    candidates = truth.groupBy("answer_norm").agg(F.min("ground_truth").alias("answer")).orderBy("answer_norm")
    n_candidates = candidates.count()
    vectors = unit_rows(samples.withColumn("__s", F.struct("sample_id", "fact")), "__s", "vector").select("__s.*", "vector")
    own = vectors.join(truth.select("fact", "answer_norm"), "fact")
    total = samples.count()
    lead = own.first()
    shape = {"mode": config.mode, "seed": config.seed, "ridge_lambda": config.ridge_lambda, "feature_dim": config.feature_dim}
    if lead is None:
        empty = spark.createDataFrame([], "fact string, answer string, fold int, fold_group string, fold_group_size long, samples long, predicted string, label_unseen boolean, l_rep double")
        return empty, shape | {"folds": config.folds, "facts": 0, "fold_groups": 0, "largest_fold_group": 0, "samples": 0, "samples_dropped_no_label": total, "candidates": n_candidates, "label_unseen_count": 0, "l_rep_hat": None}
    ranking = config.mode == "ranking"
    width = config.feature_dim if ranking else n_candidates
    d = len(lead["vector"])
    if ranking:  # a candidate's name, its features and their weights
        candidates = stored(candidates.withColumn("f", T.answer_features(F.col("answer"), config.feature_dim)).select("answer_norm", F.col("f.feature").alias("features"), F.col("f.weight").alias("weights")), "probe-candidates")
        held = candidates.agg(F.sum(F.octet_length("answer_norm") + 16 * F.size("features") + 16)).first()[0]
    else:
        held = 0
    if max(8 * config.folds * (d * d + d * width), held) > MATRIX_BYTES:
        raise ValueError("the probe's matrices are too large; lower feature_dim, or have fewer distinct answers")
    folds, n_folds = _folds(truth.join(vectors.select("fact").distinct(), "fact", "left_semi"), config, fold_groups)
    folds = stored(folds, "probe-folds")
    rows = stored(own.withColumn("__f", F.col("fact").cast("string")).join(folds.select(F.col("fact").alias("__f"), "fold"), "__f").drop("__f"), "probe-rows")
    spread = stored(rows.groupBy("answer_norm").agg(F.count("*").alias("rows"), F.lit(1).alias("one"), F.count_distinct("fold").alias("folds")), "probe-answers")
    cand = candidates.orderBy("answer_norm").toArrow().combine_chunks()
    names = cand["answer_norm"].combine_chunks()
    if ranking:
        counts = np.array([len(x) for x in cand["features"].to_numpy()], "int64")
        answers = (np.concatenate([[0], np.cumsum(counts)]), np.concatenate(list(cand["features"].to_numpy())).astype("int64"), np.concatenate(list(cand["weights"].to_numpy())))
        trained = gram_sums(hot_join(rows, candidates.join(spread, "answer_norm"), "answer_norm", ("rows", "one"), ("fact", "answer_norm"), "answer_norm"), d, width)
    else:
        answers, trained = None, gram_sums(rows, d, 0)
    total_of = {f: np.zeros((d, d + width)) for f in range(n_folds)}
    got = trained.toArrow()
    for fold, i, value in zip(got["fold"].to_pylist(), got["i"].to_pylist(), got["value"].to_numpy()):
        total_of[fold][i, : len(value)] = value
    if not ranking:
        at, got = {n: i for i, n in enumerate(names.to_pylist())}, class_sums(rows).toArrow()
        for fold, name, value in zip(got["fold"].to_pylist(), got["answer_norm"].to_pylist(), got["value"].to_numpy()):
            total_of[fold][:, d + at[name]] = value
    everything = sum(total_of.values())
    # A fold's weights are solved where they are used: tasks have one BLAS thread, the driver shares its with the gateway.
    sums_of = {f: (everything[:, :d] - own[:, :d] + config.ridge_lambda * np.eye(d), everything[:, d:] - own[:, d:]) for f, own in total_of.items()}
    sent = spark.sparkContext.broadcast((sums_of, answers, names))

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solvable, answers, labels_ = sent.value
        solved: dict = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                if fold not in solved:
                    solved[fold] = np.linalg.solve(*solvable[int(fold)])
                there = np.stack(part["vector"]) @ solved[fold]
                best = there.argmax(1) if answers is None else np.concatenate([_best(there[at : at + SCORE_ROWS], *answers) for at in range(0, len(there), SCORE_ROWS)])
                yield pd.DataFrame({"fact": part["fact"].astype(str), "fold": int(fold), "predicted": labels_.take(best).to_pylist()})

    guesses = rows.select("fact", "fold", "vector").mapInPandas(predict, "fact string, fold int, predicted string")
    keyed = truth.select(F.col("fact").cast("string").alias("fact"), "ground_truth", "answer_norm", "answer_norms")
    marked = guesses.join(keyed, "fact").withColumn("hit", F.array_contains("answer_norms", F.col("predicted")).cast("double"))
    per_fact = marked.groupBy("fact", "fold", "answer_norm").agg(F.first("ground_truth").alias("answer"), F.count("*").alias("samples"), F.mode("predicted").alias("predicted"), F.avg("hit").alias("l_rep"))
    per_fact = hot_join(per_fact, spread, "answer_norm", ("rows", "one"), ("fact", "answer_norm"), "answer_norm").withColumn("label_unseen", F.col("folds") == 1)
    placed = folds.select("fact", F.col("group").alias("fold_group"), F.col("group_size").alias("fold_group_size"))
    per_fact = per_fact.join(placed, "fact").select("fact", "answer", "fold", "fold_group", "fold_group_size", "samples", "predicted", "label_unseen", "l_rep")
    s = per_fact.agg(F.count("*"), F.sum("samples"), F.avg("l_rep"), F.count_if("label_unseen"), F.count_distinct("fold_group"), F.max("fold_group_size")).first()
    summary = shape | {"folds": n_folds, "facts": s[0], "fold_groups": s[4], "largest_fold_group": s[5], "samples": s[1] or 0, "samples_dropped_no_label": total - (s[1] or 0), "candidates": n_candidates, "label_unseen_count": s[3], "l_rep_hat": s[2]}
    return per_fact, summary


def control_probe(name: str, samples: DataFrame, labels: DataFrame, behavior: DataFrame, config: ProbeConfig = ProbeConfig(), fold_groups: DataFrame | None = None, split: str | None = None) -> tuple[DataFrame, dict]:
    """The probe on another representation: per fact and summary, both marked with the representation and the split, the
    summary with the mean behaviour and the difference. behavior: fact_id, behavioral_l."""
    from .metrics import delta_rep

    per_fact, summary = run_probe(samples, labels, config, fold_groups)
    split = split or ("fact" if fold_groups is None else "group")
    lived = behavior.select(F.col("fact_id").cast("string").alias("fact_id"), "behavioral_l")
    delta = delta_rep(per_fact.withColumnRenamed("fact", "fact_id"), lived).first()
    summary = {"representation": name, "split": split} | summary | {"facts_common": delta["facts_common"], "l_hat": delta["l_hat"], "delta_rep": delta["delta_rep"]}
    rows = per_fact.join(lived.withColumnRenamed("fact_id", "fact"), "fact", "left")
    return rows.select(F.lit(name).alias("representation"), F.lit(split).alias("split"), *rows.columns), summary


def probe_audit_outputs(results: DataFrame, samples: DataFrame, path: str, config: ProbeConfig = ProbeConfig(), fold_groups: DataFrame | None = None) -> dict | None:
    """Probe a finished audit: per fact and summary as CSV under path, the summary returned; None, and nothing written,
    where fewer facts than max(LEAST_FACTS, folds) have both a label and a vector.

    results: result rows, of which the first ground truth of a fact is its label (another one is an error).
    """
    from memaudit.sources.files import union_by_name, write_csv, write_rows

    from .metrics import behavioral_mean, gold_labels

    labels = stored(gold_labels(results).withColumnRenamed("fact_id", "fact"), "probe-labels")
    known = samples.select("fact").distinct().join(labels.select("fact"), "fact", "left_semi").count()
    if known < max(LEAST_FACTS, config.folds):
        return None
    per_fact, summary = control_probe("query", samples, labels, behavioral_mean(results), config, fold_groups)
    write_csv(union_by_name(per_fact.drop("representation", "split")), f"{path}/probe_per_fact", True)
    write_rows(samples.sparkSession, [summary], f"{path}/probe_summary")
    return summary


def hashed_prompt_vectors(prompts: DataFrame, dim: int = 512, id_col: str = "fact", text_col: str = "prompt") -> DataFrame:
    """(id_col, vector): signed hashing of a prompt's words and pairs of words, L2-normalised; the control representation.

    Of a gram's md5 the first four bytes, as a little-endian number modulo dim, are its place; the fifth, if odd, a plus.
    """
    t = T.tokens(F.col(text_col))
    rows = prompts.select(F.col(id_col), t.alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.concat_ws("_", F.get("t", i), F.get("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(id_col, F.explode(F.concat("t", pairs)).alias("g")).withColumn("m", F.md5("g"))
    number = lambda h: F.conv(h, 16, 10).cast("long")
    place = number(F.concat(*[F.substring("m", at, 2) for at in (7, 5, 3, 1)])) % dim
    sign = F.when(number(F.substring("m", 10, 1)) % 2 == 1, 1.0).otherwise(-1.0)
    cells = rows.select(id_col, place.cast("int").alias("i"), sign.alias("s")).groupBy(id_col, "i").agg(F.sum("s").alias("s"))
    found = cells.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("i", "s"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    from memaudit.functions.vectors import normalized

    return found.select(id_col, dense.alias("v")).select(id_col, normalized(F.col("v")).alias("vector")).where("vector is not null")
