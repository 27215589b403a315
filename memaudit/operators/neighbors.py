"""Neighbours of facts: by cosine of their query vectors, or by a common source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vector_index
from .search import nearest


@dataclass(frozen=True)
class NeighborConfig:
    mode: str = "cosine"
    ball: float = 0.5
    cap: int = 20
    min_count: int = 0

    def __post_init__(self):
        if self.mode not in ("cosine", "same-source"):
            raise ValueError("mode must be cosine or same-source")
        if self.cap < 1 or not 0 <= self.min_count <= self.cap:
            raise ValueError("cap must be at least 1, min_count between 0 and cap")


def cosine_neighbors(facts: DataFrame, config: NeighborConfig = NeighborConfig(), index: vector_index.VectorIndex | None = None) -> DataFrame:
    """(fact, neighbor, cosine, within_ball, rank): the ranking by cosine, then id, cut at min(cap, max(min_count, in ball)).

    facts: fact, vector (unit). A task keeps cap + 1 pairs a fact (its own among them), so no square is ever made. With an
    index of the facts (its entries called neighbor) only its cells in reach are scored.
    """
    floor, k = config.ball if config.min_count == 0 else -2.0, config.cap + 1
    best = nearest(facts, facts.withColumnRenamed("fact", "neighbor"), k, floor, "fact", "neighbor") if index is None else vector_index.nearest(facts, index, k, floor)[0]
    best = best.where("fact <> neighbor")
    mine = Window.partitionBy("fact")  # of at most cap + 1 rows
    rows = best.withColumn("rank", F.row_number().over(mine.orderBy(F.col("score").desc(), "neighbor"))).where(F.col("rank") <= config.cap)
    # Of more facts in the ball than cap only cap are ever kept, so they may be counted among these rows.
    rows = rows.withColumn("within_ball", F.col("score") >= config.ball).withColumn("n", F.count_if(F.col("within_ball")).over(mine))
    keep = F.col("rank") <= F.greatest(F.lit(config.min_count), F.col("n"))
    return rows.where(keep).select("fact", "neighbor", F.col("score").alias("cosine"), "within_ball", "rank")


def same_source_neighbors(facts: DataFrame, cap: int = 20) -> DataFrame:
    """(fact, neighbor, rank): others of the same source in key order, at most cap; a null source has none.

    A fact's neighbours are the first cap + 1 keys of its source less itself, so a source is cut to its first cap + 1 keys
    before the join: a source with a third of all facts makes no square.
    """
    first = facts.where("source_id is not null").withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy("fact"))).where(F.col("place") <= cap + 1)
    others = first.select("source_id", F.col("fact").alias("neighbor"), "place")
    own = first.select("source_id", "fact", F.col("place").alias("own"))
    pairs = facts.select("fact", "source_id").join(others, "source_id").where("fact <> neighbor").join(own, ["source_id", "fact"], "left")
    return pairs.withColumn("rank", F.col("place") - (F.col("own").isNotNull() & (F.col("own") < F.col("place"))).cast("int")).where(F.coalesce(F.col("rank"), F.col("place")) <= cap).select("fact", "neighbor", F.coalesce("rank", "place").alias("rank"))
