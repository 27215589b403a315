"""Exact top-k inner-product search by term-at-a-time accumulation.

Every vector is a sparse row: its terms are the positions of its non-zero integer components. Candidates stay where
they are read. A task turns each block of candidate rows into postings (per term: row numbers and weights); each
query row then scatters its weighted postings into a dense score array over the block. A partition selection keeps
the k best rows of each query in the task, and the tasks' partial lists are merged by query.

Queries travel to the tasks in blocks of at most `block` rows, a bound that doesn't grow with the table; each further
block is a further pass over the candidates, whose partial lists are written before the next block is fetched.

Weights are integers of any size. Rows whose scores could pass a long in the arrays are scored by Python's integers
beside them; a score that is no long can't be returned and is an error if it is among the k best.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import scratch_dir, stored

#: Query rows sent to the tasks at once: 16384 rows of 64 terms are 8 MB.
QUERY_BLOCK = 16_384
#: Candidate rows and query rows of one dense score array (256 x 4096 x 8 bytes = 8 MB).
CANDIDATES, TILE = 4096, 256
#: These stand for scores that are no long: greater ones and lesser ones.
TOP, BOTTOM = (1 << 63) - 1, -(1 << 63) + 1


def quantize(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double that holds an integer, x as double; scale is a power of two, so
    this is exact unless the product passes the greatest double."""
    def one(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(scaled) < F.lit(float(1 << 52)), F.floor(scaled).cast("double")).otherwise(scaled)  # beyond 2^52 a double is an integer

    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold only finite components."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _narrow(rows: list[np.ndarray]) -> np.ndarray:
    """True for rows whose products with one another sum to less than 2^62, over the terms they have."""
    return np.array([not len(r) or np.abs(r).max() * (2 * len(r)) ** 0.5 < 2.0**30.5 for r in rows], bool)


def _exact(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """All inner products by Python's integers; those that are no long as TOP or BOTTOM."""
    def whole(rows):
        return [[int(x) for x in r] for r in rows]

    two = whole(two)
    return np.array([[max(BOTTOM, min(TOP, sum(a * b for a, b in zip(p, q)))) for q in two] for p in whole(one)], np.int64).reshape(len(one), len(two))


def _postings(rows: list[np.ndarray], narrow: np.ndarray) -> dict[int, tuple[np.ndarray | slice, np.ndarray]]:
    """Term to (row numbers, weights) of the narrow rows; a term that all rows have gets a slice, which needs no scatter."""
    width = max((len(r) for r, fits in zip(rows, narrow) if fits), default=0)
    dense = np.zeros((len(rows), width), np.int64)
    for i in np.flatnonzero(narrow):
        dense[i, : len(rows[i])] = rows[i]
    out = {}
    for term in range(width):
        at = np.flatnonzero(dense[:, term])
        if len(at):
            out[term] = (slice(None) if len(at) == len(rows) else at, dense[at, term])
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores with their ids, ties to the smaller id: selection of the k-th score, then a sort of few."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > floor)
        tied = np.flatnonzero(scores == floor)
        short = k - len(above)
        if len(tied) > short:
            tied = tied[np.argpartition(ids[tied], short - 1)[:short]] if short else tied[:0]
        keep = np.concatenate([above, tied])
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))
    return scores[order], ids[order]


def _search(queries: list[tuple[int, list[float]]], k: int):
    """The task's function: partial top-k lists of all queries over the rows it streams."""
    q_ids = np.array([q for q, _ in queries], np.int64)
    q_rows = [np.array(v, float) for _, v in queries]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = []
        for at in range(0, len(queries), TILE):
            own = q_rows[at : at + TILE]
            narrow = _narrow(own)
            tiles.append((at, own, narrow, _postings(own, narrow)))
        best: list = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]
        for batch in stream:
            for start in range(0, batch.num_rows, CANDIDATES):
                block = batch.slice(start, CANDIDATES)
                ids = np.asarray(block.column(0).to_numpy(zero_copy_only=False), np.int64)
                lists = block.column(1)
                flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                rows = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                fits = _narrow(rows)
                wide = np.flatnonzero(~fits)
                postings = _postings(rows, fits)
                for at, own, narrow, terms in tiles:
                    scores = np.zeros((len(own), len(ids)), np.int64)
                    for term, (who, weights) in terms.items():
                        if term not in postings:
                            continue
                        which, values = postings[term]
                        if isinstance(which, slice) and isinstance(who, slice):
                            scores += weights[:, None] * values[None, :]
                        elif isinstance(which, slice):
                            scores[who] += weights[:, None] * values[None, :]
                        elif isinstance(who, slice):
                            scores[:, which] += weights[:, None] * values[None, :]
                        else:
                            scores[np.ix_(who, which)] += weights[:, None] * values[None, :]
                    if len(wide):
                        scores[:, wide] = _exact(own, [rows[j] for j in wide])
                    for i in np.flatnonzero(~narrow):
                        scores[i] = _exact([own[i]], rows)[0]
                    for i in range(len(own)):
                        q = at + i
                        other = ids != q_ids[q]
                        s, c = _best(scores[i], ids, k) if other.all() else _best(scores[i][other], ids[other], k)
                        s0, c0 = best[q]
                        best[q] = _best(np.concatenate([s0, s]), np.concatenate([c0, c]), k) if len(s0) else (s, c)
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([c for _, c in best])), pa.array(np.concatenate([s for s, _ in best]))],
                names=["query_id", "vec_id", "score"],
            )

    return run


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): each query's k best candidates other than rows of its own id.

    Vectors that are null or hold a null or non-finite component take no part on either side, nor do rows with a null
    id; finite components take part whatever their size. A score among the k best that is no long (or is the greatest or
    least long itself) raises an error. Vectors of unlike lengths meet in the terms both have; an empty vector scores 0
    everywhere. Repeated candidate rows are ranked each; a repeated query row is one query (the first by vector). Fewer
    candidates than k: all of them. Other columns are not read.
    """
    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", quantize(F.col("v"), scale).alias("v"))

    spark, target = queries.sparkSession, rows(candidates)
    ddl = "query_id long, vec_id long, score long"
    asked = rows(queries).groupBy("id").agg(F.min("v").alias("v"))
    fetch = lambda df: sorted((r.id, list(r.v)) for r in df.collect())
    n = asked.count()
    if n == 0:
        merged = spark.createDataFrame([], ddl)
    elif n <= block:
        merged = target.mapInArrow(_search(fetch(asked), k), ddl)
    else:  # one block after the other, so the driver never holds more than one
        parts = -(-2 * n // block)
        asked = stored(asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts))), "topk-queries")
        path = f"{scratch_dir(spark)}/topk-lists-{uuid.uuid4().hex}"
        for i in range(parts):
            own = fetch(asked.where(F.col("b") == i))
            for at in range(0, len(own), block):
                target.mapInArrow(_search(own[at : at + block], k), ddl).write.mode("append").parquet(path)
        merged = spark.read.schema(ddl).parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    top = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    fits = F.when(F.col("score").isin(TOP, BOTTOM), F.raise_error(F.lit("a score is no long")).cast("long")).otherwise(F.col("score"))
    return top.select("query_id", "rank", "vec_id", fits.alias("score"))
