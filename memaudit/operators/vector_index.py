"""An exact vector index: entries in cells around centroids, cut into shells by their angle to the centroid.

Of unit vectors, a query at angle a to a centroid is at least a - high from all entries of a shell that lie at most
`high` from it, and at least low - a from those at least `low` away (triangle inequality on the sphere). A shell whose
bound is below a query's k-th score, or below the floor, therefore holds nothing for it. A search visits each query's
best shells first, which gives its k-th score so far, and then all shells whose bound reaches that score; what it returns
is what an exhaustive search returns, however well or badly the cells fit.

Centroids are fitted on a bounded sample (SAMPLE rows); every entry is indexed. Entries are stored in blocks by shell.
Queries meet shells as blocks too (search.met): neither side is collected, broadcast or repeated per visit, only the
centroids and the table of shells are broadcast, whose sizes are parameters (at most CELLS x dimension and CELLS x SHELLS
numbers).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import stored
from .search import SLACK, best_held, block_pairs, met, over, packed, scores, top_k

#: Cells at most; fewer for small tables (the square root of the entries).
CELLS = 1024
#: Shells of a cell.
SHELLS = 8
#: Rows on which centroids are fitted, chosen by a hash of the id.
SAMPLE = 100_000
#: Bytes of vectors in a block, and rows at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4096
#: Rows that wait for a merge into the best of a block of queries.
WAITING = 100_000
#: Angles are compared with this slack, which covers the rounding of arccos near 0.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """centroids: one row a cell. shells: shell, cell, low, high, n, parts. blocks: shell, part, ids, flat (vectors end to end)."""

    centroids: np.ndarray
    shells: pa.Table
    blocks: DataFrame
    entry_col: str

    @property
    def n_entries(self) -> int:
        return int(sum(self.shells["n"].to_pylist()))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Vectors of a list column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _lloyd(sample: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids moved to the mean direction of the sample rows nearest to them; a cell without rows keeps its own."""
    k, dim = centroids.shape
    schema = pa.schema([("cell", pa.int32()), ("total", pa.list_(pa.float64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros((k, dim)), np.zeros(k, bool)
        for b in stream:
            if b.num_rows:
                x = _matrix(b.column(0), b.num_rows)
                cell = (x @ centroids.T).argmax(1)
                np.add.at(totals, cell, x)
                seen[cell] = True
        for c in np.flatnonzero(seen):  # a row at a time: a task's k x dim numbers may be many megabytes
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([totals[c].tolist()], pa.list_(pa.float64()))], schema=schema)

    sums = sample.select("vector").mapInArrow(run, "cell int, total array<double>").select("cell", F.posexplode("total").alias("at", "v")).groupBy("cell", "at").agg(F.sum("v").alias("v"))
    moved, out = sums.toArrow(), centroids.copy()  # at most k x dim numbers
    new = np.zeros_like(centroids)
    cells, at = moved["cell"].to_numpy(), moved["at"].to_numpy()
    new[cells, at] = moved["v"].to_numpy()
    good = np.unique(cells)
    out[good] = _unit(new)[good]
    return out


def build(entries: DataFrame, cells: int | None = None, shells: int = SHELLS, steps: int = 5, sample: int = SAMPLE, entry_col: str = "entry_id") -> VectorIndex:
    """The index of entries (entry_col, vector: unit, all of one length); every row is indexed, repeated ids each.

    An empty table gives an index without cells. cells is CELLS at most, and the square root of the entries if not given.
    """
    entries = entries.select(entry_col, "vector").where(F.col("vector").isNotNull())
    head = entries.agg(F.count("*"), F.max(F.size("vector")), F.min(F.size("vector"))).first()
    n, dim = head[0], head[1]
    kind = entries.schema[entry_col].dataType
    if not n:
        none = entries.sparkSession.createDataFrame([], f"shell int, part int, ids array<{kind.simpleString()}>, flat array<double>")
        return VectorIndex(np.zeros((0, 0)), _shell_table([]), none, entry_col)
    if head[2] != dim:
        raise ValueError(f"vectors of {head[2]} and {dim} components")
    k = max(1, min(cells or math.isqrt(n), CELLS, n))
    chance = min(1.0, max(sample, 4 * k) / n)
    h = F.xxhash64(F.lit(5), entry_col)
    taken = stored(entries.withColumn("h", h).where(F.pmod("h", F.lit(1 << 31)) < int(chance * (1 << 31))), "index-sample")
    first = taken.orderBy("h", entry_col).limit(k).select("vector").toArrow()
    if not first.num_rows:
        first = entries.orderBy(h, entry_col).limit(k).select("vector").toArrow()
    centroids = _matrix(first["vector"].combine_chunks(), first.num_rows)
    for _ in range(steps):
        centroids = _lloyd(taken, centroids)
    placed = stored(_assigned(entries, centroids, entry_col), "index-placed")
    cuts = [i / shells for i in range(1, shells)]
    edges = placed.groupBy("cell").agg(F.percentile_approx("angle", cuts, 1000).alias("edges")) if cuts else placed.select("cell", F.array().cast("array<double>").alias("edges")).distinct()
    numbered = placed.join(F.broadcast(edges), "cell")  # one row a cell
    shell = F.col("cell") * shells + F.size(F.filter("edges", lambda e: e < F.col("angle")))
    numbered = numbered.select(entry_col, "vector", "cell", "angle", shell.cast("int").alias("shell"))
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    table = numbered.groupBy("shell", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n"))
    table = table.withColumn("parts", F.ceil(F.col("n") / rows).cast("int"))
    known = _shell_table(sorted(tuple(r) for r in table.collect()))  # at most k x shells rows
    parts = entries.sparkSession.createDataFrame(list(zip(known["shell"].to_pylist(), known["parts"].to_pylist())), "shell int, parts int")
    dealt = numbered.join(F.broadcast(parts), "shell").withColumn("part", F.pmod(F.xxhash64(entry_col), "parts").cast("int"))
    return VectorIndex(centroids, known, stored(_blocks(dealt, ["shell", "part"], entry_col, "ids", "flat"), "index-blocks"), entry_col)


def _shell_table(rows: list[tuple]) -> pa.Table:
    names, kinds = ("shell", "cell", "low", "high", "n", "parts"), (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int32())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _assigned(entries: DataFrame, centroids: np.ndarray, entry_col: str) -> DataFrame:
    kind, shared = entries.schema[entry_col].dataType, entries.sparkSession.sparkContext.broadcast(centroids)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            for part in (b.slice(i, 2048) for i in range(0, b.num_rows, 2048)):
                dots = _matrix(part.column(1), part.num_rows) @ shared.value.T
                cell = dots.argmax(1)
                angle = np.arccos(np.clip(dots[np.arange(len(cell)), cell], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], names=[entry_col, "vector", "cell", "angle"])

    return entries.mapInArrow(run, f"{entry_col} {kind.simpleString()}, vector array<double>, cell int, angle double")


def _blocks(rows: DataFrame, by: list[str], id_col: str, ids: str, flat: str) -> DataFrame:
    """Rows of a block as one: their ids, and their vectors end to end."""
    held = rows.groupBy(*by).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "vector")).alias("held"))
    return held.select(*by, F.transform("held", lambda r: r["id"]).alias(ids), F.flatten(F.transform("held", lambda r: r["vector"])).alias(flat))


class _Bounds:
    """The greatest score that each shell can hold for each query; made in tasks from the broadcast index tables."""

    def __init__(self, index: VectorIndex):
        self.centroids = index.centroids
        self.shell, self.cell, self.low, self.high, self.n = (index.shells[c].to_numpy() for c in ("shell", "cell", "low", "high", "n"))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        angle = _angles(x, self.centroids)[:, self.cell]
        gap = np.maximum(angle - self.high, self.low - angle) - SLACK
        return np.cos(np.maximum(gap, 0.0))

    def first(self, x: np.ndarray, k: int, floor: float) -> np.ndarray:
        """For each query, whether a shell is among those of the best bounds that hold k entries, as far as they reach the floor."""
        bound = self(x)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & (bound >= floor)

    def over(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """For each query, whether a shell's bound reaches its score."""
        return self(x) >= score[:, None]


#: What a search visits: (bounds, vectors, each query's least score) to a query's shells, as booleans.
Choice = Callable[[_Bounds, np.ndarray, np.ndarray], np.ndarray]


def _chosen(choose: Choice, bounds: _Bounds, x: np.ndarray, least: np.ndarray) -> np.ndarray:
    return np.concatenate([choose(bounds, x[i : i + 256], least[i : i + 256]) for i in range(0, len(x), 256)])


def _bundled(index: VectorIndex) -> DataFrame:
    """The index's blocks end to end in rows of bounded size, as search.met() takes them: shells and sizes tell them apart."""
    kind = index.blocks.schema["ids"].dataType.elementType
    schema = pa.schema([("shells", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int64())), ("ids", pa.list_(to_arrow_type(kind))), ("flat", pa.list_(pa.float64())), ("bytes", pa.int64())])

    def whole(parts: list[tuple]) -> pa.RecordBatch:
        lists = [[p[0] for p in parts], [len(p[1]) for p in parts], pa.concat_arrays([p[1] for p in parts]), pa.concat_arrays([p[2] for p in parts])]
        values = [pa.array(v, t.type.value_type) if isinstance(v, list) else v for v, t in zip(lists, schema)]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([8 * len(values[3])], pa.int64())], schema=schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in stream:
            for i in range(b.num_rows):
                parts.append((b.column(0)[i].as_py(), b.column(1)[i].values, b.column(2)[i].values))
                size += 8 * len(parts[-1][2])
                if size >= BLOCK_BYTES:
                    yield whole(parts)
                    parts, size = [], 0
        if parts:
            yield whole(parts)

    return stored(index.blocks.select("shell", "ids", "flat").mapInArrow(run, f"shells array<int>, sizes array<long>, ids array<{kind.simpleString()}>, flat array<double>, bytes long"), "bundles")


def _met(queries: DataFrame, index: VectorIndex, bundles: DataFrame | None, choose: Choice, k: int | None, floor: float, query_col: str) -> DataFrame:
    """(query_col, entry_col, score) of visited shells: the k best of each query and part of the index, or all over the floor.

    queries: query_col, vector, least. Queries and shells meet as blocks (search.met), and what a query visits is chosen where
    it meets them: neither its vector nor its list of shells is written or shuffled per visit.
    """
    entry_col = index.entry_col
    q_kind, e_kind = queries.schema[query_col].dataType, index.blocks.schema["ids"].dataType.elementType
    ddl = f"{query_col} {q_kind.simpleString()}, {entry_col} {e_kind.simpleString()}, score double"
    if bundles is None:
        return queries.sparkSession.createDataFrame([], ddl)
    schema = pa.schema([(query_col, to_arrow_type(q_kind)), (entry_col, to_arrow_type(e_kind)), ("score", pa.float64())])
    shared = queries.sparkSession.sparkContext.broadcast(_Bounds(index))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, visits, held, low, waiting = None, None, None, None, None, []
        place = {int(s): i for i, s in enumerate(shared.value.shell)}

        def rows() -> Iterator[pa.RecordBatch]:
            if held is not None or waiting:
                q, e, s = (c.combine_chunks() for c in (best_held(held, pa.concat_tables(waiting), k, low) if waiting else held).columns)
                yield pa.RecordBatch.from_arrays([names.take(q), e, s], schema=schema)

        for name, column, x, y in block_pairs(stream):
            if name != block:
                yield from rows()
                least = column("q_least").to_numpy(zero_copy_only=False)
                block, names, held, low, waiting = name, column("q_ids"), None, np.maximum(least, floor), []
                visits = _chosen(choose, shared.value, x, least)
            es, end = column("e_ids"), 0
            for shell, size in zip(column("e_shells").to_pylist(), column("e_sizes").to_pylist()):
                start, end = end, end + size
                who = np.flatnonzero(visits[:, place[shell]])
                if not len(who):
                    continue
                for at, raw in scores(x[who], y[start:end]):
                    some = x[who], y[start + at : start + at + raw.shape[1]], raw
                    q, e, s = over(*some, low[who])
                    if k is not None and raw.shape[1] > k and len(q) > 4 * k * len(who):  # only the k best, with all that tie
                        q, e, s = over(*some, np.maximum(low[who], np.partition(raw, -k, axis=1)[:, -k] - SLACK))
                    if k is None:
                        for cut in range(0, len(q), 100_000):
                            part = slice(cut, cut + 100_000)
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(who[q[part]])), es.take(pa.array(e[part] + start + at)), pa.array(s[part])], schema=schema)
                    elif len(q):
                        waiting.append(pa.table({"q": pa.array(who[q], pa.int64()), "e": es.take(pa.array(e + start + at)), "s": pa.array(s)}))
                        if sum(t.num_rows for t in waiting) > WAITING:
                            held, waiting = best_held(held, pa.concat_tables(waiting), k, low), []
        yield from rows()

    asked = packed(queries.withColumnRenamed(query_col, "ids"), ("ids", "least"))
    return met(asked, bundles, run, ddl)


def _asked(queries: DataFrame, query_col: str) -> DataFrame:
    return queries.select(query_col, F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull() & F.col(query_col).isNotNull())


def nearest(queries: DataFrame, index: VectorIndex, k: int, min_score: float = -2.0, query_col: str = "fact") -> tuple[DataFrame, DataFrame]:
    """(query_col, entry, score, rank) as search.nearest() gives them, and (query_col, scored): the entries that each query met.

    queries: query_col (unique), vector (unit). Ties go to the smaller id; scores are rounded to 12 places.
    """
    queries = _asked(queries, query_col)
    least = queries.withColumn("least", F.lit(float(min_score)))
    bundles = _bundled(index) if index.n_entries else None
    begin = lambda bounds, x, s: bounds.first(x, k, min_score - SLACK)
    first = stored(top_k(_met(least, index, bundles, begin, k, min_score, query_col), k, (query_col,), index.entry_col), "met-first")
    kth = first.where(F.col("rank") == k).select(query_col, F.col("score").alias("least"))
    reach = stored(queries.join(kth, query_col, "left").withColumn("least", F.coalesce("least", F.lit(float(min_score)))), "reach")
    more = _met(reach, index, bundles, lambda bounds, x, s: bounds.over(x, s - 1e-9) & ~begin(bounds, x, s), k, min_score, query_col)
    best = top_k(first.drop("rank").unionByName(more), k, (query_col,), index.entry_col)
    return best, _scored(reach, index, lambda bounds, x, s: bounds.over(x, s - 1e-9) | begin(bounds, x, s), query_col)


def _scored(queries: DataFrame, index: VectorIndex, choose: Choice, query_col: str) -> DataFrame:
    """(query_col, scored): the entries of all shells that each query visits."""
    if not index.n_entries:
        return queries.select(query_col, F.lit(0).cast("long").alias("scored"))
    shared, kind = queries.sparkSession.sparkContext.broadcast(_Bounds(index)), queries.schema[query_col].dataType

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            if b.num_rows:
                visits = _chosen(choose, shared.value, _matrix(b.column(1), b.num_rows), b.column(2).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(visits @ shared.value.n, pa.int64())], names=[query_col, "scored"])

    return queries.select(query_col, "vector", "least").mapInArrow(run, f"{query_col} {kind.simpleString()}, scored long")


def score_pairs(queries: DataFrame, index: VectorIndex, min_score: float, query_col: str = "fact") -> DataFrame:
    """(query_col, entry, score) of all pairs at or over min_score, as search.score_pairs() gives them; streamed like those."""
    queries = _asked(queries, query_col).withColumn("least", F.lit(float(min_score)))
    bundles = _bundled(index) if index.n_entries else None
    return _met(queries, index, bundles, lambda bounds, x, s: bounds.over(x, s - 1e-9), None, min_score, query_col)


def write(index: VectorIndex, path: str) -> None:
    """The index as tables under path: centroids and shells (small), blocks; an index that is there is an error."""
    spark = index.blocks.sparkSession
    index.blocks.write.parquet(f"{path}/blocks")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    rows = list(zip(*(index.shells[c].to_pylist() for c in index.shells.column_names)))
    spark.createDataFrame(rows, "shell int, cell int, low double, high double, n long, parts int").coalesce(1).write.parquet(f"{path}/shells")


def read(spark: SparkSession, path: str, entry_col: str = "entry_id") -> VectorIndex:
    """An index that write() left; only its centroids and shells are read here."""
    cells = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    centroids = _matrix(cells["centroid"].combine_chunks(), cells.num_rows) if cells.num_rows else np.zeros((0, 0))
    shells = _shell_table(sorted(tuple(r) for r in spark.read.parquet(f"{path}/shells").select("shell", "cell", "low", "high", "n", "parts").collect()))
    return VectorIndex(centroids, shells, spark.read.parquet(f"{path}/blocks"), entry_col)


def entry_rows(index: VectorIndex) -> DataFrame:
    """The indexed entries (entry_col, vector), for whatever reads them as a table."""
    dim = index.centroids.shape[1] if index.n_entries else 1
    each = index.blocks.select(F.posexplode("ids").alias("at", index.entry_col), "flat")
    return each.select(index.entry_col, F.slice("flat", F.col("at") * dim + 1, dim).alias("vector"))
