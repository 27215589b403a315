"""Cohort retention: cells of compressed chunked bitmaps over dense client numbers.

Clients with a start are numbered densely in the order of segment, cohort and id (range partition, carried counts), so a
cell's users lie in few chunks of 1,024 numbers. Every known event of such a client sets a bit of its cell (state,
segment, cohort, period) in the client's chunk. Tasks combine events into one container per cell and chunk - the set
bits as 16-bit numbers, or a plain bitmap where that is shorter - before anything is shuffled; what many tasks made of one
cell and chunk is united in groups of tasks. Containers of a chunk's cells then meet sorted by cell, beside the chunk's
table, and are OR-merged as a stream. Users are population counts; users that moved between cohorts are the
intersection with a bitmap made of the chunk's state bitmaps; crc32 sums look the set bits up in the chunk's table.
A chunk's results are added up by cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import batches, stored
from .scan import running

CHUNK_BITS = 10
CHUNK = 1 << CHUNK_BITS
#: A chunk's cells are dealt by hash over so many parts, each with the chunk's table.
PARTS = 16
#: Containers of a cell and chunk are united in so many groups of tasks, then those of the groups.
PIECES = 16
DAY = 86_400_000_000
#: Events that a task combines at a time: bounded memory, and one row per cell and chunk of them leaves it.
COMBINE = 1 << 19
_CELLS = "chunk long, kind int, state int, segment string, cohort long, period long, bits binary, cents long"
_CELLS_ARROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("state", pa.int32()), ("segment", pa.string()), ("cohort", pa.int64()), ("period", pa.int64()), ("bits", pa.binary()), ("cents", pa.int64())])


def pack(bits: np.ndarray) -> bytes:
    """Distinct ascending bit numbers as a container: an array up to 64 bits, then a bitmap of 128 bytes."""
    if len(bits) <= CHUNK // 16:
        return bits.astype("<u2").tobytes()
    mask = np.zeros(CHUNK, np.uint8)
    mask[bits] = 1
    return np.packbits(mask).tobytes() + b"\1"  # an odd length tells it from an array


def unpack(data: bytes) -> np.ndarray:
    """The bit numbers of a container."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(data[:-1], np.uint8))) if len(data) % 2 else np.frombuffer(data, "<u2")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    t = ts.cast("timestamp_ntz")
    seconds = (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1_000_000
    return F.unix_date(t.cast("date")).cast("long") * DAY + seconds + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def _containers(events: DataFrame) -> DataFrame:
    """Events (state, segment, cohort, period, number, cents) to containers by cell and chunk, combined within tasks."""
    def combined(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        names = rows["segment"].combine_chunks().dictionary_encode()
        key = [names.indices.to_numpy(zero_copy_only=False), *(rows[c].to_numpy() for c in ("state", "cohort", "period", "number"))]
        order = np.lexsort(key[::-1])
        key, cents = [k[order] for k in key], rows["cents"].to_numpy()[order]
        differs = lambda ks: np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in ks])])
        at = np.flatnonzero(differs(key))  # the first event of a client in a cell
        cents, key = np.add.reduceat(cents, at), [k[at] for k in key]
        chunk, bit = key[4] >> CHUNK_BITS, key[4] & (CHUNK - 1)
        cell = np.flatnonzero(differs([*key[:4], chunk]))
        packed = [pack(b) for b in np.split(bit, cell[1:])]
        column = lambda k, t: pa.array(k[cell], t)
        yield pa.RecordBatch.from_arrays([column(chunk, pa.int64()), pa.array(np.ones(len(cell), np.int32)), column(key[1], pa.int32()), names.dictionary.take(column(key[0], pa.int32())), column(key[2], pa.int64()), column(key[3], pa.int64()), pa.array(packed, pa.binary()), pa.array(np.add.reduceat(cents, cell))], schema=_CELLS_ARROW)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in stream:
            if b.num_rows:
                held, n = [*held, b], n + b.num_rows
            if n >= COMBINE:
                yield from combined(held)
                held, n = [], 0
        if held:
            yield from combined(held)

    return events.select("state", "segment", "cohort", "period", "number", "cents").mapInArrow(run, _CELLS)


def union(held: list[bytes]) -> bytes:
    """One container with the bits of all."""
    if len(held) == 1:
        return held[0]
    mask = np.zeros(CHUNK, bool)
    for data in held:
        mask[unpack(data)] = True
    return pack(np.flatnonzero(mask))


def _united(cells: DataFrame) -> DataFrame:
    """_containers() with at most PIECES rows a cell and chunk. Each task that gets events of a dealt-out client makes a
    container of each of its cells, so those would be as many as the tasks, all in one part of one chunk."""
    keys = ["chunk", "kind", "state", "segment", "cohort", "period", "piece"]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, held, cents = None, [], 0
            for b in stream:
                for *own, bits, add in zip(*(c.to_pylist() for c in b.columns)):
                    if own != key:
                        if key is not None:
                            yield (*key[:-1], union(held), cents)
                        key, held, cents = own, [], 0
                    held, cents = [*held, bits], cents + add
                    if len(held) == 64:
                        held = [union(held)]
            if key is not None:
                yield (*key[:-1], union(held), cents)

        yield from batches(rows(), _CELLS_ARROW, weigh=lambda r: 64 + len(r[-2]))

    dealt = cells.withColumn("piece", F.pmod(F.spark_partition_id(), F.lit(PIECES))).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "bits", "cents").mapInArrow(run, _CELLS)


def _merged(rows: DataFrame) -> DataFrame:
    """Rows sorted by chunk, kind and cell to users, users_crc32, moved and cents of each cell in each chunk."""
    schema = pa.schema([("state", pa.int32()), ("segment", pa.string()), ("cohort", pa.int64()), ("period", pa.int64()), ("users", pa.int64()), ("users_crc32", pa.int64()), ("moved", pa.int64()), ("cents", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, moved = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, bool)
        cell, mask, cents = None, np.zeros(CHUNK, bool), 0

        def close():
            at = np.flatnonzero(mask)
            return (*cell[1:], len(at), int(crc[at].sum()), int((mask & moved).sum()), cents)

        for b in stream:
            out = []
            tables = b.column(8)
            for i, (chunk, kind, state, segment, cohort, period, bits, add) in enumerate(zip(*(c.to_pylist() for c in b.columns[:8]))):
                key = (chunk, state, segment, cohort, period)
                if key != cell:
                    if cell is not None:
                        out.append(close())
                    cell, cents = None, 0
                    mask[:] = False
                if kind == 0:  # the chunk's table comes before its cells
                    at, code, state0, same = (tables[i].values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                    first, second, equal = (np.zeros(CHUNK, bool) for _ in range(3))
                    crc[:] = 0
                    crc[at], first[at], second[at], equal[at] = code, state0, True, same
                    np.logical_and(first & second, ~equal, out=moved)  # a start in both states, in different cohorts
                else:
                    cell, cents = key, cents + add
                    mask[unpack(bits)] = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        if cell is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(close(), schema)], schema=schema)

    return rows.mapInArrow(run, "state int, segment string, cohort long, period long, users long, users_crc32 long, moved long, cents long")


def _starts(events: DataFrame, cut: Column, start_kind: str) -> DataFrame:
    """client, n (its events), start0, start1: the earliest start among events that arrive before cut, and among all."""
    start = F.when(F.col("kind") == start_kind, F.col("at"))
    return events.groupBy("client").agg(F.count("*").alias("n"), F.min(F.when(F.col("arrives") < cut, start)).alias("start0"), F.min(start).alias("start1"))


def retention(clicks: DataFrame, clients: DataFrame, known_by: str = "2024-02-15 00:00:00", arrival: Column | None = None, start_kind: str = "signup", cohort_days: int = 1, period_days: int = 1) -> DataFrame:
    """state, segment, cohort, period, users, users_crc32, moved, cents: one row per nonempty cell.

    State 0 knows the events that arrive (arrival, a timestamp expression of clicks; arrived_at if not given) before
    known_by, state 1 all. In a state, a client starts at its earliest known ts of kind start_kind; its known events from
    then on, of whatever kind, belong to cohort floor(day of start since 1970 / cohort_days) and to period floor((ts -
    start) / period_days days), exact to the microsecond. cents adds floor(100 value + 0.5).

    Rows of clicks that are equal in all columns count once; rows without ts or client_id don't count; a null arrival is
    known in state 1 only; a null kind is no start; a null or non-finite value adds 0. A client's segment is the least
    that clients gives it, '' if none or null. Extra columns of clients aren't read; those of clicks only tell rows
    apart. Empty tables give no rows. A client with more events than a quarter of a mean partition is dealt over several; no table
    that grows with the input is broadcast or collected.
    """
    spark = clicks.sparkSession
    arrival = F.col("arrived_at") if arrival is None else arrival
    known = clicks.where(F.col("ts").isNotNull() & F.col("client_id").isNotNull())
    own = [F.col("client_id").cast("long").alias("client"), micros(F.col("ts")).alias("at"), micros(arrival).alias("arrives"), F.col("kind").cast("string").alias("kind")]
    cut = micros(F.lit(known_by).cast("timestamp_ntz"))
    cohort = lambda start: F.floor(F.floor(F.col(start) / F.lit(DAY)) / cohort_days)
    per = stored(_starts(known.select(*own), cut, start_kind), "starts")
    total = per.agg(F.sum("n")).first()[0] or 1
    # A client with more than a quarter of a partition's share of the rows is dealt out in such quarters: at most four hot clients and eight pieces a partition.
    quarters = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = F.ceil(F.col("n") * F.lit(quarters) / F.lit(total))
    segments = clients.where(F.col("client_id").isNotNull()).groupBy(F.col("client_id").cast("long").alias("client")).agg(F.min(F.col("segment").cast("string")).alias("segment"))
    members = per.where("start1 IS NOT NULL").join(segments, "client", "left").select("client", "start0", "start1", salts.alias("salts"), F.coalesce("segment", F.lit("")).alias("segment"), F.lit(1).cast("long").alias("one"))
    members = stored(members.withColumn("cohort", cohort("start1")), "members")
    numbered = stored(running(members, ["segment", "cohort", "client"], {"upto": "one"}, name="numbers").withColumn("number", F.col("upto") - 1), "numbered")
    bit = (F.col("number").bitwiseAND(CHUNK - 1)).cast("int").alias("bit")
    entry = F.struct(bit, F.crc32(F.col("client").cast("string")).alias("crc"), F.col("start0").isNotNull().alias("state0"), F.coalesce(cohort("start0") == F.col("cohort"), F.lit(False)).alias("same"))
    tables = numbered.groupBy(F.shiftright("number", CHUNK_BITS).alias("chunk")).agg(F.collect_list(entry).alias("table"))  # at most CHUNK entries
    # Each event meets its client's starts.
    hot = numbered.where("salts > 1").select("client", "salts")  # fewer rows than quarters of partitions
    cents = F.when(F.abs("value") < F.lit(float("inf")), F.floor(F.col("value") * 100 + 0.5)).otherwise(F.lit(0)).cast("long")
    events = known.dropDuplicates().select(*own, cents.alias("cents"), F.xxhash64("click_id", "ts").alias("spread")).join(F.broadcast(hot), "client", "left")
    events = events.select("client", "at", "arrives", "cents", F.coalesce(F.pmod("spread", "salts"), F.lit(0)).alias("salt"))
    dealt = numbered.select("client", "segment", "number", "start0", "start1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    met = events.join(dealt.hint("merge"), ["client", "salt"])
    state = lambda i, seen: F.when(seen & (F.col("at") >= F.col(f"start{i}")), F.struct(F.lit(i).alias("state"), F.col(f"start{i}").alias("start")))
    states = F.filter(F.array(state(0, F.col("arrives") < cut), state(1, F.lit(True))), lambda s: s.isNotNull())
    known_in = met.select("segment", "number", "cents", "at", F.explode(states).alias("s"))
    begun = known_in.select("segment", "number", "cents", "at", F.col("s.state").alias("state"), F.col("s.start").alias("start"))
    period = F.expr(f"(at - start) div {DAY * period_days}")
    cells = _united(_containers(begun.select("state", "segment", cohort("start").alias("cohort"), period.alias("period"), "number", "cents")))
    none = lambda kind: F.lit(None).cast(kind)
    tables = tables.select("chunk", F.lit(0).alias("kind"), none("int").alias("state"), none("string").alias("segment"), none("long").alias("cohort"), none("long").alias("period"), none("binary").alias("bits"), none("long").alias("cents"), "table", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    cells = cells.withColumn("table", F.lit(None).cast(tables.schema["table"].dataType)).withColumn("part", F.pmod(F.xxhash64("state", "segment", "cohort", "period"), F.lit(PARTS)).cast("int"))
    both = tables.unionByName(cells).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "kind", "state", "segment", "cohort", "period")
    chunks = _merged(both.drop("part"))
    return chunks.groupBy("state", "segment", "cohort", "period").agg(*[F.sum(c).alias(c) for c in ("users", "users_crc32", "moved", "cents")])


