"""Running sums over a sort order, computed in range partitions with carried totals.

Rows are range partitioned by the order and sorted inside; each task streams its range and adds running values (numpy);
what a range must add is the total of the ranges before it, of which there are as many as partitions, however many rows
there are. A group that is larger than a range is cut over several and carried like any other sum.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _accumulated(ufunc, values: np.ndarray, inverse, new: np.ndarray, carry: int) -> np.ndarray:
    """Inclusive running values that start anew where new is True; rows before the first True go on from carry."""
    run = ufunc.accumulate(values)
    at = np.maximum.accumulate(np.where(new, np.arange(len(values)), -1))
    return np.where(at < 0, ufunc(run, carry), inverse(run, inverse(run[at], values[at])))


def running(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str], group: str | None = None, xors: dict[str, str] | None = None, keep: Sequence[str] | None = None, name: str = "scan") -> DataFrame:
    """df with a long column per entry of sums and xors (new name: long column): the sum, or exclusive or, of the column
    over the rows up to and with this one in `order`, within its group.

    group is a long column without nulls and the first of order. The order must be total up to rows that are equal in
    all columns. df is read twice (the range partitioner samples it); of its columns only those of keep (all if not given)
    go further than the sort; columns named scan_* are reserved. The rows are stored: discard() of the result frees them.
    """
    xors = xors or {}
    columns = list(keep or df.columns)
    kinds = [(c, np.add, np.subtract, v) for c, v in sums.items()] + [(c, np.bitwise_xor, np.bitwise_xor, v) for c, v in xors.items()]
    added = [k[0] for k in kinds]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, carry = TaskContext.get().partitionId(), 0, None, dict.fromkeys(added, 0)
        for b in stream:
            if not b.num_rows:
                continue
            column = lambda c: b.column(columns.index(c)).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            new = np.zeros(b.num_rows, bool)
            if group is not None:
                keys = column(group)
                new[1:] = keys[1:] != keys[:-1]
                new[0] = last is None or keys[0] != last
                last = keys[-1]
            out = []
            for c, ufunc, inverse, value in kinds:
                values = _accumulated(ufunc, column(value).astype(np.int64), inverse, new, carry[c])
                carry[c] = int(values[-1])
                out.append(pa.array(values))
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=[*columns, *added, "scan_part", "scan_at"])
            at += b.num_rows

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema), *(f"{c} long" for c in added), "scan_part int", "scan_at long"])
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns).mapInArrow(run, schema), name)
    first = F.min_by(group, "scan_at") if group else F.lit(0)
    ends = rows.groupBy("scan_part").agg(first.alias("first"), F.max_by(F.struct((F.col(group) if group else F.lit(0)).cast("long").alias("key"), *added), "scan_at").alias("last"))
    offsets, key, total = [], None, dict.fromkeys(added, 0)
    for r in sorted(ends.collect(), key=lambda r: r["scan_part"]):  # one row a partition
        goes_on = key is not None and r["first"] == key
        offsets.append((r["scan_part"], key if goes_on else None, *(total[c] for c in added)))
        whole = goes_on and r["last"]["key"] == key
        total = {c: int(ufunc(np.int64(total[c]), np.int64(r["last"][c]))) if whole else r["last"][c] for c, ufunc, _, _ in kinds}
        key = r["last"]["key"]
    before = df.sparkSession.createDataFrame(offsets, ", ".join(["scan_part int", "scan_key long", *(f"scan_{c} long" for c in added)]))
    joined = rows.join(F.broadcast(before), "scan_part")
    mine = (F.col(group) if group else F.lit(0)) == F.col("scan_key")
    carried = lambda c: F.when(mine, F.col(f"scan_{c}")).otherwise(F.lit(0))
    out = joined.select(*columns, *[(F.col(c) + carried(c)).alias(c) for c in sums], *[F.col(c).bitwiseXOR(carried(c)).alias(c) for c in xors])
    out._scratch = rows._scratch
    return out
