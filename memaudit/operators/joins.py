"""Joins whose hot keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key beyond which it isn't dealt to one task.
HEAVY = 10_000
#: Rows, and bytes of their texts, up to which a side is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20
#: A hot key that is too large for a broadcast is joined in GRID x GRID cells.
GRID = 8


def small(df: DataFrame, text: str | None = None) -> bool:
    """True if df, and the bytes of its column text, are few enough for a broadcast; counts them."""
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(text)) if text else F.lit(0)).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def hot_join(left: DataFrame, right: DataFrame, on: str, rows: tuple[str, str], ids: tuple[str, str], text: str | None = None) -> DataFrame:
    """Inner join. right's columns rows[0] and rows[1] bound how many rows of left and of right a key has.

    Keys over HEAVY on either side leave the shuffle: their rows of right are broadcast if they are few, else both sides'
    are dealt by a hash of their ids (ids[0] of left, ids[1] of right) over GRID x GRID cells. text names right's long
    column, whose bytes count for the broadcast.
    """
    heavy = (F.col(rows[0]) > HEAVY) | (F.col(rows[1]) > HEAVY)
    hot = right.where(heavy)
    keys = hot.select(on).distinct()
    if hot.isEmpty():
        return left.join(right, on)
    few = small(keys)
    keys = F.broadcast(keys) if few else keys
    cold = left.join(keys, on, "left_anti").join(right.where(~heavy), on)
    if small(hot, text):
        return cold.unionByName(left.join(F.broadcast(hot), on))
    cells = F.sequence(F.lit(0), F.lit(GRID - 1))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(GRID)).cast("int")
    dealt = left.join(keys, on, "left_semi").withColumn("__a", part(ids[0])).withColumn("__b", F.explode(cells))
    met = hot.withColumn("__b", part(ids[1])).withColumn("__a", F.explode(cells))
    return cold.unionByName(dealt.join(met, [on, "__a", "__b"]).drop("__a", "__b"))
