"""Token-id output: documents packed into windows of fixed length by best-fit-decreasing.

Each task packs the documents it reads, in groups of bounded size, so nothing is shuffled. Within a group, documents
longer than a window are cut into window-long pieces and a rest; pieces are placed longest first, each into the open
window with the least room that still holds it. A segment tree over the possible amounts of room finds that window in
log2(window) steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import batches, small_batches

#: Tokens that a task holds and packs at once.
GROUP_TOKENS = 2_000_000

SCHEMA = pa.schema(
    [
        ("pack_id", pa.int64()),
        ("n_segments", pa.int32()),
        ("n_tokens", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("position_resets", pa.list_(pa.int32())),
        ("ids", pa.binary()),
    ]
)
DDL = "pack_id long, n_segments int, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"


class RoomTree:
    """Open windows by the room they have left; finds the least room that is at least `need`."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window_no: int) -> None:
        self.bins[room].append(window_no)
        node = room + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) with the least room >= need, removed from the tree; None if there is none."""
        node = need + self.size
        if not self.any[node]:
            while not (node & 1 == 0 and self.any[node | 1]):
                node >>= 1
                if node <= 1:
                    return None
            node |= 1
            while node < self.size:
                node <<= 1
                if not self.any[node]:
                    node |= 1
        room = node - self.size
        window_no = self.bins[room].pop()
        if not self.bins[room]:
            while node and not (node < self.size and (self.any[2 * node] or self.any[2 * node + 1])):
                self.any[node] = 0
                node >>= 1
        return room, window_no


def best_fit_decreasing(lengths: list[int], window: int) -> list[list[int]]:
    """Windows as lists of item numbers; items are at most a window long. Ties: the earlier item first."""
    tree, windows = RoomTree(window), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[item]) if lengths[item] < window else None
        if found is None:
            room, at = window, len(windows)
            windows.append([])
        else:
            room, at = found
        windows[at].append(item)
        if room > lengths[item]:
            tree.add(room - lengths[item], at)
    return windows


def pack(tokens: DataFrame, window: int = 2048, eos: int = 50256, pad: int = 50256, id_bytes: int = 2, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Packed windows of the documents in tokens (ids_col: little-endian unsigned 32-bit ids, as encode_decode returns).

    One row per window: pack_id; doc_ids and starts (for each segment, the document and the offset of its first token
    in the document); cu_seqlens (0, then the end of each segment); position_resets (where position ids start from 0
    again: each segment's first token, and the padding's); ids: the window's row of the id matrix, always window ids of
    id_bytes bytes, little-endian, filled up with pad. n_tokens leaves padding out.

    Every document gets eos at its end, so an empty or null one is a single token; joining a document's segments by
    starts gives back all its tokens. Repeated and null document ids are packed like others; other columns are not read,
    whatever they are called; an empty table gives no windows. Documents of one length are packed in the order in which
    they come. pack_id is unique, and the
    same as long as the input's partitions are.
    """
    kind = {2: "<u2", 4: "<u4"}[id_bytes]
    if not 0 <= max(eos, pad) < 1 << 8 * id_bytes:
        raise ValueError("eos and pad must fit id_bytes")
    source = small_batches(tokens).select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        made = 0

        def flush(docs: list[tuple]) -> Iterator[tuple]:
            nonlocal made
            pieces = [(key, start, ids[start : start + window]) for key, ids in docs for start in range(0, len(ids), window)]
            for items in best_fit_decreasing([len(p[2]) for p in pieces], window):
                chosen = [pieces[i] for i in items]
                ends = np.cumsum([len(p[2]) for p in chosen])
                n = int(ends[-1])
                row = np.full(window, pad, kind)
                row[:n] = np.concatenate([p[2] for p in chosen])
                cuts = [0, *ends.tolist()]
                yield (base + made, len(chosen), n, [p[0] for p in chosen], [p[1] for p in chosen], cuts, cuts if n < window else cuts[:-1], row.tobytes())
                made += 1

        def rows():
            docs, held = [], 0
            for batch in stream:
                for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.frombuffer((data or b"") + int(eos).to_bytes(4, "little"), "<u4")
                    if id_bytes == 2 and ids.max() > 65_535:
                        raise ValueError("an id doesn't fit 2 bytes; take id_bytes=4")
                    docs.append((key, ids.astype(kind)))
                    held += len(ids)
                    if held >= GROUP_TOKENS:
                        yield from flush(docs)
                        docs, held = [], 0
            if docs:
                yield from flush(docs)

        return batches(rows(), SCHEMA, lambda r: len(r[7]) + 24 * r[1])

    return source.mapInArrow(run, DDL)


def position_ids(n_tokens: Column, resets: Column, window: int = 2048) -> Column:
    """A window's position ids, counted from 0 after each reset, as an array of int."""
    last = lambda i: F.array_max(F.filter(resets, lambda r: r <= i))
    return F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: i - last(i))
