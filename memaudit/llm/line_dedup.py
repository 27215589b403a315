"""Dedup of lines across documents by range-partitioned hashes.

Every document gives one row per distinct line key: the key's 128-bit hash and the key's positions. The rows are range
partitioned by (hash, document), so even one line that a third of all documents share is cut over many tasks, and are
sorted within each task by hash, then document. A task then streams its runs of equal hashes, with memory for the rows
of fewer than min_docs documents, and decides each run that lies inside the partition. Only a partition's first and last run can go on in
a neighbour; their counts and undecided rows are settled together afterwards. What
comes back is a compressed keep bitmap per document, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType

from ._common import batches, discard, free_name, joined_hot, small_batches, stored

_WRAP = 1 << 63
#: Rows of a run that a task holds while they are of fewer than min_docs documents.
HELD_ROWS = 10_000
#: Rows up to which the table of further copies of a text is broadcast.
BROADCAST_ROWS = 400_000


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased (bytes.strip and .lower do just that)."""
    return line.strip().lower()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return small_batches(docs).select(F.col(id_col).alias("doc"), text.alias("text")).withColumn("th", F.xxhash64("text"))


def _line_rows(keyed: DataFrame, min_chars: int) -> DataFrame:
    kind = keyed.schema["doc"].dataType
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", to_arrow_type(kind)), ("th", pa.int64()), ("lines", pa.int32()), ("pos", pa.list_(pa.int32()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in stream:
                for doc, text, th in zip(*(c.to_pylist() for c in batch.columns)):
                    lines = text.encode().split(b"\n")
                    at: dict[bytes, list[int]] = {}
                    for i, line in enumerate(lines):
                        at.setdefault(line_key(line), []).append(i)
                    for key, pos in at.items():
                        if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                            h = xxhash.xxh3_128_intdigest(key)
                            yield (h >> 64) - _WRAP, (h & (2 * _WRAP - 1)) - _WRAP, doc, th, len(lines), pos

        return batches(rows(), schema, lambda r: 48 + 4 * len(r[5]))

    return keyed.mapInArrow(run, f"h1 long, h2 long, doc {kind.simpleString()}, th long, lines int, pos array<int>")


def _settle_runs(lines: DataFrame, min_docs: int, first_stays: bool) -> DataFrame:
    """kind 0: positions to drop; kind 1: a boundary run's inner count, first and last document; kind 2: a row left open."""
    kind = lines.schema["doc"].dataType
    schema = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", to_arrow_type(kind)), ("th", pa.int64()), ("lines", pa.int32()), ("pos", pa.list_(pa.int32())), ("n", pa.int64()), ("end", to_arrow_type(kind))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def drop(row, lead=False):
            pos = row[5][1:] if lead and first_stays else row[5]
            if pos:
                yield (0, *row[:5], pos, None, None)

        def count(n, lead, last):
            """A boundary run's documents between its first and its last one, which may go on in a neighbour."""
            return (1, *lead[:5], None, n - (1 if lead[2] == last[0] else 2), last[0])

        def open_rows(held):
            return ((2, *row[:6], None, None) for row in held)

        def close(held, n, lead, last, boundary):
            """The end of a run: held are its rows not emitted so far."""
            if boundary:
                yield count(n, lead, last)
                yield from open_rows(held)
                if first_stays and n >= min_docs:
                    yield from open_rows([lead])

        def rows():
            key, held, n, lead, last, first, cut = None, [], 0, None, None, True, False
            for batch in stream:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    if row[:2] != key:
                        if key is not None:
                            yield from close(held, n, lead, last, first or cut)
                            first = False
                        key, held, n, lead, last, cut = row[:2], [], 0, row, None, False
                    if row[2:4] == last:
                        continue  # the same document once more
                    n += last is None or row[2] != last[0]  # further texts of one id are no further document
                    last = row[2:4]
                    if n < min_docs:
                        held.append(row)
                        if len(held) >= HELD_ROWS:  # one id with very many texts: these rows are settled with the boundary runs'
                            yield from open_rows(held)
                            held, cut = [], True
                        continue
                    for one in held:
                        if one is not lead or not first_stays or not first:
                            yield from drop(one, one is lead)
                    held = []
                    if row is not lead or not first_stays or not first:
                        yield from drop(row, row is lead)
            if key is not None:
                # The last run of a partition: its lead row may have been dropped as the first of the run only if
                # the run began in this partition, which holds unless it is the partition's first run too.
                yield from close(held, n, lead, last, True) if first or cut or not first_stays or n < min_docs else iter([count(n, lead, last)])

        return batches(rows(), schema, lambda r: 80 + 4 * len(r[6] or ()))

    return lines.mapInArrow(run, f"kind int, h1 long, h2 long, doc {kind.simpleString()}, th long, lines int, pos array<int>, n long, end {kind.simpleString()}")


@F.pandas_udf(BinaryType())
def _bitmap(lines: pd.Series, drop: pd.Series) -> pd.Series:
    def one(n, positions):
        keep = np.ones(n, np.uint8)
        keep[positions] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 1)

    return pd.Series([one(n, p) for n, p in zip(lines, drop)])


def keep_mask(bitmap: bytes | None, lines: int) -> np.ndarray:
    """The bitmap as 0/1 per line; none means that every line stays."""
    return np.ones(lines, np.uint8) if bitmap is None else np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:lines]


def _further_copies(keyed: DataFrame) -> DataFrame:
    """doc, th, head: each document whose text is also that of a document with a lesser id, the least one (head)."""
    ids = keyed.select("doc", "th", F.xxhash64(F.lit(1), F.col("text")).alias("th2"))  # seeded otherwise: 128 bits with th
    heads = ids.groupBy("th", "th2").agg(F.min("doc").alias("head"), F.count("*").alias("n")).where("n > 1")
    further = joined_hot(ids, heads, ["th", "th2"], "n").where(F.col("n").isNotNull() & ~F.col("doc").eqNullSafe(F.col("head")))
    return stored(further.select("doc", "th", "head").distinct(), "copies")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep: str = "none", min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", copies_vote: bool = True) -> DataFrame:
    """doc, th (xxhash64 of the text), n_dropped, bitmap: one row for each document that loses a line.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; keys of fewer than min_chars code
    points are left alone. A key found in at least min_docs documents loses all its lines (keep="none") or all but the
    first by document and position (keep="first"). Documents are counted by id: rows of one id are one document, whatever
    their texts (each text loses its own lines); a null id is an id like others; a null text is one empty line; other columns are not read; an empty table gives no rows. Without copies_vote
    all documents of one text count as one, and lose the same.
    """
    if keep not in ("none", "first") or min_docs < 1:
        raise ValueError("keep must be none or first, min_docs at least 1")
    keyed = _keyed(docs, id_col, text_col)
    copies = None if copies_vote else _further_copies(keyed)
    if copies is not None:
        more = copies.select(F.col("doc").alias("c_doc"), F.col("th").alias("c_th"))
        more = F.broadcast(more) if more.count() <= BROADCAST_ROWS else more
        keyed = keyed.join(more, F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("th") == F.col("c_th")), "left_anti")
    rows = stored(_line_rows(keyed, min_chars), "line-rows")  # the range partitioner reads them twice
    order = ["h1", "h2", "doc", "th"]
    runs = stored(_settle_runs(rows.repartitionByRange(*order).sortWithinPartitions(*order), min_docs, keep == "first"), "line-runs")
    discard(rows)
    ends = F.array(F.struct(F.col("doc").alias("doc")), F.struct(F.col("end").alias("doc")))  # at most two a partition
    total = F.sum("n") + F.size(F.array_distinct(F.flatten(F.collect_list(ends))))
    totals = runs.where("kind = 1").groupBy("h1", "h2").agg(total.alias("total"), F.min(F.struct("doc", "th")).alias("head")).where(F.col("total") >= min_docs)
    late = runs.where("kind = 2").drop("n", "kind", "end").dropDuplicates(order).join(totals, ["h1", "h2"])
    if keep == "first":
        heads = F.col("head").eqNullSafe(F.struct("doc", "th"))
        late = late.withColumn("pos", F.when(heads, F.slice("pos", 2, F.greatest(F.size("pos") - 1, F.lit(0)))).otherwise(F.col("pos")))
    drops = runs.where("kind = 0").select("doc", "th", "lines", "pos").unionByName(late.select("doc", "th", "lines", "pos"))
    per_doc = drops.groupBy("doc", "th").agg(F.max("lines").alias("lines"), F.flatten(F.collect_list("pos")).alias("pos")).where(F.size("pos") > 0)
    bitmaps = per_doc.select("doc", "th", F.size("pos").alias("n_dropped"), _bitmap("lines", "pos").alias("bitmap"))
    if copies is None:
        return bitmaps
    bitmaps = stored(bitmaps, "bitmaps")
    own = bitmaps.select(F.col("doc").alias("b_doc"), F.col("th").alias("b_th"), "n_dropped", "bitmap")
    same = F.col("head").eqNullSafe(F.col("b_doc")) & (F.col("th") == F.col("b_th"))
    return bitmaps.unionByName(copies.join(own, same).select("doc", "th", "n_dropped", "bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines (before), n_dropped, kept (the kept lines joined by \\n): one row per input row."""
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["doc"].dataType
    named = bitmaps.select(F.col("doc").alias("b_doc"), F.col("th").alias("b_th"), "bitmap")
    joined = keyed.join(named, F.col("doc").eqNullSafe(F.col("b_doc")) & (F.col("th") == F.col("b_th")), "left").select("doc", "text", "bitmap")
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in stream:
                for doc, text, bitmap in zip(*(c.to_pylist() for c in batch.columns)):
                    if bitmap is None:
                        yield doc, text.count("\n") + 1, 0, text
                        continue
                    lines = text.split("\n")
                    mask = keep_mask(bitmap, len(lines))
                    yield doc, len(lines), len(lines) - int(mask.sum()), "\n".join([x for x, m in zip(lines, mask) if m])

        return batches(rows(), schema, lambda r: 32 + len(r[3]))

    return joined.mapInArrow(run, f"{id_col} {kind.simpleString()}, n_lines long, n_dropped long, kept string")


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", copies_vote: bool = True) -> DataFrame:
    """docs with all its columns and rows, each text without the lines that keep_bitmaps() drops.

    chars_col, where docs has it, gets the new length in code points. A document that loses all lines stays, with an
    empty text; a null text becomes empty.
    """
    bitmaps = keep_bitmaps(docs, min_docs, keep, id_col=id_col, text_col=text_col, copies_vote=copies_vote)
    key, th, mask = (free_name(docs, c) for c in ("line_doc", "line_th", "line_bitmap"))
    named = bitmaps.select(F.col("doc").alias(key), F.col("th").alias(th), F.col("bitmap").alias(mask))
    filled = docs.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = filled.join(named, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col)) == F.col(th)), "left").select(*docs.columns, mask)
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(text: str, bitmap: bytes | None) -> str:
            if bitmap is None:
                return text
            lines = text.split("\n")
            return "\n".join([x for x, m in zip(lines, keep_mask(bitmap, len(lines))) if m])

        for b in stream:
            texts = pa.array(list(map(cut, b.column(at).to_pylist(), b.column(last).to_pylist())), pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else b.column(i) for i in range(last)], names=b.schema.names[:last])

    out = joined.mapInArrow(run, filled.schema)
    if chars_col and chars_col in docs.columns:
        out = out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType))
    return out
