"""Exact Jaccard join of documents on word n-grams, by partition of the token universe.

Sizes fall into bands such that two sets that link lie in the same or in neighbouring bands. Each band has a scheme: the
space of shingle hashes is cut into segments, and by the pigeonhole two linked sets, which differ in at most H shingles,
agree in one of H+1 exact segments, or differ by at most one shingle in a segment that is also indexed with each single
deletion (such a segment counts as two). How many segments of either sort a band has comes from a cost model of its
number of documents. Empty segments, in which unrelated documents agree, are left out: a band gets as many spare segments
as its documents may leave out (the first empty ones), so of the segments in which two linked sets agree the last is
always indexed by both. A document is indexed under its own band's scheme and visits that of the band below.

Documents that share a key are candidates. Each key's most central document is compared first with the key's others,
which is linear however large the group; then only pairs that are not yet in one component are left, less those that the
triangle inequality of the Jaccard distance excludes. Either pass leaves out pairs that a difference bound from parity
sketches excludes. Every remaining pair is
verified on whole sets, so the components are exact. Sets are sets of 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import batches, discard, joined_hot, small_batches, stored, without_rows
from .components import components

#: Words whose hash a worker remembers; reaching it empties the memory.
WORDS = 100_000
#: Rows up to which a table of pairs may be broadcast (about 40 bytes each); beyond it texts are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Documents that one task compares with one leader.
GROUP = 256
#: Open rows of a key that one task compares with as many others.
CELL = 2048
#: Cost model: chance that two documents agree in one shingle, and the cost of a candidate in index rows.
AGREE, CANDIDATE = 0.02, 4.0
#: About so many sets' keys tell where the key space is cut into ranges, each of about so many rows.
SAMPLE, RANGE_ROWS = 2000, 1_000_000
#: Longs of a parity sketch: bit b is the parity of the number of hashes that fall on b, so two sketches differ in at
#: most as many bits as their sets differ in shingles, whatever the sets' sizes.
SKETCH = 8

_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Sets of n-word shingles as sorted arrays of 64-bit hashes; the dict is the memory of word hashes."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        if len(self) > WORDS:
            self.clear()
        n = min(self.n, len(w))
        h = np.full(len(w) - n + 1, n, np.uint64)
        for j in range(n):
            h = _mix(h * _K + w[j : len(w) - n + 1 + j])
        return np.unique(h)


def bands(percent: int, largest: int) -> list[int]:
    """Least size of each band, up to one that covers largest: a linked pair's sizes are at most one band apart."""
    out = [1]
    while out[-1] <= largest:
        out.append(out[-1] * 100 // percent + 1)
    return out


def difference(percent: int, low: int) -> int:
    """The most shingles in which linked sets differ when the smaller is in the band that begins with low."""
    high = low * 100 // percent
    return (100 - percent) * (high + high * 100 // percent) // (100 + percent)


def allocate(need: int, size: int, docs: int, deletions: int | None = None) -> tuple[int, int]:
    """(exact, deletion) segments with exact + 2 x deletion = need, of the least estimated cost for a band; or with as
    many deletion segments as given, as far as need has room for them."""
    if deletions is not None:
        two = min(deletions, need // 2)
        return need - 2 * two, two

    def cost(two: int) -> float:
        one = need - 2 * two
        each = size / (one + two)
        rows = docs * (one + two * (1 + each))
        chance = one * AGREE**each + two * 2 * each * AGREE ** max(each - 1, 0)
        return rows + CANDIDATE * docs * docs / 2 * min(chance, 1)

    two = min({*range(min(need // 2, 8) + 1), need // 2}, key=cost)
    return need - 2 * two, two


def spare_segments(segments: int, size: int) -> int:
    """How many empty segments a set of that size may leave out: their expected number and three deviations more."""
    spare = 0
    for _ in range(4):
        empty = (segments + spare) * math.exp(-size / (segments + spare))
        spare = math.ceil(empty + 3 * math.sqrt(empty))
    return min(spare, segments)


def schemes(percent: int, counts: dict[int, int], deletions: int | None = None) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Band starts and each band's (exact, deletion, spare) segments, from the number of distinct sets per band."""
    top = max(counts, default=0) + 1
    starts = [1]
    while len(starts) <= top + 1:
        starts.append(starts[-1] * 100 // percent + 1)
    alloc = []
    for i, low in enumerate(starts):
        need = difference(percent, low) + 1
        if need == 1:  # only equal sets link
            alloc.append((0, 0, 0))
            continue
        one, two = allocate(need, low * 100 // percent, counts.get(i, 0) + counts.get(i + 1, 0), deletions)
        alloc.append((one, two, spare_segments(one + two, low) if one else 0))
    return starts, alloc


def index_keys(h: np.ndarray, band: int, alloc: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The set's keys under a band's scheme, and for each whether it is a whole segment (1) or one less (0)."""
    one, two, spare = alloc
    m = one + two + spare
    if not m:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    salt = _mix(np.arange(m, dtype=np.uint64) + np.uint64((band + 1) << 32))
    seg = ((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # increasing, as h is sorted
    value = _mix(h ^ _K)
    total = np.concatenate([[np.uint64(0)], np.cumsum(value)])
    cut = np.searchsorted(seg, np.arange(m + 1, dtype=np.uint64))
    sums = total[cut[1:]] - total[cut[:-1]]
    keep = np.ones(m, bool)
    keep[two + np.flatnonzero(cut[two + 1 :] == cut[two:-1])[:spare]] = False
    keys = _mix(sums + salt)[keep]
    whole = np.ones(len(keys), np.int8)
    if two:
        part = h[: cut[two]]  # the first `two` segments have deletions
        at = seg[: len(part)].astype(np.int64)
        keys = np.concatenate([keys, _mix(sums[at] - value[: len(part)] + salt[at])])
        whole = np.concatenate([whole, np.zeros(len(part), np.int8)])
    return keys, whole


def _sketch(h: np.ndarray) -> list[int]:
    odd = np.bincount((h & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8").tolist()


def _set_id(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc, text as bytes and th of each row, a few hundred rows in memory at a time."""
    for at in range(0, batch.num_rows, 256):
        b = batch.slice(at, 256)
        yield from zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist())


def _members(source: DataFrame, n: int) -> DataFrame:
    """doc, th (hash of the text), node (identity of its set, null if empty), size and sketch."""
    kind = source.schema["doc"].dataType
    schema = pa.schema([("doc", to_arrow_type(kind)), ("th", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)

        def rows():
            for b in stream:
                for doc, text, th in _rows(b):
                    h = shingle(text)
                    yield (doc, th, _set_id(h), len(h), _sketch(h)) if len(h) else (doc, th, None, 0, None)

        return batches(rows(), schema, lambda r: 96)

    return source.mapInArrow(run, f"doc {kind.simpleString()}, th long, node long, size long, sketch array<long>")


def _keys(source: DataFrame, n: int, starts: list[int], alloc: list[tuple[int, int]], bounds: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(key, node, bits): bit 0 a whole segment, bit 1 the document's own band; a set once per task. With bounds, rows in the
    order (key, away, node) at which ranges begin, also part, the number of a row's range."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("bits", pa.int8()), *([("part", pa.int32())] if bounds is not None else [])])
    order = np.array(bounds or [], [("key", np.int64), ("away", np.int64), ("node", np.int64)])

    def part_of(key: np.ndarray, node: np.ndarray, bits: np.ndarray) -> np.ndarray:
        low, part = np.searchsorted(order["key"], key, "left"), np.searchsorted(order["key"], key, "right")
        for i in np.flatnonzero(low < part):  # keys at a border
            part[i] = bisect_right(order[low[i] : part[i]].tolist(), (key[i], int(bits[i] < 2), node[i])) + low[i]
        return part.astype(np.int32)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(n), set()
        held, size = ([], [], []), 0

        def batch():
            columns = [np.concatenate(x) for x in held]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (columns if bounds is None else [*columns, part_of(*columns)])], schema=schema)

        for b in stream:
            for _, text, _ in _rows(b):
                h = shingle(text)
                if not len(h) or (node := _set_id(h)) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(node)
                band = bisect_right(starts, len(h)) - 1
                for at, home in ((band, 2), (band - 1, 0)):
                    if at >= 0:
                        keys, whole = index_keys(h, at, alloc[at])
                        held[0].append(keys.view(np.int64))
                        held[1].append(np.full(len(keys), node))
                        held[2].append(whole + np.int8(home))
                        size += len(keys)
                if size >= 200_000:
                    yield batch()
                    held, size = ([], [], []), 0
        if size:
            yield batch()

    return source.mapInArrow(run, "key long, node long, bits byte" + ("" if bounds is None else ", part int"))


def _bounds(source: DataFrame, n: int, starts: list[int], alloc: list[tuple[int, int]], sets: int, parts: int) -> list[tuple[int, int, int]]:
    """Where the ranges of all keys begin, from those of about SAMPLE sets: it decides how evenly keys are dealt, and no result.
    A hot key of theirs is cut as other ranges are."""
    some = source.where(F.pmod(F.xxhash64("th"), F.lit(max(1, sets // SAMPLE))) == 0)
    ranged = stored(_keys(some, n, starts, alloc), "sample-keys").repartitionByRange(parts, *_order())
    first = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("key", (F.col("bits") < 2).cast("long").alias("away"), "node")).alias("b"))
    return sorted(tuple(r["b"]) for r in first.collect())[1:]


def _order() -> list:
    return [F.col("key"), (F.col("bits") < 2).alias("away"), F.col("node")]


def _shared_runs(keyed: DataFrame) -> DataFrame:
    """From rows in the order (key, home first, node), streamed by range partition: kind 0, a row of a key that at least
    two nodes share, one of them at home; kind 1, the least and greatest node of a key at a partition's border and
    whether one is at home; kind 2, a row of such a key that is still open. A hot key is cut over many partitions, and
    memory holds one batch. Each (key, node) comes once."""
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("node", pa.int64()), ("bits", pa.int8()), ("other", pa.int64())])

    def rows(kind, key, node, bits, other=None):
        n = len(node)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(key), pa.array(node), pa.array(bits), pa.array(other) if other is not None else pa.nulls(n, pa.int64())], schema=schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, True  # the run that goes on: key, least and greatest node, home, last node, rows held back

        def border():
            key, low, high, home = now[:4]
            return rows(1, np.array([key]), np.array([low]), np.array([2 * home], np.int8), np.array([high]))

        for batch in stream:
            key, node, bits = (np.asarray(batch.column(i)) for i in range(3))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            if len(key) and now:
                new[0] = key[0] != now[0] or node[0] != now[4]
            key, node, bits = key[new], node[new], bits[new]
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            emit = np.repeat((ends - starts >= 2) & (bits[starts] >= 2), ends - starts)
            for run_no in sorted({0, len(starts) - 1}):  # these may go on from the batch before, or into the next
                a, b = starts[run_no], ends[run_no]
                if now and key[a] == now[0]:
                    low, high, home, held = min(now[1], node[a:b].min()), max(now[2], node[a:b].max()), now[3], now[5]
                else:
                    if now and first:
                        yield border()
                        first = False
                    low, high, home, held = node[a:b].min(), node[a:b].max(), bool(bits[a] >= 2), None
                now = [key[a], low, high, home, node[b - 1], held]
                if first:
                    yield rows(2, key[a:b], node[a:b], bits[a:b])
                    emit[a:b] = False
                elif not home:
                    emit[a:b] = False
                elif held is not None or b - a >= 2 or low < high:
                    if held is not None:
                        yield rows(0, *held)
                        now[5] = None
                    emit[a:b] = True
                else:
                    emit[a:b] = False
                    now[5] = (key[a:b], node[a:b], bits[a:b])
            if emit.any():
                yield rows(0, key[emit], node[emit], bits[emit])
        if now:
            yield border()
            if now[5] is not None:
                yield rows(2, *now[5])

    return keyed.mapInArrow(run, "kind byte, key long, node long, bits byte, other long")


def _shared(keyed: DataFrame, parts: int | None = None) -> DataFrame:
    """(key, node, bits) of the keys that at least two nodes share, one of them at home; a hot key isn't dealt to one task.
    With parts, keyed tells by `part` which of so many ranges a row is in, and is read once: nothing of its size is written
    but one shuffle."""
    ranged = keyed.repartitionByRange(*_order()) if parts is None else keyed.repartitionById(parts, F.col("part")).drop("part")
    runs = stored(_shared_runs(ranged.sortWithinPartitions(*_order())), "key-runs")
    edges = runs.where("kind = 1").groupBy("key").agg(F.min("node").alias("lo"), F.max("other").alias("hi"), F.max("bits").alias("any"))
    late = runs.where("kind = 2").join(F.broadcast(edges.where("lo < hi and any >= 2").select("key")), "key", "left_semi")  # two keys a partition at most
    out = stored(runs.where("kind = 0").unionByName(late).select("key", "node", "bits"), "shared-keys")
    discard(runs)
    return out


def _verified(source: DataFrame, n: int, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(x, y, shared, nx, ny) for each pair (x, y) of nodes: the size of the intersection of the whole sets.

    The pairs of one x are dealt in groups of about GROUP. A group's task sees the set of x first, then streams the sets
    of its y: it holds one set at a time beside that of x.
    """
    counts = pairs.groupBy("x").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    dealt = pairs.join(counts, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("groups")).cast("int").alias("part"))
    dealt = stored(dealt, "pairs")
    # Roles: 0 brings the set of x to a group, 1 that of a y.
    jobs = dealt.select("x", "part", F.lit(1).alias("role"), F.col("y").alias("node")).unionByName(dealt.select("x", "part").distinct().select("x", "part", F.lit(0).alias("role"), F.col("x").alias("node")))
    jobs = stored(jobs.join(reps, "node").select("x", "part", "role", "node", "rep"), "jobs")
    small = jobs.count() <= BROADCAST_ROWS
    texts = source.join(F.broadcast(jobs) if small else jobs, source["doc"].eqNullSafe(jobs["rep"]))

    def sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, last, h = Shingler(n), None, None
        schema = pa.schema([("x", pa.int64()), ("part", pa.int32()), ("role", pa.int32()), ("node", pa.int64()), ("h", pa.binary())])

        def rows():
            nonlocal last, h
            for b in stream:
                for x, part, role, node, text in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4).cast(pa.binary()).to_pylist()):
                    if node != last:
                        last, h = node, shingle(text)
                        if _set_id(h) != node:  # another row of the same document id, with another text
                            last = None
                            continue
                    yield x, part, role, node, h.tobytes()

        return batches(rows(), schema, lambda r: 64 + len(r[4]))

    def compare(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("shared", pa.int64()), ("nx", pa.int64()), ("ny", pa.int64())])

        def rows():
            lead, own, last = None, None, None
            for b in stream:
                for x, part, role, node, data in zip(*(c.to_pylist() for c in b.columns)):
                    h = np.frombuffer(data, np.uint64)
                    if role == 0:
                        lead, own, last = (x, part), h, None
                    elif node != last:
                        assert lead == (x, part)
                        last = node
                        small, large = (h, own) if len(h) < len(own) else (own, h)
                        at = np.searchsorted(large, small)
                        at[at == len(large)] = 0
                        yield x, node, int((large[at] == small).sum()), len(own), len(h)

        return batches(rows(), schema)

    shipped = texts.select("x", "part", "role", "node", "text").mapInArrow(sets, "x long, part int, role int, node long, h binary")
    ordered = shipped.repartition("x", "part").sortWithinPartitions("x", "part", "role", "node")
    out = stored(ordered.mapInArrow(compare, "x long, y long, shared long, nx long, ny long"), "verified")
    discard(dealt, jobs)
    return out


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_links: bool = False, deletions: int | None = None) -> DataFrame:
    """id_col, n_shingles, component_id (least id reached by links, itself included), component_size, text_hash
    (xxhash64 of the text): one row per row.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set has the distinct n-word shingles of the whole
    text, or, with fewer words, the whole sequence as its one shingle. Two documents link when 100 x intersection >=
    percent x union. A null or empty text has an empty set and links with nothing. Rows with equal sets link, repeated
    rows and ids among them; component_id is null only where all ids of a component are. An empty table gives no rows.

    with_links adds n_links, the number of other rows that a row links with. Then every candidate pair of unlike sets is
    verified, also within a component: quadratic in the number of unlike sets that share a key. deletions forces the
    number of deletion segments of each band, which changes the cost and not the result. Other columns are not read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    source = _texts(docs, id_col, text_col)
    members = stored(_members(source, n), "members")
    starts = bands(percent, members.agg(F.max("size")).first()[0] or 1)
    band = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("size"))) - 1
    nodes = members.where("size > 0").groupBy("node").agg(F.min("doc").alias("rep"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.count("*").alias("rows"))
    nodes = stored(nodes, "sets")
    counts = {r["band"]: r["count"] for r in nodes.select(band.alias("band")).groupBy("band").count().collect()}
    starts, alloc = schemes(percent, counts, deletions)
    sets = sum(counts.values())
    segments = sum(c * sum(sum(alloc[b]) for b in (i, i - 1) if b >= 0) for i, c in counts.items())
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-segments // RANGE_ROWS))
    bounds = _bounds(source, n, starts, alloc, sets, parts)
    shared = _shared(_keys(source, n, starts, alloc, bounds), len(bounds) + 1)

    # First pass: each key's most central node against the key's others.
    sizes = shared.groupBy("key").agg(F.count("*").alias("k"))
    centre = joined_hot(shared, sizes, "key", "k").groupBy("node").agg(F.sum("k").alias("weight"))
    leaders = shared.join(centre, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("top"), F.count("*").alias("k")).select("key", F.col("top.node").alias("x"), "k")
    led = stored(joined_hot(shared, leaders, "key", "k").select("key", "x", F.col("node").alias("y"), "bits"), "led-keys")
    discard(shared)
    # Pairs that sizes or sketches exclude link in no pass, and their sets aren't shipped.
    unlike = sum(F.bit_count(F.get("sketch1", F.lit(i)).bitwiseXOR(F.get("sketch2", F.lit(i)))) for i in range(SKETCH))
    similar = F.expr(f"100 * least(size1, size2) >= {percent} * greatest(size1, size2)") & (unlike * (100 + percent) <= (100 - percent) * (F.col("size1") + F.col("size2")))
    pairs = led.where("x <> y").select("x", "y").distinct()
    for i, at in enumerate("xy", 1):
        pairs = pairs.join(nodes.select(F.col("node").alias(at), F.col("size").alias(f"size{i}"), F.col("sketch").alias(f"sketch{i}")), at)
    first = _verified(source, n, pairs.where(similar).select("x", "y"), nodes.select("node", "rep"))
    linked = F.expr(f"100 * shared >= {percent} * (nx + ny - shared)")
    links = first.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = components(links)

    # Second pass: pairs of one key that the first pass left in unlike components.
    label = led.join(found, led["y"] == found["node"], "left").select("key", "x", "y", "bits", F.coalesce("component", "y").alias("c"))
    open_keys = label.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.count("*").alias("k")).where("true" if with_links else "c1 < c2").select("key", "k")
    far = first.select("x", "y", (1 - F.col("shared") / (F.col("nx") + F.col("ny") - F.col("shared"))).alias("d"))
    left = joined_hot(label, open_keys, "key", "k").where("k is not null").join(far, ["x", "y"], "left").join(nodes.select(F.col("node").alias("y"), "size", "sketch"), "y")
    left = stored(left.select("key", "x", "y", "bits", "c", F.when(F.col("x") == F.col("y"), F.lit(0.0)).otherwise(F.col("d")).alias("d"), "size", "sketch", F.ceil(F.col("k") / CELL).cast("int").alias("cells")), "open-keys")
    # A key's rows are dealt to cells; each two cells meet in a task of their own.
    cell, every = F.pmod(F.xxhash64("y"), F.col("cells")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    sides = [left.select("*", cell.alias("i"), every.alias("j")), left.select("*", every.alias("i"), cell.alias("j"))]
    one, two = (side.select(*[F.col(c).alias(f"{c}{at}") for c in side.columns]) for at, side in enumerate(sides, 1))
    close = (
        F.expr("key1 = key2 and i1 = i2 and j1 = j2")
        & F.expr("y1 < y2 and y1 <> x1 and y2 <> x1" + ("" if with_links else " and c1 <> c2"))
        & F.expr("(bits1 >= 2 or bits2 >= 2) and (bits1 % 2 = 1 or bits2 % 2 = 1)")
        & F.expr(f"coalesce(abs(d1 - d2) <= {(100 - percent) / 100 + 1e-9}, true)")
        & similar
    )
    rest = one.join(two, close).select(F.col("y1").alias("x"), F.col("y2").alias("y")).distinct()
    second = _verified(source, n, rest, nodes.select("node", "rep"))
    discard(led, left)
    more = second.where(linked).select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not more.isEmpty():
        found = components(links.unionByName(more))

    # By set, then by row: components of many sets and sets of many rows are not dealt to one task.
    joined = found.join(nodes.select("node", "rep", "rows"), "node")
    heads = joined.groupBy("component").agg(F.min("rep").alias("head"), F.sum("rows").alias("n"), F.count("*").alias("k"))
    info = joined_hot(joined, heads, "component", "k").select("node", "head", "n", "rows")
    lone = nodes.where("rows > 1").join(found.select("node"), "node", "left_anti")
    info = info.unionByName(lone.select("node", F.col("rep").alias("head"), F.col("rows").alias("n"), "rows"))
    linked_rows = []
    if with_links:  # rows of the own set but one, and all of each linked set
        sets = links.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = sets.unionByName(sets.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(nodes.select(F.col("node").alias("b"), "rows"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("rows").alias("other"))
        info = info.join(others, "node", "left").withColumn("n_links", F.col("rows") - 1 + F.coalesce("other", F.lit(0)))
        linked_rows = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    out = joined_hot(members.drop("sketch"), stored(info, "set-components"), "node", "rows")
    head = F.when(F.col("n").isNull(), F.col("doc")).otherwise(F.col("head"))
    return out.select(F.col("doc").alias(id_col), F.col("size").alias("n_shingles"), head.alias("component_id"), F.coalesce("n", F.lit(1)).cast("long").alias("component_size"), F.col("th").alias("text_hash"), *linked_rows)


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the least id of their component; rows of one id and text stay
    or go together, and documents that link with nothing stay, those without words among them."""
    placed = jaccard_components(docs, n, percent, id_col, text_col)
    gone = stored(placed.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(id_col, "text_hash").distinct(), "near-duplicates")
    return without_rows(docs, gone, id_col, text_col, BROADCAST_ROWS)
