"""Benchmark decontamination with DataFrame operations only.

An item of the benchmark is a bag of k-word shingles (k = 5, or all its words if it has fewer). A window of a document
is as long as the item it is held against. A document is a candidate for an item if it holds one of its anchor shingles:
of an item with S shingles, S - ceil(threshold x S) + 1 are anchors, so a window that reaches the threshold holds one. In
candidates windows are laid at every start from which enough places hold a shingle of the item, wherever in the item it
stands: bags of S and W shingles at the threshold t share at least t (S + W) / (1 + t), so no other start reaches it.
Windows and items get 64-bit SimHash fingerprints; radius + 1 blocks of the fingerprint are join keys beside the item, so
a window and the item it is laid for meet in a block that is equal whenever they are within the radius. The radius comes
from the threshold. What passes is verified by the exact weighted similarity of the shingle bags, sum of least counts
over sum of greatest counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored, without_rows

#: Anchors and windows up to so many rows are broadcast; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Starts of the windows that are cut from one piece of a document; a longer document is cut from several.
PIECE = 1024


def radius_for(threshold: float) -> int:
    """Bits in which fingerprints at the threshold may differ: the expected number and 4.1 deviations more.

    Bags of equal size at weighted similarity t have a cosine of 2 t / (1 + t) or more (of sets: exactly that), and each
    bit differs with the chance of the angle over pi. At 0.8: 10 of 64 bits, with a deviation of 3; the radius is 21.
    """
    p = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return min(63, int(64 * p + 4.1 * math.sqrt(64 * p * (1 - p))))


def _hashes(text: Column) -> Column:
    """One 64-bit hash per word: lower case, cut at ASCII white space."""
    bare = F.btrim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(bare, r"[ \t\n\x0B\f\r]+"), lambda w: F.xxhash64(w)))


def _shingles(words: Column, k: int) -> Column:
    """The k-word shingles in order; none if there are fewer words."""
    def at(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + j) for j in range(k)])

    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at)).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column) -> Column:
    """64 bits: bit b is set if more shingles (with repeats) have it set than not."""
    def bit(b: Column) -> Column:
        score = F.aggregate(shingles, F.lit(0), lambda acc, h: acc + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.when(score > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(bit(b)))


def blocks(fingerprint: Column, radius: int) -> Column:
    """The fingerprint in radius + 1 blocks of near equal width, each an integer."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")) for a, b in zip(cuts[:-1], cuts[1:])])


def similarity(one: Column, two: Column) -> Column:
    """Weighted Jaccard similarity of two bags given as arrays."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    least = F.aggregate(F.array_intersect(one, two), F.lit(0), lambda acc, x: acc + F.least(count(one, x), count(two, x)))
    return least / (F.size(one) + F.size(two) - least)


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _matches(docs: DataFrame, benchmark: DataFrame, threshold: float, n: int, radius: int | None, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """doc, th, item, start, similarity of every window that reaches the threshold."""
    radius = radius_for(threshold) if radius is None else radius
    items = benchmark.select(F.col(item_col).alias("item"), _hashes(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    items = stored(items.distinct(), "items")
    sizes = [r["k"] for r in items.select(F.least(F.size("w"), F.lit(n)).alias("k")).distinct().orderBy("k").collect()]
    text = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    found = []
    for k in sizes:  # 5, and only if some item has fewer words, its number of words
        own = items.where(F.least(F.size("w"), F.lit(n)) == k).select("item", F.size("w").alias("words"), F.xxhash64("w").alias("iw"), _shingles(F.col("w"), k).alias("bag"))
        # Written first: an expression is evaluated anew wherever a lambda holds it, a column isn't.
        own = stored(own, "item-bags")
        bags = own.select("iw", "words", "bag").dropDuplicates(["iw"])
        prints = stored(bags.select("iw", simhash(F.col("bag")).alias("item_fp")), "item-prints")
        # Anchors are spread over the item, so that a few edited words leave some of them.
        spread = F.expr("transform(sequence(0, anchors - 1), i -> get(bag, cast(floor(i * size(bag) / anchors) as int)))")
        anchors = bags.withColumn("anchors", (F.size("bag") - F.ceil(F.lit(threshold) * F.size("bag")) + 1).cast("int")).select("iw", F.explode(spread).alias("h"))
        anchors = stored(anchors.distinct(), "anchors")
        near = text.withColumn("w", _hashes(F.col("text"))).select("doc", "th", F.explode(_shingles(F.col("w"), k)).alias("h")).join(_maybe_broadcast(anchors), "h")
        pairs = stored(near.select(F.col("doc").alias("w_doc"), F.col("th").alias("w_th"), "iw").distinct(), "candidates")
        same = F.col("doc").eqNullSafe(F.col("w_doc")) & (F.col("th") == F.col("w_th"))
        whole = text.join(_maybe_broadcast(pairs.select("w_doc", "w_th").distinct()), same).dropDuplicates(["doc", "th"])
        whole = stored(whole.withColumn("w", _hashes(F.col("text"))).select("doc", "th", _shingles(F.col("w"), k).alias("all")), "shingles")
        hits = whole.join(_maybe_broadcast(pairs), same).join(_maybe_broadcast(bags), "iw")
        at = F.expr("filter(sequence(0, size(all) - 1), p -> array_contains(bag, get(all, p)))")
        hits = stored(hits.select("doc", "th", "iw", "words", F.size("all").alias("n"), F.size("bag").alias("s"), at.alias("at")), "hits")
        # A window is as long as the item, or the whole of a shorter document.
        hits = hits.withColumn("len", F.least("s", "n"))
        hits = hits.withColumn("need", F.greatest(F.lit(1), F.ceil(F.lit(threshold) * (F.col("s") + F.col("len")) / F.lit(1 + threshold) - 1e-9).cast("int")))
        # The starts between two hits have the same first hit i, and reach up to hit i + need - 1 or not.
        low = "greatest(0, get(at, i + need - 1) - len + 1, if(i = 0, 0, get(at, i - 1) + 1))"
        high = "least(get(at, i), n - len)"
        starts = f"flatten(transform(sequence(0, size(at) - need), i -> if({low} <= {high}, sequence({low}, {high}), cast(array() as array<int>))))"
        windows = hits.where("size(at) >= need").select("doc", "th", "iw", "words", F.explode(F.expr(f"if(size(at) >= need, {starts}, null)")).alias("start")).distinct()
        # Windows near one another are cut from one piece of the document, so its whole array isn't carried to each.
        pieces = windows.withColumn("piece", F.expr(f"start div {PIECE}")).groupBy(F.col("doc").alias("w_doc"), F.col("th").alias("w_th"), "iw", "words", "piece").agg(F.collect_list("start").alias("starts"))
        pieces = stored(pieces, "pieces")
        part = F.slice("all", (F.col("piece") * PIECE + 1).cast("int"), PIECE + F.col("words"))
        cut = whole.join(_maybe_broadcast(pieces), same).select("doc", "th", "iw", "words", "piece", part.alias("part"), F.explode("starts").alias("start"))
        bag = F.slice("part", (F.col("start") - F.col("piece") * PIECE + 1).cast("int"), F.col("words") - (k - 1))
        cut = stored(cut.select("doc", "th", "iw", "start", bag.alias("bag")), "cuts")
        # A pair meets in the blocks that are equal, and is taken in the first of them.
        windowed = cut.withColumn("fp", simhash(F.col("bag")))
        left = stored(windowed, "prints").select("*", F.posexplode(blocks(F.col("fp"), radius)).alias("block", "value"))
        right = prints.select("iw", "item_fp", F.posexplode(blocks(F.col("item_fp"), radius)).alias("block", "value"))
        unlike = F.col("fp").bitwiseXOR(F.col("item_fp"))
        once = F.array_position(blocks(unlike, radius), F.lit(0).cast("bigint")) == F.col("block") + 1
        meet = left.join(_maybe_broadcast(right), ["iw", "block", "value"]).where((F.bit_count(unlike) <= radius) & once).select("doc", "th", "iw", "start", "bag")
        near = meet.join(_maybe_broadcast(own.select("iw", "item", F.col("bag").alias("item_bag"))), "iw")
        found.append(near.select("doc", "th", "item", "start", similarity(F.col("bag"), F.col("item_bag")).alias("similarity")).where(F.col("similarity") >= threshold))
    if not found:
        found = [text.join(items, F.lit(False)).select("doc", "th", "item", F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))]
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id_col, item_col, similarity, start (first word of the best window, from 0), n_windows: one row for each document
    and item of which a window reaches the threshold.

    Windows have the item's number of words (a shorter document is one window). Null and empty texts and items match
    nothing; rows of equal id and text are one document; a null id is an id like others; a benchmark id with several
    texts gives the best of them. Either table may be empty. Other columns are not read. All windows that can reach the
    threshold are compared, none is capped; a radius other than radius_for(threshold) may be given.
    """
    every = _matches(docs, benchmark, threshold, n, radius, id_col, text_col, item_col)
    best = every.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("b"), F.count("*").alias("n_windows"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), F.col("b.similarity").alias("similarity"), (-F.col("b.s")).alias("start"), "n_windows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5, radius: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of docs, with all their columns, of which no window reaches the threshold for an item."""
    every = _matches(docs, benchmark, threshold, n, radius, id_col, text_col, item_col)
    bad = stored(every.select("doc", "th").distinct(), "contaminated")
    return without_rows(docs, bad, id_col, text_col, BROADCAST_ROWS)
