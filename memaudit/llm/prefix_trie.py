"""Prefix trie of conversations by preorder intervals.

A prefix is known by the exclusive or of position-keyed 128-bit turn hashes, a running value over each conversation
(range partitions, carried values), so an endless conversation is cut over tasks like any other rows. Distinct prefixes
are the nodes. Each node names the longest conversation through it (ties by hash) its representative: nodes with one
representative form a path of the trie, and a path is written as the list of (minus depth, representative) at which
paths fork from the root on. These lists, compared lexicographically, put the paths - and with the depth the nodes - in
preorder: a path's nodes, then its branches from the deepest up. Path lengths summed in that order give every node its
place; the greatest place of a conversation below it is the end of its subtree. What a subtree holds is then a difference
of two running sums over places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import batches, discard, joined_hot, stored
from .scan import running

#: Ids of a node's ends go to the digest in pieces of about so many bytes.
PIECE = 1 << 16
NODE = ["depth", "k1", "k2"]


def splice(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, depth, len, z1, z2, words of the rebuilt conversations, depth 0 included.

    turns: conv, pos, t1, t2, words. convs: conv, n, base, h (at most 3). Conversation conv becomes the first h turns of
    base and its own turns after its first h.
    """
    of_base = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    plan = convs.join(of_base, "base", "left").withColumn("take", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = stored(plan.select("conv", "base", "n", "h", "take", (F.col("take") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "spliced")
    tails = joined_hot(turns, plan.select("conv", "n", "h", "take", "len"), "conv", "n").where("pos > h").withColumn("depth", F.col("take") + F.col("pos") - F.col("h"))
    first = turns.where("pos <= 3").select(F.col("conv").alias("base"), F.col("pos").alias("depth"), "t1", "t2", "words")  # at most 3 rows a base
    heads = plan.select("conv", "base", "take", "len").join(first, "base").where("depth <= take")
    key = lambda seed: F.xxhash64(F.lit(seed), "depth", "t1", "t2")
    rows = [x.select("conv", "depth", "len", key(1).alias("z1"), key(2).alias("z2"), "words") for x in (tails, heads)]
    zero = lambda c: F.lit(0).cast("long").alias(c)
    return rows[0].unionByName(rows[1]).unionByName(plan.select("conv", zero("depth"), "len", zero("z1"), zero("z2"), zero("words")))


def _end_digests(ends: DataFrame) -> DataFrame:
    """NODE and the SHA-256 of its conversations' decimal ids, ascending, joined by commas.

    Range partitions sort and write the ids; a digest is made from pieces of text, so what one task has to read of a node
    with very many ends is the bytes that its hash function must see one after the other, and it holds one piece.
    """
    cut = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("ids", pa.string())])
    out = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])

    def write(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            part, seq, node, ids, size = TaskContext.get().partitionId(), 0, None, [], 0
            for b in stream:
                for *key, conv in zip(*(c.to_pylist() for c in b.columns)):
                    if ids and (key != node or size >= PIECE):
                        yield (*node, part, seq, ",".join(ids))
                        seq, ids, size = seq + 1, [], 0
                    node = key
                    ids.append(str(conv))
                    size += len(ids[-1]) + 1
            if ids:
                yield (*node, part, seq, ",".join(ids))

        return batches(rows(), cut, lambda r: 64 + len(r[5]))

    def digest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            node, state = None, None
            for b in stream:
                for *key, _, _, ids in zip(*(c.to_pylist() for c in b.columns)):
                    if key == node:
                        state.update(b"," + ids.encode())
                        continue
                    if node is not None:
                        yield (*node, state.hexdigest())
                    node, state = key, hashlib.sha256(ids.encode())
            if node is not None:
                yield (*node, state.hexdigest())

        return batches(rows(), out, lambda r: 128)

    order = [*NODE, "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "depth long, k1 long, k2 long, part int, seq long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part", "seq").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(rebuilt: DataFrame) -> DataFrame:
    """One row per node of the conversations that splice() returns, with its preorder interval (first, last)."""
    stepped = stored(rebuilt, "stepped")  # the scan reads it twice
    rows = running(stepped, ["conv", "depth"], {}, "conv", {"k1": "z1", "k2": "z2"}, name="prefixes")
    priority = F.struct(F.col("len"), F.xxhash64("conv").alias("hash"), F.col("conv"))
    above = [F.max(F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}"))).alias(f"p{i}") for i in (1, 2)]  # the same in all rows of a node, as words is
    nodes = stored(rows.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max(priority).alias("by"), F.max("words").alias("words"), *above)
                   .select(*NODE, "conv_id", "n_convs", "words", "p1", "p2", F.col("by.conv").alias("rep"), (F.col("by.len") == F.col("depth")).alias("leaf")), "nodes")
    # Paths in preorder: where along its representative's turns the nodes' representatives change.
    reps = nodes.where("leaf").select(F.col("rep").alias("conv"), F.col("depth").alias("end"), (F.col("depth") + 1).alias("n_rows"))
    along = stored(joined_hot(rows.select("conv", *NODE), reps, "conv", "n_rows").where(F.col("end").isNotNull()).select("conv", "n_rows", *NODE), "along")
    named = joined_hot(along, nodes.select(*NODE, "rep", "n_convs"), NODE, "n_convs")
    forks = named.groupBy("conv", "rep").agg(F.min("depth").alias("start"), F.max("n_rows").alias("n_rows"))
    links = forks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("start", "rep"))).alias("links"), F.max("n_rows").alias("n_rows"))
    paths = links.select("conv", "n_rows", F.element_at("links", -1)["start"].alias("start"), F.transform("links", lambda x: F.struct((-x["start"]).alias("up"), x["rep"].alias("rep"))).alias("key"))
    paths = stored(paths.withColumn("block", F.col("n_rows") - F.col("start")), "paths")
    summed = running(paths, ["key"], {"upto": "block"}, keep=["conv", "n_rows", "start", "block"], name="places")
    places = stored(summed.select("conv", "n_rows", "start", "block", (F.col("upto") - F.col("block")).alias("before"), (F.col("upto") - 1).alias("last")), "placed")
    # Intervals, and the running sums over places.
    ends = joined_hot(along.select("conv", *NODE), places.select("conv", "n_rows", "last"), "conv", "n_rows").groupBy(*NODE).agg(F.max("last").alias("last"))
    own = joined_hot(nodes, places.select(F.col("conv").alias("rep"), "start", "block", "before"), "rep", "block")
    placed = own.withColumn("first", F.col("before") + F.col("depth") - F.col("start")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).withColumn("is_leaf", F.col("leaf").cast("long"))
    placed = stored(placed.select(*NODE, "p1", "p2", "conv_id", "n_convs", "first", "saved", "is_leaf").join(ends, NODE), "intervals")
    sums = stored(running(placed, ["first"], {"leaves": "is_leaf", "saved_to": "saved"}, name="sums"), "summed")
    uses = sums.groupBy(F.col("last").alias("first")).agg(F.count("*").alias("uses"))
    at_end = sums.select("first", F.col("leaves").alias("leaves_end"), F.col("saved_to").alias("saved_end")).join(uses, "first").withColumnRenamed("first", "last")
    counted = joined_hot(sums, at_end, "last", "uses")
    n_leaves, saved = F.col("leaves_end") - F.col("leaves") + F.col("is_leaf"), F.col("saved_end") - F.col("saved_to") + F.col("saved")
    counted = counted.withColumn("n_leaves", n_leaves).withColumn("saved_tokens", saved)
    # Children and parents; the ids that end at a node.
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    full = stored(counted.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    up = full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    linked = joined_hot(full, up, ["depth", "p1", "p2"], "siblings")
    digests = stored(_end_digests(rows.where("depth = len")), "ends")
    out = linked.join(digests, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    discard(stepped, rows, along, paths, summed, places, nodes, placed, sums)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "first", "last")


def conversation_trie(turns: DataFrame, base: Column | None = None, shared: Column | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, first, last: one row per
    distinct prefix of turns (role, text), the root without turns included.

    turns has conv_id, turn, role, text. base and shared are expressions of conv_id: a conversation is rebuilt as the
    first `shared` (at most 3) turns of conversation base, all if it has fewer and none if there is no such conversation,
    and its own turns after its first `shared`. Without them conversations are taken as they are.

    Turns of a conversation are ordered by turn, null first, equal ones by role and text; a null role or text is empty;
    repeated rows are turns each. Rows with a null conv_id belong to no conversation and are left out. Other columns
    aren't read. An empty table gives no rows, not even a root. saved_tokens is what sharing saves in a node's subtree:
    its words `[^\\x20\\x09-\\x0D]+` times all but one of the conversations through it, summed; first and last are the
    places of the subtree in preorder. Places depend on hashes: they are the same in each run, but no sort by text.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    own = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    convs = own.groupBy("conv").agg(F.count("*").alias("n"))
    base = F.col("conv_id") if base is None else base
    shared = F.lit(0) if shared is None else shared
    convs = convs.select("conv", "n", F.col("conv").alias("conv_id")).select("conv", "n", base.cast("long").alias("base"), shared.cast("int").alias("h"))
    hashed = own.select("conv", "turn", "role", "text", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    numbered = running(hashed, order, {"pos": "one"}, "conv", keep=["conv", "t1", "t2", "words", "one"], name="turns")
    return trie(splice(numbered.drop("one"), stored(convs, "convs")))
