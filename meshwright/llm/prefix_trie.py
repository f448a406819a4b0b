"""The trie of conversations: every distinct sequence of first turns is a node, owned by the smallest conversation that starts with it.

As a conversation that is the smallest of a node is the smallest of all deeper nodes of its own, it owns a suffix of its path.  So one row a conversation (where its
suffix starts, the tokens before it, whether it ends in a leaf) tells what each of its turns adds to the node there, and one group-by of turns by prefix
sums occurrence tokens less owned tokens, leaves and children.  Owners are minima that are aggregated before they are shuffled and joined back
(popular nodes by broadcast), as a window over a node would put all its members into one task.

A prefix is named by 128 bits: the exclusive or of two hashes of (depth, role, text) over its turns, running within a conversation.  Running
values are made in blocks of a sort by conversation and turn, so one conversation may hold most of the turns.

Defined results: null role or text counts as empty; turns without a number come first; turns of one number come in the order of hashes of role and text, so repeated
rows are turns of their own; turns without a conv_id belong to no conversation and are left out; other columns are not read.  Without conversations there is no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hot_join, release, stored

#: Characters of ids that a chunk of a list of members holds at most.
CHUNK = 4000


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, ta and tb (hashes of role and text) and chars (code points of the text)."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("ta"), F.xxhash64(F.lit("turn"), text, role).alias("tb"), F.char_length(text).cast("long").alias("chars"),
    )


def sorted_blocks(rows: DataFrame, *order: str) -> DataFrame:
    """rows with at, their place in the order, and block, the part of the order that they are in; stored."""
    placed = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    return stored(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("block", F.shiftright("at", 33).cast("int")))


def running(rows: DataFrame, order: str, sums: dict[str, Column], mixes: dict[str, Column]) -> DataFrame:
    """rows (conv_id, block) with running sums and exclusive ors over each conversation in its order (blocks follow each other).

    Values run within a block of a conversation; what came before its block is added from the totals of earlier blocks.  Only
    conversations in several blocks have such, at most two a block, so these rows are broadcast.
    """
    within = Window.partitionBy("conv_id", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()], *[F.bit_xor(c).over(within).alias(n) for n, c in mixes.items()])
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.bit_xor(c).alias(n) for n, c in mixes.items()])
    spans = rows.groupBy("conv_id").agg(F.min("block").alias("_lo"), F.max("block").alias("_hi")).where("_lo < _hi").select("conv_id")
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.join(F.broadcast(spans), "conv_id", "left_semi")
    before = before.select("conv_id", "block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums], *[F.coalesce(F.bit_xor(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in mixes])
    out = local.join(F.broadcast(before), ["conv_id", "block"], "left")
    own = lambda n: F.coalesce(f"_{n}", F.lit(0).cast("long"))
    return out.select(*rows.columns, *[(F.col(n) + own(n)).alias(n) for n in sums], *[F.col(n).bitwiseXOR(own(n)).alias(n) for n in mixes])


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, block, depth, ta, tb, chars, n) and conversations (conv_id, n: turns), with first turns shared in groups of ids.

    Conversation c takes the first h = crc32(c) % heads turns of conversation c - c % group, then its own turns after its first h.
    """
    placed = sorted_blocks(turns(conversations), "conv_id", "turn", "ta", "tb")
    rows = stored(running(placed, "at", {"pos": F.lit(1).cast("long")}, {}).drop("at", "turn"))
    release(placed)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long")
    length = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"), F.min(F.when(F.col("pos") > h, F.col("block"))).alias("first"))
    length = length.select("conv_id", "own", F.coalesce("first", F.lit(-1)).alias("first"), h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    base = length.where(F.col("conv_id") == F.col("base")).select("base", F.col("own").alias("lent"))
    convs = length.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("lent", F.lit(0).cast("long"))))
    convs = stored(convs.select("conv_id", "own", "first", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long"))).alias("n")))
    kept = rows.where(F.col("pos") > h)
    own = hot_join(kept, convs.select("conv_id", "own", "taken", "h", "n"), "conv_id", "own", rows.count(), "pos").select("conv_id", "block", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "ta", "tb", "chars", "n")
    head = rows.where((F.col("pos") < heads) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "pos", "ta", "tb", "chars")
    lent = convs.where("taken > 0").join(head, "base").where("pos <= taken").select("conv_id", F.col("first").alias("block"), F.col("pos").alias("depth"), "ta", "tb", "chars", "n")
    return own.unionByName(lent), convs.select("conv_id", "n")


def digests(ends: DataFrame) -> DataFrame:
    """node and digest: SHA-256 of the ids (conv_id) of each node in ascending order, joined with commas.

    Ids are sorted over all tasks and written as chunks of text; each node's few chunks are hashed one after the other.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for a, b, c in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (a, b) != node or size > CHUNK:
                    if held:
                        out.append((*node, first, ",".join(held)))
                    node, first, held, size = (a, b), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, first, ",".join(held)), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                if (a, b) == node:
                    state.update(b",")
                else:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "digest"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "digest"])

    flat = ends.select("node.a", "node.b", "conv_id")
    texts = flat.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(chunks, "a long, b long, first long, ids string")
    out = texts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(hashed, "a long, b long, digest string")
    return out.select(F.struct("a", "b").alias("node"), "digest")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes over turns (conv_id, block, depth from 1, ta, tb, chars, n) of conversations (conv_id, n: turns, 0 for one without).

    Per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    zero = F.lit(0).cast("long")
    known = running(rows, "depth", {"upto": F.col("chars")}, {"a": F.xxhash64("depth", "ta", "tb"), "b": F.xxhash64("tb", "depth", "ta")})
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("before"), "n")
    places = known.select("conv_id", "depth", "a", "b", (F.col("upto") - F.col("chars")).alias("before"), "n").unionByName(root)
    places = stored(places.select("conv_id", "depth", F.struct("a", "b").alias("node"), "before", "n"))
    total = places.count()

    owners = stored(places.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.when(F.col("depth") == F.col("n"), 1).otherwise(0)).alias("n_ends")))
    owned = stored(hot_join(places, owners, "node", "n_convs", total, "conv_id"))
    release(places, owners)
    mine, end = F.col("owner") == F.col("conv_id"), F.col("depth") == F.col("n")
    deepest = F.when(~mine, F.struct("depth", "owner"))
    suffix = owned.groupBy("conv_id").agg(
        F.min(F.when(mine, F.struct("depth", "before"))).alias("s"), F.max(deepest).alias("up"), F.max(F.when(mine & end & (F.col("n_convs") == F.col("n_ends")), 1).otherwise(0)).alias("leaf"), F.count(F.lit(1)).alias("_rows"),
    )
    # a conversation that owns nothing shares all its tokens
    tokens = rows.groupBy("conv_id").agg(F.sum("chars").alias("tokens"))
    suffix = suffix.join(tokens, "conv_id", "left").select("conv_id", "_rows", F.coalesce("s.depth", F.lit((1 << 62))).alias("start"), F.coalesce("s.before", "tokens", zero).alias("shared"), F.col("up.owner").alias("up"), "leaf")
    told = hot_join(owned, stored(suffix), "conv_id", "_rows", total, "depth")
    parent = F.when(mine & (F.col("depth") > 0), F.when(F.col("depth") > F.col("start"), F.col("conv_id")).otherwise(F.col("up")))
    child = (F.col("depth") + 1 >= F.col("start")) & (F.col("depth") < F.col("n"))
    nodes = told.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max(parent).alias("parent_conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(child.cast("long")).alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.greatest(F.col("shared") - F.col("before"), zero)).alias("saved_tokens"), F.max("n_ends").alias("n_ends"), F.min(F.when(end, F.col("conv_id"))).alias("end"),
    )
    many = digests(owned.where(end & (F.col("n_ends") > 1)).select("node", "conv_id"))
    one = F.sha2(F.when(F.col("n_ends") == 1, F.col("end").cast("string")).otherwise("").cast("binary"), 256)
    return nodes.join(many, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("digest", one).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes over conversations (conv_id, turn, role, text) as they stand."""
    placed = sorted_blocks(turns(conversations), "conv_id", "turn", "ta", "tb")
    rows = stored(running(placed, "at", {"depth": F.lit(1).cast("long")}, {}).drop("at", "turn"))
    convs = stored(rows.groupBy("conv_id").agg(F.max("depth").alias("n")))
    release(placed)
    return trie(stored(hot_join(rows, convs, "conv_id", "n", rows.count(), "depth")), convs)


def shared_trie(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The nodes over conversations whose first turns are shared in groups of ids (``rebuilt``)."""
    rows, convs = rebuilt(conversations, group, heads)
    return trie(stored(rows), stored(convs))
