"""Conversation prefix trie: which first turns conversations share, and what sharing them would save.

Conversations are sequences of turns (conv_id, depth from 1, turn digest, bytes of the text). A prefix has a
chained SHA-256 digest: each turn's is that of the one before with the turn's own. Every conversation is
exploded into its prefixes; a node is a group of equal (depth, digest). Chains run in blocks of BLOCK turns:
the digest at a full block's end is the chain of the digests of blocks, by the same rule one level up, so
that a conversation of any length is chained by many tasks and equal prefixes still have equal digests.

Subtree sums: each node goes to all its ancestors on the path of its smallest member. What one path sends to
one ancestor is added up on the path before (sums from the end, in blocks too), so that the explosion has a
row for each conversation and depth instead of one for each pair of nodes, and then grouped by ancestor.

Texts never leave the first pass: shuffles have a digest and a length for each turn.

Defined results: null turns come first; turns equal in `turn` are ordered by the digest of role and text, rows
equal in all are turns of their own. Null roles and texts are empty. Rows without conv_id are left out. A
conversation without turns is a member of the root only. Without any conversations there are no nodes, not
even the root. Extra columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm import common as C

#: Turns of one block, of a chain and of sums.
BLOCK = 64
#: Ids of one part of a node's list of members: those that are equal after division by this number.
ID_RANGE = 1024

_NO_MEMBERS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column | str, text: Column | str) -> Column:
    """SHA-256 of role and text, unmistakable where one ends and the other begins."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)


def placed(rows: DataFrame) -> DataFrame:
    """(conv_id, place from 1, turn digest, n_bytes) of rows (conv_id, turn, role, text).

    Places are counted within ranges of the sorted rows and moved on by what ranges before hold of the same
    conversation, so that a conversation of any length is numbered by many tasks.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    base = rows.where("conv_id is not null").select("conv_id", "turn", turn_digest("role", "text").alias("digest"), size.alias("n_bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    ranged = base.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order)
    ranged = C.stored(ranged.withColumn("range", F.spark_partition_id()).drop("row"), "turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    # a row for each range of a conversation: as many as there are tasks at most
    starts = counts.select("conv_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    return ranged.withColumn("inside", inside).join(starts, ["conv_id", "range"]).select("conv_id", (F.col("start") + F.col("inside")).alias("place"), "digest", "n_bytes")


def _blocks(rows: DataFrame, values: list[str]) -> DataFrame:
    """Rows (conv_id, i, values) as sorted arrays of at most BLOCK rows: (conv_id, block, rows)."""
    block = F.expr(f"i div {BLOCK}")
    return rows.groupBy("conv_id", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", *values))).alias("rows"))


def chained(rows: DataFrame) -> DataFrame:
    """Add prefix and parent, digests of the turns up to each row and up to the one before ('' for none), to rows (conv_id, i from 0, digest, n_bytes)."""
    blocks = C.stored(_blocks(rows, ["digest", "n_bytes"]).withColumn("flat", F.sha2(F.concat_ws("", F.col("rows.digest")), 256)), "blocks")
    most = blocks.agg(F.max("block")).first()[0]
    if most:
        above = blocks.select("conv_id", F.col("block").alias("i"), F.col("flat").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
        above = chained(above).select("conv_id", F.col("i").alias("block"), F.col("prefix").alias("whole"), F.col("parent").alias("start"))
        blocks = blocks.join(above, ["conv_id", "block"])
    else:
        blocks = blocks.withColumns({"whole": F.sha2("flat", 256), "start": F.lit("")})
    chain = F.aggregate("rows", F.array(F.col("start")), lambda done, r: F.concat(done, F.array(F.sha2(F.concat(F.element_at(done, -1), r["digest"]), 256))))
    links = blocks.withColumn("chain", chain)
    at = lambda k: F.get("chain", k)
    pairs = F.transform("rows", lambda r, k: F.struct(r["i"].alias("i"), r["n_bytes"].alias("n_bytes"), F.when(k == BLOCK - 1, F.col("whole")).otherwise(at(k + 1)).alias("prefix"), at(k).alias("parent")))
    return links.select("conv_id", F.inline(pairs))


def sums_from_end(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows (conv_id, i from 0, values) with each value replaced by its sum over this row and all after it."""
    blocks = C.stored(_blocks(rows, values), "sums")
    most = blocks.agg(F.max("block")).first()[0]
    sums = [F.aggregate(f"rows.{v}", F.lit(0).cast("long"), lambda a, x: a + x).alias(v) for v in values]
    after = {f"after_{v}": F.lit(0).cast("long") for v in values}
    if most:
        above = sums_from_end(blocks.select("conv_id", F.col("block").alias("i"), *sums), values)
        above = above.select("conv_id", (F.col("i") - 1).alias("block"), *[F.col(v).alias(f"after_{v}") for v in values])
        blocks = blocks.join(above, ["conv_id", "block"], "left").withColumns({f"after_{v}": F.coalesce(f"after_{v}", F.lit(0)) for v in values})
    else:
        blocks = blocks.withColumns(after)
    # sums of the array's ends: the last first
    ends = lambda v: F.aggregate(F.reverse(f"rows.{v}"), F.array(F.col(f"after_{v}")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
    with_ends = blocks.withColumns({f"ends_{v}": F.reverse(ends(v)) for v in values})
    return with_ends.select("conv_id", F.inline(F.transform("rows", lambda r, k: F.struct(r["i"].alias("i"), *[F.get(f"ends_{v}", k).alias(v) for v in values]))))


def member_digests(members: DataFrame) -> DataFrame:
    """(depth, prefix, ends_sha256): SHA-256 of the ascending conv_ids, comma-joined, of members (depth, prefix, conv_id).

    A list is made in parts of ID_RANGE ids at most; where a node has several, they are hashed one after another as they stream by.
    """
    part = F.expr(f"floor(conv_id / {ID_RANGE})")
    parts = members.groupBy("depth", "prefix", part.alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    counted = parts.groupBy("depth", "prefix").agg(F.count("*").alias("n"), F.first("ids").alias("ids"))
    counted = C.stored(counted, "ends")
    one = counted.where("n = 1").select("depth", "prefix", F.sha2("ids", 256).alias("ends_sha256"))
    several = parts.join(counted.where("n > 1").select("depth", "prefix"), ["depth", "prefix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for depth, prefix, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "prefix", "ids")), strict=True):
                if node != (depth, prefix):
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, prefix), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _rows(done)
        if node:
            yield _rows([(*node, state.hexdigest())])

    def _rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)], names=["depth", "prefix", "ends_sha256"])

    C.small_batches(members.sparkSession)
    ordered = several.select("depth", "prefix", "part", "ids").repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "part")
    return one.unionByName(ordered.mapInArrow(run, "depth long, prefix string, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, prefix, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations (conv_id, distinct); turns (conv_id, depth from 1 without gaps, digest, n_bytes).
    saved_tokens: what a node's members but one have of bytes in its last turn, over its subtree.
    """
    paths = C.stored(chained(turns.select("conv_id", (F.col("depth") - 1).alias("i"), "digest", "n_bytes")).select("conv_id", (F.col("i") + 1).alias("depth"), "prefix", "parent", "n_bytes"), "paths")
    nodes = paths.groupBy("depth", "prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"))
    nodes = C.stored(nodes, "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "prefix"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = C.stored(nodes, "counted")
    own = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"))
    sent = paths.join(own, ["conv_id", "depth"], "left").select("conv_id", "depth", "prefix", *[F.coalesce(v, F.lit(0).cast("long")).alias(v) for v in ("n_leaves", "saved_tokens")])
    summed = sums_from_end(sent.select("conv_id", (F.col("depth") - 1).alias("i"), "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    summed = summed.select("conv_id", (F.col("i") + 1).alias("depth"), "n_leaves", "saved_tokens").join(paths.select("conv_id", "depth", "prefix"), ["conv_id", "depth"])
    totals = summed.groupBy("depth", "prefix").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    lengths = paths.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    lengths = C.stored(conversations.join(lengths, "conv_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0).cast("long"))), "lengths")
    last = paths.select("conv_id", "depth", "prefix").join(lengths, ["conv_id", "depth"])
    ends = member_digests(last.unionByName(lengths.where("depth = 0").withColumn("prefix", F.lit(""))))
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    top = nodes.where("depth = 1").agg(F.count("*").alias("n_children"))
    # a trie without turns has one node, which is a leaf
    all_sums = own.agg(F.coalesce(F.sum("n_leaves"), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).cast("long").alias("saved_tokens"))
    whole = root.crossJoin(top).crossJoin(all_sums).select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("prefix"), F.lit(None).cast("string").alias("parent"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    rest = nodes.join(totals, ["depth", "prefix"]).select("conv_id", "depth", "prefix", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens")
    trie = C.stored(rest.unionByName(whole), "trie")
    # a parent of very many children is dealt anew by adaptive execution: both sides are shuffled
    parents = trie.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = trie.join(parents.hint("merge"), ["depth", "parent"], "left")
    found = named.join(ends, ["depth", "prefix"], "left")
    return found.select("conv_id", "depth", "prefix", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NO_MEMBERS)).alias("ends_sha256"))


def regenerated(rows: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as that of their group's base does, as when answers are regenerated from a point on.

    Conversation c has the first h = crc32(c) % heads turns of conversation c - c % group, then its own from
    place h + 1 on. Gives (conversations, turns) for prefix_trie.
    """
    turns = C.stored(placed(rows), "placed")
    conversations = C.stored(rows.where("conv_id is not null").select("conv_id").distinct(), "conversations")
    base = F.col("conv_id") - F.col("conv_id") % group
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    named = conversations.select("conv_id", base.alias("base"), head.alias("head"))
    # at most heads - 1 turns of a base, for at most 2 * group - 1 conversations
    first = turns.where((F.col("place") < heads) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), "place", "digest", "n_bytes")
    shared = named.join(first, "base").where("place <= head")
    n_shared = C.stored(named.join(first.groupBy("base").agg(F.max("place").alias("n")), "base", "left").select("conv_id", "head", F.least("head", F.coalesce("n", F.lit(0))).alias("taken")), "heads")
    own = turns.join(n_shared.hint("merge"), "conv_id").where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).cast("long").alias("depth"), "digest", "n_bytes")
    both = shared.select("conv_id", F.col("place").cast("long").alias("depth"), "digest", "n_bytes").unionByName(own)
    return conversations, C.stored(both, "rebuilt")
