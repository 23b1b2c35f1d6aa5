"""Trie of the prefixes that conversations share, by prefix doubling.

1. Turns: each distinct (role, text) is a digest; a conversation is digests in order of turn, placed by a range sort over all
   conversations, so a long one is many tasks' work.
2. Names: blocks of 2**k turns at multiples of 2**k get dense numbers, in the order of their pairs of halves' numbers; a missing
   half is 0. A round joins halves and ranks the distinct pairs; after as many rounds as the longest conversation has binary digits,
   a conversation's one block is its rank among the distinct conversations, as in a dictionary.
3. Prefixes: d turns are the blocks of d's binary digits, largest first, so their names, one for each 1 in d, name the prefix.
   Rounds from the largest block down put each prefix together from the shorter one and one block.
4. Nodes are groups of (d, names). A node's conversations are a range of ranks, so nodes in order of (first rank, d) are in
   preorder, and sums over subtrees are differences of one running sum.

Keys that hold a large part of all rows (a first turn that most conversations share) are aggregated before they move, or their few table
rows are broadcast. The ids that end at a node are joined in pieces of `PIECE`, in parallel, before their digest, which only one
task can make, runs over the pieces.

Null roles and texts are empty ones; a null turn comes first, equal turns in the order of their digests. Rows without conversation id
are one conversation, whose id is null: it counts as a member, comes after all ids as the smallest, and isn't listed among the ends.
Repeated rows are turns of their own. An empty table gives no nodes. Other columns aren't read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm._common import in_order, lookup, shuffle_partitions, staged

#: Conversation ids joined into one row before a node's digest.
PIECE = 4096


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1, in order of turn), said (digest of role and text) and chars (code points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = conversations.select("conv_id", "turn", F.unhex(said).alias("said"), F.length(text).cast("long").alias("chars"))
    rows = in_order(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("said")])
    first = staged(rows.groupBy("conv_id").agg(F.min("row").alias("first")), "first-turns")
    rows = lookup(rows.withColumn("null", F.col("conv_id").isNull()).withColumn("c", F.coalesce("conv_id", F.lit(0))), first.select(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("null"), "first"), ("c", "null"))
    return rows.select("conv_id", (F.col("row") - F.col("first") + 1).alias("place"), "said", "chars")


def rebuilt(turns: DataFrame, share: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation c begins with the first h turns of conversation c - c % share (of all that it has), then has its own after its first h; h = crc32 of c % most.

    A null c isn't rebuilt.
    """
    conversations = staged(turns.select("conv_id").distinct(), "conversations")
    h = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, F.lit(0))
    own = turns.where(F.col("place") > h)
    shared = turns.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "said", "chars")  # a few for each base
    wanted = conversations.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % share)
    taken = staged(wanted.join(shared, "base").where(F.col("place") <= F.col("h")).select("conv_id", "place", "said", "chars"), "taken-turns")
    had = taken.groupBy("conv_id").agg(F.max("place").alias("had"))  # the base may have fewer than h
    # turns after the first h move up where the base had fewer
    moved = wanted.join(had, "conv_id", "left").select("conv_id", (F.col("h") - F.coalesce("had", F.lit(0))).alias("up")).where("up > 0")
    moved = staged(moved, "moved")
    own = lookup(own, moved, ("conv_id",)).withColumn("place", F.col("place") - F.coalesce("up", F.lit(0))).drop("up")
    return conversations, staged(taken.unionByName(own.select("conv_id", "place", "said", "chars")), "rebuilt-turns")


def _ranked(pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The distinct rows of these columns with their dense rank from 1, in column name."""
    distinct = pairs.select(*columns).distinct()
    return in_order(distinct, [F.col(c) for c in columns]).select(*columns, (F.col("row") + 1).alias("name"))


class Trie:
    """nodes: node (number in preorder), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points of last texts said again, over the subtree). ends: node, conv_id of each conversation at its node."""

    def __init__(self, nodes: DataFrame, ends: DataFrame):
        self.nodes, self.ends = nodes, ends


def _blocks(turns: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(levels, ranks): for each level c, t, name of its blocks; c and rank of each conversation that has turns."""
    names = staged(_ranked(turns, ("said",)), "turn-names")
    level = staged(lookup(turns, names, ("said",)).select("c", (F.col("place") - 1).alias("t"), "name"), "blocks")
    levels = [level]
    while level.where("t > 0").head(1):
        halves = level.groupBy("c", F.shiftright("t", 1).alias("t")).agg(F.max(F.when(F.col("t") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("t") % 2 == 1, F.col("name"))), F.lit(0)).alias("b"))
        halves = staged(halves, "halves")
        names = staged(_ranked(halves, ("a", "b")), "block-names")
        level = staged(lookup(halves, names, ("a", "b")).select("c", "t", "name"), "blocks")
        levels.append(level)
    return levels, level.select("c", F.col("name").alias("rank"))


def _prefixes(levels: list[DataFrame], turns: DataFrame) -> DataFrame:
    """c, d, key of all prefixes: key holds the names of d's blocks."""
    wanted = turns.select("c", F.col("place").alias("d"))
    found = None
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        # prefixes whose least binary digit is this one: a shorter prefix and a block of this level
        own = wanted.where(F.col("d") % (2 * size) == size)
        blocks = levels[k].where("t % 2 = 0").select("c", ((F.col("t") + 1) * size).alias("d"), "name")
        own = own.join(blocks, ["c", "d"])
        if found is not None:
            shorter = found.select("c", (F.col("d") + size).alias("d"), F.col("key").alias("head"))
            own = own.join(shorter, ["c", "d"], "left")
            own = own.select("c", "d", F.concat(F.coalesce("head", F.array().cast("array<bigint>")), F.array("name")).alias("key"))
            found = staged(found.unionByName(own), "prefixes")
        else:
            found = staged(own.select("c", "d", F.array("name").alias("key")), "prefixes")
    return found


def build(conversations: DataFrame, turns: DataFrame) -> Trie:
    """The trie of these conversations (conv_id, each once, turnless ones too) and their turns (conv_id, place from 1 without gaps, said, chars)."""
    spark = conversations.sparkSession
    null = F.col("conv_id").isNull()
    # numbers of their own, in the order of ids with null last: c
    numbered = staged(in_order(conversations.select("conv_id"), [F.col("conv_id").asc_nulls_last()]).select("conv_id", F.col("row").alias("c")), "numbered")
    ids = numbered.select("c", F.col("conv_id").alias("id"))
    rows = turns.withColumn("null", null).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))
    table = numbered.withColumn("null", null).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))
    rows = staged(lookup(rows, table, ("conv_id", "null")).select("c", "place", "said", "chars"), "turns")
    levels, ranks = _blocks(rows)
    ranks = staged(numbered.select("c").join(ranks, "c", "left").select("c", F.coalesce("rank", F.lit(0)).alias("rank")), "ranks")
    prefixes = _prefixes(levels, rows)
    # every conversation starts with no turns
    members = rows.select("c", F.col("place").alias("d"), "chars").join(prefixes, ["c", "d"])
    root = numbered.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("chars"), F.array().cast("array<bigint>").alias("key"))
    members = staged(lookup(members.unionByName(root), ranks, ("c",)), "members")
    groups = members.groupBy("d", "key").agg(F.count("*").alias("n_convs"), F.min("c").alias("least"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.max("chars").alias("chars"))
    groups = staged(groups, "groups")
    # the parent: what the smallest member's shorter prefix is
    shorter = members.select(F.col("c").alias("least"), (F.col("d") + 1).alias("d"), F.col("key").alias("parent_key"))
    childed = staged(groups.join(shorter, ["least", "d"], "left"), "children")
    counted = childed.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("parent_key").alias("key")).agg(F.count("*").alias("n_children"))
    parents = groups.select((F.col("d") + 1).alias("d"), F.col("key").alias("parent_key"), F.col("least").alias("parent_least"))
    nodes = lookup(childed, parents, ("d", "parent_key"))
    nodes = nodes.join(staged(counted, "child-counts"), ["d", "key"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", ((F.col("n_convs") - 1) * F.col("chars")).cast("long"))
    nodes = staged(in_order(nodes.drop("parent_key"), [F.col("low"), F.col("d")], ("leaf", "saved")), "nodes")
    # sums over all nodes up to a rank's last one; each rank's own conversation ends at a node of that rank
    upto = nodes.groupBy("low").agg(F.max(F.col("before_leaf") + F.col("leaf")).alias("leaves_upto"), F.max(F.col("before_saved") + F.col("saved")).alias("saved_upto"))
    upto = staged(upto.withColumnRenamed("low", "high"), "upto")
    nodes = lookup(nodes, upto, ("high",))
    nodes = nodes.withColumn("n_leaves", F.col("leaves_upto") - F.col("before_leaf")).withColumn("saved_tokens", F.col("saved_upto") - F.col("before_saved"))
    nodes = staged(nodes.select(F.col("row").alias("node"), F.col("d").alias("depth"), "key", "least", "parent_least", "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie")
    # where each conversation ends
    last = members.groupBy("c").agg(F.max("d").alias("d"))
    ends = last.join(members.select("c", "d", "key"), ["c", "d"])
    ends = lookup(ends, nodes.select(F.col("depth").alias("d"), "key", "node"), ("d", "key")).join(ids, "c").select("node", F.col("id").alias("conv_id"))
    named = lookup(nodes, ids.withColumnRenamed("c", "least").withColumnRenamed("id", "conv_id"), ("least",))
    named = lookup(named, ids.withColumnRenamed("c", "parent_least").withColumnRenamed("id", "parent_conv_id"), ("parent_least",))
    return Trie(named.select("node", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), staged(ends, "ends"))


def _digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256: the digest of its ids in order, comma-joined, for nodes that have any."""
    rows = in_order(ends.where("conv_id is not null").select("node", "conv_id"), [F.col("node"), F.col("conv_id")])
    pieces = rows.groupBy("node", F.floor(F.col("row") / PIECE).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    pieces = pieces.repartition(shuffle_partitions(ends.sparkSession), "node").sortWithinPartitions("node", "piece")

    def work(batches):
        node, digest = None, None
        for batch in batches:
            nodes, out = [], []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own == node:
                    digest.update(b",")
                else:
                    if digest is not None:
                        nodes.append(node)
                        out.append(digest.hexdigest())
                    node, digest = own, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.string())], ["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    return pieces.select("node", "ids").mapInArrow(work, "node long, ends_sha256 string")


def trie(conversations: DataFrame) -> Trie:
    """The trie of a table of conversations (conv_id, turn, role, text) as they are."""
    turns = staged(turns_of(conversations), "placed-turns")
    return build(turns.select("conv_id").distinct(), turns)


def trie_digest(conversations: DataFrame) -> DataFrame:
    """Query op12: the trie of the rebuilt conversations."""
    found = build(*rebuilt(staged(turns_of(conversations), "placed-turns")))
    out = found.nodes.join(_digests(found.ends), "node", "left")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.select(*[F.col(c).cast("long").alias(c) for c in columns], F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
