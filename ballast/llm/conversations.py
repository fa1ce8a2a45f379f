"""The prefix trie of conversations, by collapse of whole sequences.

Rebuilt conversations that are identical collapse into one *sequence* with a weight, the list of the conversations that end there, and a
representative, the smallest of them. Sequences that are proper prefixes of others are no leaves; an anti-join finds those
that are. The prefixes of the sequences, weighted, are the nodes of the trie, and sums over prefixes give all counts: what
a subtree adds up to is the sum, over the sequences through its top, of what each owns from there on, where a node is owned
by the sequence with its smallest member. No step goes through the trie level by level.

A prefix is known by two sums of 64-bit hashes of (place, role, text), which grow along the conversation; the hash of a turn is
taken from SHA-256 of role and text. Such sums need no order inside one task: a conversation may have any number of turns, as totals
of its blocks (``plans/blocks.py``) carry them on. Prefixes that many sequences share meet a broadcast join.

Defined results: turns are in the order of their number, null first; turns of one number in that of the SHA-256 of role and text,
and identical ones count as often as they occur. Null roles and texts are empty. Rows without a conv_id belong to no
conversation and are left out. Without any conversation there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import at_most
from ballast.plans.blocks import BLOCK, block_totals, range_blocks, running_totals
from ballast.plans.scratch import materialize
from ballast.plans.skew import hot_keys, join_by_key

#: Conversations share the head of the first of their hundred, of less than six turns by the CRC of their id.
FAMILY = 100
HEADS = 6

#: A node is hot in a join from so many rows on, or more in large tables (``plans/skew.py``).
HOT_ROWS = 2_000

CONV = "conv_id"
NODE = ["depth", "k1", "k2"]
PARENT = ["parent_depth", "p1", "p2"]
EMPTY_SHA256 = hashlib.sha256().hexdigest()


@dataclass
class Trie:
    """``turns``: (conv_id, block, pos, k1, k2, chars) of all rebuilt conversations, with a row at ``pos`` -1 for the start of each;
    ``sequences``: (length, k1, k2, weight, conv_id, is_leaf, ends_sha256) of the distinct ones;
    ``ends``: (length, k1, k2, conv_id), the end lists as rows; ``nodes``: see :func:`prefix_nodes`."""

    turns: DataFrame
    sequences: DataFrame
    ends: DataFrame
    nodes: DataFrame


def hex_number(digits: Column, begin: int) -> Column:
    return F.conv(F.substring(digits, begin, 15), 16, 10).cast("bigint")


def rebuild(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(conv_id, block, pos, e1, e2, chars) of the turns of all rebuilt conversations; pos -1 is the start of each. Written out.

    Of conversation c the first h turns are those of the first conversation of its family, ``c - c % family``, the others
    its own behind its first h, with ``h = crc32(c) % heads``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.where(F.col(CONV).isNotNull()).select(CONV, "turn", F.length(text).cast("bigint").alias("chars"), digest.alias("_sha"))
    turns = turns.select(CONV, "turn", "chars", hex_number(F.col("_sha"), 1).alias("d1"), hex_number(F.col("_sha"), 16).alias("d2"))
    order = [F.col(c) for c in ("turn", "d1", "d2")]
    blocked = range_blocks(turns, [CONV], order, "turns")
    one = {"place": F.expr("1L")}
    blocks = materialize(block_totals(blocked, [CONV], one, whole=["place"]), "blocks")
    known = blocks.groupBy(CONV).agg(F.max("place_whole").alias("n"))
    known = known.select(
        CONV, "n", F.pmod(F.crc32(F.col(CONV).cast("string")), F.lit(heads)).alias("h"), (F.col(CONV) - F.col(CONV) % family).alias("base")
    )
    first = known.select(F.col(CONV).alias("base"), F.col("n").alias("_base_n"))
    known = known.join(first, "base", "left").withColumn("from_base", F.least("h", F.coalesce("_base_n", F.lit(0).cast("bigint"))))
    known = materialize(known.select(CONV, "base", "h", "from_base"), "conversations")

    context = blocks.select(CONV, BLOCK, "place_before").join(known.select(CONV, "h", "from_base"), CONV)
    placed = running_totals(blocked, [CONV], order, one, context)
    own = placed.where("place_before >= h").selectExpr(CONV, BLOCK, "place_before - h + from_base as pos", "d1", "d2", "chars")
    head = placed.where((F.col("place_before") < heads - 1) & (F.col(CONV) % family == 0))
    head = head.select(F.col(CONV).alias("base"), F.col("place_before").alias("pos"), "d1", "d2", "chars")
    lent = known.where("from_base > 0").join(head, "base").where("pos < from_base")
    lent = lent.selectExpr(CONV, f"-1 as {BLOCK}", "pos", "d1", "d2", "chars")

    def element(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), F.col("pos").cast("bigint"), "d1", "d2").cast("decimal(20,0)")

    elements = own.unionByName(lent).select(CONV, BLOCK, "pos", element(1).alias("e1"), element(2).alias("e2"), "chars")
    start = known.selectExpr(
        CONV, f"-2 as {BLOCK}", "-1L as pos", "cast(0 as decimal(20,0)) as e1", "cast(0 as decimal(20,0)) as e2", "0L as chars"
    )
    return materialize(elements.unionByName(start), "rebuilt")


def end_digests(ends: DataFrame) -> DataFrame:
    """(length, k1, k2, ends_sha256) of the lists of conversations (length, k1, k2, conv_id), in order and joined by commas.

    Lists are put together block by block. One that lies in several blocks is hashed as a stream of its blocks, so the task
    that does it holds one block at a time.
    """
    keys = ["length", "k1", "k2"]
    blocked = range_blocks(ends, keys, [F.col(CONV)], "ends")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(CONV)), lambda c: c.cast("string")), ",")
    pieces = materialize(blocked.groupBy(*keys, BLOCK).agg(listed.alias("piece")), "pieces")
    lists = pieces.groupBy(*keys).agg(F.count("*").alias("n"), F.min("piece").alias("piece"))
    short = lists.where("n = 1").select(*keys, F.sha2("piece", 256).alias("ends_sha256"))
    long = pieces.join(at_most(lists.where("n > 1").select(*keys)), keys, "left_semi")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for batch in batches:
            out = []
            for *key, piece in batch[[*keys, "piece"]].itertuples(index=False):
                if key != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.encode())
            yield pd.DataFrame(out, columns=[*keys, "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*keys, "ends_sha256"])

    streamed = long.repartition(*keys).sortWithinPartitions(*keys, BLOCK).mapInPandas(read, short.schema)
    return short.unionByName(streamed)


def build_trie(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS, hot_rows: int = HOT_ROWS) -> Trie:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text)."""
    turns = rebuild(conversations, family, heads)
    sums = {"k1": F.col("e1"), "k2": F.col("e2"), "length": F.expr("if(pos < 0, 0L, 1L)")}
    blocks = materialize(block_totals(turns, [CONV], sums, whole=list(sums)), "sums")
    keys = ["length", "k1", "k2"]
    ends = blocks.groupBy(CONV).agg(*[F.max(f"{c}_whole").alias(c) for c in keys])
    ends = materialize(ends.select(*keys, CONV), "sequence-ends")
    sequences = materialize(ends.groupBy(*keys).agg(F.count("*").alias("weight"), F.min(CONV).alias(CONV)), "sequences")

    # The prefixes of the representatives; blocks of other conversations have no context and are left out.
    context = blocks.select(CONV, BLOCK, "k1_before", "k2_before").join(sequences.select(CONV, "weight", F.col("length").alias("whole")), CONV)
    order = [F.col("pos")]
    prefixes = running_totals(turns, [CONV], order, {"k1": F.col("e1"), "k2": F.col("e2")}, context)
    prefixes = prefixes.selectExpr(
        CONV, BLOCK, "pos + 1 as depth", "k1_before + e1 as k1", "k2_before + e2 as k2",
        "pos as parent_depth", "k1_before as p1", "k2_before as p2", "chars", "weight", "whole",
    )
    prefixes = materialize(prefixes, "prefixes")

    proper = prefixes.where("depth < whole").select(F.col("depth").alias("length"), "k1", "k2").distinct()
    leaves = sequences.join(proper, keys, "left_anti").select(CONV, F.lit(True).alias("is_leaf"))
    sequences = sequences.join(leaves, CONV, "left").withColumn("is_leaf", F.coalesce("is_leaf", F.lit(False)))
    sequences = materialize(sequences.join(end_digests(ends), keys), "sequences")
    return Trie(turns, sequences, ends, prefix_nodes(prefixes, sequences, hot_rows))


def prefix_nodes(prefixes: DataFrame, sequences: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(depth, k1, k2, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    nodes = prefixes.groupBy(*NODE).agg(F.sum("weight").alias("n_convs"), F.min(CONV).alias("least"), F.count("*").alias("n"))
    nodes = materialize(nodes, "nodes")
    n_rows = prefixes.count()
    limit = max(hot_rows, n_rows // 10_000)  # so there are 10,000 hot nodes at most for each depth that they have
    hot = nodes.where(F.col("n") > limit).select(*NODE)
    owned = join_by_key(prefixes, nodes.select(*NODE, "least", "n_convs"), NODE, hot)
    owned = owned.withColumn("own", F.expr(f"if({CONV} = least, (n_convs - 1) * chars, 0L)"))
    owned = materialize(owned, "owned")

    totals = {"own": F.col("own")}
    context = block_totals(owned, [CONV], totals, whole=["own"]).drop("own")
    context = context.join(sequences.select(CONV, F.col("is_leaf").cast("bigint").alias("leaf")), CONV)
    rows = running_totals(owned, [CONV], [F.col("depth")], totals, context)
    found = rows.groupBy(*NODE).agg(
        F.min("least").alias(CONV), F.min("n_convs").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("own_whole") - F.col("own_before")).alias("saved_tokens"), *[F.min(c).alias(c) for c in PARENT],
    )
    found = materialize(found, "subtrees")

    tops = found.select(*[F.col(c).alias(p) for c, p in zip(NODE, PARENT, strict=True)], F.col(CONV).alias("parent_conv_id"))
    below = found.where("depth > 0")
    linked = join_by_key(below, tops, PARENT, hot_keys(below, PARENT, n_rows, hot_rows))
    linked = linked.unionByName(found.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(found.schema[CONV].dataType)))
    children = below.groupBy(*PARENT).agg(F.count("*").alias("n_children"))
    children = children.select(*[F.col(p).alias(c) for c, p in zip(NODE, PARENT, strict=True)], "n_children")
    ends = sequences.select(F.col("length").alias("depth"), "k1", "k2", "ends_sha256")
    return (
        linked.join(children, NODE, "left")
        .join(ends, NODE, "left")
        .select(
            *NODE, CONV, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
        )
    )


def conversation_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the trie."""
    nodes = build_trie(conversations.select(CONV, "turn", "role", "text")).nodes
    whole = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes.select(CONV, F.col("depth").cast("bigint").alias("depth"), *[F.col(c).cast("bigint").alias(c) for c in whole], "ends_sha256")
