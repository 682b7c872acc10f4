"""Prefix trie of conversations by fixed-length block hashing.

Turns are hashed and cut into blocks of BLOCK turns. A conversation's prefix up to the end of a block has a digest made of
the digests of its blocks, so conversations are grouped by successive block digests first, whole blocks at a time, without
a pass per depth. Equal blocks after equal prefixes are kept once, with the number of their conversations. Only where a
prefix goes on in several different blocks are turn boundaries worked out inside those blocks; a block without siblings is
a chain of nodes with the same members.

Subtree totals follow parents by doubling their distance: after k rounds a node holds the totals of all descendants less
than 2^k below it. Nodes of one conversation have no shared text and one leaf, so they take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borewatch.llm.common import join_hubs, materialise, running
from borewatch.operators.ordering import KeyedSeries

#: Turns of a block; blocks whose running digests are summed in one task; ids of one piece of a node's list of ends.
BLOCK, BUCKET, PIECE = 4, 256, 1024
ROOT = "root"


def rebuilt(
    conversations: DataFrame,
    *,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    family: int = 5,
    most: int = 9,
) -> DataFrame:
    """Turns (conv_id, n_turns, pos, mark, size) after each conversation took over the beginning of another.

    Conversation c starts with the first h turns of conversation c - c % family (all if fewer, none if absent), followed
    by its own turns after its first h; h is the unsigned crc32 of c in decimal, modulo `most`. Turns stand by `turn`,
    null first, equal ones by role and then by MD5 of the text; null roles and texts are empty. pos counts from 0, mark
    identifies role and text (128 bits), size is the UTF-8 bytes of the text, n_turns the length of the conversation,
    and one row with a null pos stands for a conversation that is left without turns. Rows without a conversation take
    no part; repeated rows are turns of their own. Empty tables give no rows; other columns are not looked at.
    """
    body = F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8")
    speaker = F.coalesce(F.col(role).cast("string"), F.lit(""))
    turns = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("at"), speaker.alias("who"), F.md5(body).alias("what"),
        F.length(body).cast("long").alias("size"),
    )
    placed = KeyedSeries.build(turns, ["c"], ["at", "who", "what"]).df
    who = F.encode("who", "UTF-8")
    placed = materialise(
        placed.select(
            "c", (F.col("_pos") - 1).alias("own"), "size",
            F.md5(F.concat(F.encode(F.concat_ws(":", F.length(who), F.col("what")), "UTF-8"), who)).alias("mark"),
        )
    )
    c = F.col("c")
    lengths = placed.groupBy("c").agg(F.count("*").alias("n")).select(
        "c", "n", (c - c % family).alias("base"), (F.crc32(c.cast("string").cast("binary")) % most).alias("h")
    )
    bases = lengths.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    plan = materialise(
        lengths.join(bases, "base", "left").select(
            "c", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")
        ).withColumn("n_turns", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    start = placed.where((F.col("own") < most) & (c % family == 0)).withColumnRenamed("c", "base")
    borrowed = plan.join(start, "base").where("own < taken").select("c", "n_turns", F.col("own").alias("pos"), "mark", "size")
    kept = join_hubs(placed, plan.select("c", "h", "taken", "n_turns"), "c").where("own >= h")
    kept = kept.select("c", "n_turns", (F.col("own") - F.col("h") + F.col("taken")).alias("pos"), "mark", "size")
    nothing = F.lit(None)
    none = plan.where("n_turns = 0").select(
        "c", "n_turns", nothing.cast("long").alias("pos"), nothing.cast("string").alias("mark"), nothing.cast("long").alias("size")
    )
    return borrowed.unionByName(kept).unionByName(none).withColumnRenamed("c", "conv_id")


def _node(prefix: Column, marks: Column, turns: Column, block_key: Column) -> Column:
    """Key of the node after `turns` turns of a block: the block's own where it is full, else one of prefix and turns."""
    part = F.md5(F.concat_ws(":", prefix, F.substring(marks, 1, turns * 32)).cast("binary"))
    return F.when(turns == BLOCK, block_key).otherwise(part)


def _blocks(turns: DataFrame) -> DataFrame:
    """One row per conversation and block: its marks and sizes in order, the digests of the prefix that ends before it
    (`prefix`) and with it (`key`)."""
    placed = turns.where("pos is not null")
    parts = placed.groupBy("c", "n_turns", F.floor(F.col("pos") / BLOCK).alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "mark", "size"))).alias("turns")
    )
    parts = parts.select(
        "c", "n_turns", "b", F.array_join("turns.mark", "").alias("marks"),
        F.array_join(F.transform("turns.size", lambda s: s.cast("string")), ",").alias("sizes"),
    )
    # a digest of (place, block) in four numbers of 32 bits; sums of these identify a sequence of blocks
    digest = F.md5(F.concat_ws(":", "b", "marks").cast("binary"))
    parts = parts.withColumn("digest", digest).withColumn("bucket", F.floor(F.col("b") / BUCKET))
    pieces = {f"d{i}": F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}
    summed = running(
        parts.withColumns(pieces).drop("digest"), ["c"], "bucket", ["b"], {f"s{i}": f"d{i}" for i in range(4)}
    )

    def key(b: Column, sums: list[Column]) -> Column:
        return F.md5(F.concat_ws(":", b, *sums).cast("binary"))

    upto = [F.col(f"s{i}") for i in range(4)]
    before = [F.col(f"s{i}") - F.col(f"d{i}") for i in range(4)]
    return summed.select(
        "c", "n_turns", "b", "marks", "sizes", key(F.col("b"), upto).alias("key"),
        F.when(F.col("b") == 0, F.lit(ROOT)).otherwise(key(F.col("b") - 1, before)).alias("prefix"),
    )


def _expanded(blocks: DataFrame) -> DataFrame:
    """The nodes inside each block: one row per turn."""
    size = F.split("sizes", ",")
    rows = blocks.withColumn("j", F.explode(F.sequence(F.lit(1), F.size(size))))
    j, prefix, marks, key = F.col("j"), F.col("prefix"), F.col("marks"), F.col("key")
    return rows.select(
        _node(prefix, marks, j, key).alias("node"),
        F.when(j == 1, prefix).otherwise(_node(prefix, marks, j - 1, key)).alias("parent"),
        (F.col("b") * BLOCK + j).cast("long").alias("depth"),
        F.element_at(size, j).cast("long").alias("size"),
        "n", "least",
    )


def _nodes(blocks: DataFrame) -> DataFrame:
    """Every node but the root: node, parent, depth, size (bytes of its last text), n (members), least (of them)."""
    alike = ["prefix", "key", "b", "marks", "sizes"]
    distinct = materialise(blocks.groupBy(*alike).agg(F.count("*").alias("n"), F.min("c").alias("least")))
    kids = distinct.groupBy("prefix").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    marked = join_hubs(distinct, kids.select("prefix", (F.col("first") != F.col("last")).alias("diverges")), "prefix")
    chains = _expanded(marked.where("not diverges"))
    refined = _expanded(marked.where("diverges")).groupBy("node", "parent", "depth", "size").agg(
        F.sum("n").alias("n"), F.min("least").alias("least")
    )
    return chains.unionByName(refined.select(*chains.columns))


def _totals(nodes: DataFrame) -> DataFrame:
    """Leaves and saved bytes in the subtree of every node of more than one conversation: (node, n_leaves, saved)."""
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.count_if(F.col("n") == 1).alias("alone"), F.count("*").alias("children")
    )
    # a child of one conversation is the top of a chain with one leaf
    now = nodes.where("n > 1").select("node", F.col("parent").alias("up"), "n", "size").join(children, "node", "left")
    now = materialise(
        now.select(
            "node", "up",
            F.when(F.col("children").isNull(), F.lit(1)).otherwise(F.col("alone")).cast("long").alias("n_leaves"),
            ((F.col("n") - 1) * F.col("size")).cast("long").alias("saved"),
        )
    )
    while not now.where("up is not null").isEmpty():
        given = now.where("up is not null").groupBy(F.col("up").alias("node")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        # nothing lies above the root: who reached it needs no further step
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"))
        steps = join_hubs(now.where(F.col("up") != ROOT).select("node", "up"), above, "up").select("node", "next")
        now = materialise(
            now.drop("up").join(given, "node", "left").join(steps, "node", "left").select(
                "node", F.col("next").alias("up"),
                (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            )
        )
    return now.select("node", "n_leaves", "saved")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node in order; a node's rows follow each other, and only its hash is held."""
    node, state, out = None, None, []
    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if name != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = name, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _pairs(out)
        out = []
    if state is not None:
        yield _pairs([(node, state.hexdigest())])


def _pairs(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"]
    )


def _ends(blocks: DataFrame, turnless: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end.

    The ids are joined in pieces of PIECE consecutive numbers, each in a task of its own; the hash itself goes through
    the pieces one after the other, as SHA-256 must.
    """
    left = F.col("n_turns") - F.col("b") * BLOCK
    last = blocks.where((left > 0) & (left <= BLOCK)).select(
        _node(F.col("prefix"), F.col("marks"), left.cast("int"), F.col("key")).alias("node"), "c"
    )
    ends = last.unionByName(turnless.select(F.lit(ROOT).alias("node"), "c"))
    pieces = ends.groupBy("node", F.floor(F.col("c") / PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids")
    )
    pieces = pieces.repartition("node").sortWithinPartitions("node", "piece")
    return pieces.select("node", "ids").mapInArrow(_hash_pieces, "node string, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of conversations given as turns (see `rebuilt`).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, members but one times bytes of the last text), ends_sha256 (of the ids of members
    that end at the node, ascending, comma-joined). Turns are equal if role and text are. The root has depth 0 and no
    text; a conversation without turns is a member of the root alone. Copies of a conversation share all their nodes.
    Empty tables have no nodes.
    """
    rows = materialise(turns.withColumnRenamed("conv_id", "c"))
    blocks = materialise(_blocks(rows))
    turnless = rows.where("pos is null").select("c")
    nodes = _nodes(blocks)
    members = blocks.where("b = 0").select("c").unionByName(turnless)
    root = members.agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("size"), "n", "least",
    )
    nodes = materialise(nodes.unionByName(root))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    named = join_hubs(nodes.where("parent is not null"), parents, "parent").select(*nodes.columns, "parent_conv_id")
    named = named.unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = named.join(children, "node", "left").join(_totals(nodes), "node", "left").join(_ends(blocks, turnless), "node", "left")
    return out.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
