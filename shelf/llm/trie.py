r"""The trie of conversation prefixes, built from its deepest level upwards.

A node is a distinct sequence of first turns; its key chains the digests of its turns.
Peeling starts at the greatest depth.  The nodes of a level are the conversations that
end there together with what is left of the level below: its nodes lose their last turn
and are grouped by the shorter key.  The grouping that finds a level's nodes also sums
up members, children, leaves and saved text, so every level is grouped once, and copies
of a conversation are one row from the first grouping on.

A conversation's keys are kept in blocks of levels, and a row on its way up carries the
keys of one block only.  Where a block ends, a node's smallest member, of which there is
one row, gives the keys of the next.  Conversations that end at one node are one row
before anything else.  In the blocks below the first one, subtrees are many: as long as
the largest has at most ``SUBTREE`` rows, which is counted, each is peeled by itself and
a block is one job.  Otherwise, and in the first block, a level is one grouping, with
its rows reduced before the shuffle.  What is found is written.

Defined cases: a null role or text is empty; turns are in order of (turn, digest of role
and text) with null first, so ties and repeated rows have one order; a conversation
without turns is a member of the root only; rows without a conv_id name no member
and are left out; an empty table has no nodes, not even a root; further columns are not
read.  The digests of a conversation's turns, 60 bytes each, have to fit into a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelf.llm.common import Workspace

#: Levels of the first block, and of those below, whose keys a row carries at once.
BLOCKS = (16, 64)
#: Rows of a block's subtree that one task may peel.
SUBTREE = 20_000
#: A parent with more than this share of all nodes as children is looked up by
#: broadcast; there are at most 1/share of them.
HOT_SHARE = 1e-3
#: Characters of ids that travel as one row.
CHUNK = 65_536

_ROOT = hashlib.sha256(b"").digest()
_PATH = "conv_id long, n_turns int, block int, ends boolean, keys array<binary>, lengths array<long>"
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends")
_NODE = "key binary, parent_key binary, conv_id long, depth long, " + ", ".join(f"{c} long" for c in _COUNTS)


def sequences(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its ``turns`` in order, each with the digest
    of role and text and the text's length.  Texts themselves are not moved."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turn = F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("length"))
    ordered = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))
    return ordered.select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["length"].alias("length"))).alias("turns"))


def with_shared_head(conversations: DataFrame, leader: Column, head: Column) -> DataFrame:
    """Conversations that begin with the first ``head`` turns of another, the ``leader``
    (all of them if it has fewer, none if there is no such), and go on with their own
    turns behind the first ``head``."""
    own = conversations.select("conv_id", "turns", leader.alias("leader"), head.cast("int").alias("head"))
    lead = conversations.select(F.col("conv_id").alias("leader"), F.col("turns").alias("lead"))
    none = F.slice("turns", 1, 0)
    return own.join(lead, "leader", "left").select("conv_id", F.concat(
        F.slice(F.coalesce("lead", none), F.lit(1), F.col("head")),
        F.slice("turns", F.col("head") + 1, F.size("turns"))).alias("turns"))


def _low(block: int, sizes: tuple[int, int]) -> int:
    """The level above a block."""
    return 0 if block == 0 else sizes[0] + sizes[1] * (block - 1)


def _last_block(depth: int, sizes: tuple[int, int]) -> int:
    """The block that a depth is in; the root is in the first."""
    return 0 if depth <= sizes[0] else 1 + (depth - sizes[0] - 1) // sizes[1]


def _paths(conversations: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """The keys of each conversation's prefixes, a row for each block of levels.  A block
    begins with the key of the level above it; ``lengths`` are those of its own levels."""
    schema = T.StructType.fromDDL(_PATH)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for conv_id, digests, lengths in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    key, keys, n = _ROOT, [_ROOT], len(digests)
                    for digest in digests:
                        key = hashlib.sha256(key + digest).digest()
                        keys.append(key)
                    for b in range(_last_block(n, sizes) + 1):
                        low, high = _low(b, sizes), min(n, _low(b + 1, sizes))
                        rows.append((conv_id, n, b, n <= high, keys[low:high + 1], lengths[low:high]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)]
                    if rows else [pa.array([], type=f.type) for f in arrow], schema=arrow)

    return conversations.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.length").alias("lengths")).mapInArrow(run, schema)


def _level(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of a level from its conversations and the stripped nodes below it."""
    members = F.sum("n_convs")
    last = F.coalesce(F.element_at(F.any_value("lengths"), -1), F.lit(0)) if depth else F.lit(0)
    nodes = rows.groupBy(F.element_at("keys", -1).alias("key")).agg(
        F.min("conv_id").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.any_value("keys").alias("keys"),
        F.any_value("lengths").alias("lengths"), members.alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
        (F.sum("saved_tokens") + (members - 1) * last).alias("saved_tokens"), F.sum("n_ends").alias("n_ends"))
    parent = F.element_at("keys", -2) if depth else F.lit(None).cast("binary")
    return nodes.withColumn("parent_key", parent)


def _stripped(nodes: DataFrame) -> DataFrame:
    """Nodes without their last turn: what each hands to its parent."""
    return nodes.select(
        "conv_id", F.expr("slice(keys, 1, size(keys) - 1)").alias("keys"),
        F.expr("slice(lengths, 1, size(lengths) - 1)").alias("lengths"), "n_convs", F.lit(1).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.lit(0).cast("long").alias("n_ends"))


def _peeled(rows: DataFrame, low: int) -> DataFrame:
    """All nodes of a block, each subtree below level ``low`` peeled by itself."""
    schema = T.StructType.fromDDL(_NODE)
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        levels: dict[int, dict[bytes, list]] = {}

        def meet(keys: list, lengths: list, conv_id: int, counts: list[int]) -> None:
            node = levels.setdefault(low + len(lengths), {}).setdefault(keys[-1], [keys, lengths, conv_id, [0] * len(counts)])
            node[2] = min(node[2], conv_id)
            node[3] = [a + b for a, b in zip(node[3], counts, strict=True)]

        for row in table.to_pylist():
            meet(row["keys"], row["lengths"], row["conv_id"], [row[c] for c in _COUNTS])
        out = []
        for depth in range(max(levels), low, -1):
            for key, (keys, lengths, conv_id, (n, children, leaves, saved, ends)) in levels.get(depth, {}).items():
                leaves, saved = max(leaves, 1), saved + (n - 1) * lengths[-1]
                out.append((key, keys[-2], conv_id, depth, n, children, leaves, saved, ends))
                if depth > low + 1:
                    meet(keys[:-1], lengths[:-1], conv_id, [n, 1, leaves, saved, 0])
        return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return rows.groupBy("top").applyInArrow(run, schema)


def prefix_trie(conversations: DataFrame, sizes: tuple[int, int] = BLOCKS, subtree: int = SUBTREE) -> tuple[DataFrame, DataFrame]:
    """The nodes and the members of the trie of ``conversations`` (conv_id, ``turns`` as
    :func:`sequences` gives them; each conv_id once).

    Nodes: key, conv_id (the smallest member), depth, parent_conv_id, parent_key, n_convs,
    n_children, n_leaves, saved_tokens, n_ends.  Members: conv_id and the ``key`` of the
    node it ends at."""
    spark = conversations.sparkSession
    work = Workspace(spark, "trie")
    paths = work.write(_paths(conversations, sizes).sortWithinPartitions("block"), "paths")
    members = paths.where("ends").select("conv_id", F.element_at("keys", -1).alias("key"))
    deepest = paths.agg(F.max("n_turns")).first()[0]
    columns, found, below = T.StructType.fromDDL(_NODE).names, [], None
    for block in reversed(range(0 if deepest is None else _last_block(deepest, sizes) + 1)):
        low, own = _low(block, sizes), paths.where(F.col("block") == block)
        ended = own.where("ends").groupBy(F.element_at("keys", -1).alias("key")).agg(
            F.min("conv_id").alias("conv_id"), F.any_value("keys").alias("keys"), F.any_value("lengths").alias("lengths"),
            F.count(F.lit(1)).alias("n_convs"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS[1:4]], F.count(F.lit(1)).alias("n_ends"))
        rows = ended.drop("key")
        if below is not None:
            rows = rows.unionByName(below.select("conv_id", *_COUNTS).join(own.select("conv_id", "keys", "lengths"), "conv_id"))
        rows = work.write(rows.withColumn("top", F.element_at("keys", 1)), f"rows{block}")
        if block and rows.groupBy("top").count().agg(F.max("count")).first()[0] <= subtree:
            nodes = work.write(_peeled(rows, low), f"nodes{block}")
            found.append(f"nodes{block}")
        else:
            stripped = None
            for depth in range(min(deepest, _low(block + 1, sizes)), low - (block == 0), -1):
                at = rows.where(F.size("lengths") == depth - low).drop("top")
                nodes = work.write(_level(at if stripped is None else at.unionByName(stripped), depth), f"level{depth}")
                found.append(f"level{depth}")
                stripped = _stripped(nodes)
        below = _stripped(nodes.where(F.col("depth") == low + 1).withColumns({"keys": F.array("parent_key"), "lengths": F.array(F.lit(0))}))
    if found:
        nodes = spark.read.schema(_NODE).parquet(*[work.path(x) for x in found])
    else:
        nodes = spark.createDataFrame([], _NODE)
    return _with_parents(nodes.select(*columns)), members


def _with_parents(nodes: DataFrame) -> DataFrame:
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    most = max(1.0, (nodes.agg(F.count(F.lit(1))).first()[0] or 0) * HOT_SHARE)
    hot = F.broadcast(parents.where(F.col("n_children") > most).select("parent_key", F.col("parent_conv_id").alias("hot_id")))
    rest = parents.where(F.col("n_children") <= most).drop("n_children")
    looked = nodes.join(hot, "parent_key", "left")
    done = looked.where("hot_id IS NOT NULL OR depth = 0").withColumnRenamed("hot_id", "parent_conv_id")
    other = looked.where("hot_id IS NULL AND depth > 0").drop("hot_id").join(rest, "parent_key", "left")
    return done.unionByName(other)


def ends_digests(members: DataFrame) -> DataFrame:
    """The SHA-256 of the ids of the members that end at a node, rising and joined by
    commas: key, ends_sha256.

    Ids are joined in pieces wherever they are, dealt by (key, id), so that the members
    of a frequent conversation are many tasks; the pieces of a key then pass through its
    digest one at a time."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, done, key, ids, held, first = ["key", "first", "ids"], ([], [], []), None, [], 0, None

        def close() -> None:
            if ids:
                for column, value in zip(done, (key, first, ",".join(ids)), strict=True):
                    column.append(value)

        for batch in batches:
            for own, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key or held > CHUNK:
                    close()
                    key, ids, held, first = own, [], 0, conv_id
                ids.append(str(conv_id))
                held += len(ids[-1]) + 1
            if done[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(done, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=names)
                done = ([], [], [])
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(done, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=names)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != key:
                    if state is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), pa.array(digests, type=pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], type=pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    pieces = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        joined, "key binary, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(
        digested, "key binary, ends_sha256 string")
