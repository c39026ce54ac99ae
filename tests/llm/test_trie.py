"""The prefix trie against one built node by node."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelf.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, key string, depth int"


def order(turn):
    role, text = turn[2] or "", turn[3] or ""
    return (turn[1] is not None, turn[1], hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest())


def plain(conversations):
    """conv_id -> turns; a dict from prefix to what the operator says of it."""
    nodes = {}
    for conv_id, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv_id)
    parents = {p[:-1] for p in nodes if p}
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[:len(prefix)] == prefix]
        ends = sorted(c for c in members if len(conversations[c]) == len(prefix))
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
            sum(len(p) == len(prefix) + 1 for p in below),
            sum(p not in parents for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(conversations, sizes=trie.BLOCKS, subtree=trie.SUBTREE):
    nodes, members = trie.prefix_trie(conversations, sizes, subtree)
    rows = nodes.join(trie.ends_digests(members), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)), "n_ends").collect()
    return sorted((tuple(r)[:-1] for r in rows), key=repr)


def by_conversation(rows):
    out = {}
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        out.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return out


ODD = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "hi"), (2, 1, "assistant", ""), (2, 2, None, "x"),
       (3, None, "user", "hi"), (3, 5, "assistant", ""), (4, 1, "b", "tie"), (4, 1, "a", "tie"), (4, 1, "a", "tie"),
       (5, 0, "a", "tie"), (9, 0, "1", "2:"), (10, 0, "12", ":"), (None, 0, "user", "hi"), (-7, 0, "user", "é中\U0001f600"), (-8, 0, "user", "é中\U0001f600")]


@pytest.mark.parametrize("sizes", [(1, 1), (2, 1), (16, 64)])
def test_odd_rows(spark, sizes):
    turns = spark.createDataFrame([(*r, "k", 1) for r in ODD], SCHEMA)
    assert found(trie.sequences(turns), sizes) == plain(by_conversation(ODD))


@pytest.mark.parametrize("sizes,longest,subtree", [((3, 2), 9, 1000), ((4, 4), 4, 1000), ((2, 5), 12, 1000), ((2, 3), 9, 5)])
def test_random_trees(spark, sizes, longest, subtree):
    rng = random.Random(longest)
    rows = [(c, t, rng.choice("ua"), rng.choice(["", "x", "yy"])) for c in range(60) for t in range(rng.randint(1, longest))]
    rows += [(100 + c, t, "u", "same") for c in range(50) for t in range(longest)]
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    assert found(trie.sequences(turns), sizes, subtree) == plain(by_conversation(rows))


def test_members_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 20)
    rows = [(c, 0, "u", "same") for c in range(500)]
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    assert found(trie.sequences(turns)) == plain(by_conversation(rows))


def test_hot_parent(spark):
    rows = [(c, 0, "u", str(c)) for c in range(40)] + [(c, 1, "u", "x") for c in range(40)]
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    nodes, _ = trie.prefix_trie(trie.sequences(turns))
    assert {(r.depth, r.parent_conv_id == (0 if r.depth == 1 else r.conv_id)) for r in nodes.where("depth > 0").collect()} == {(1, True), (2, True)}


def test_shared_heads(spark):
    rows = [(0, t, "u", f"a{t}") for t in range(3)] + [(1, t, "u", f"b{t}") for t in range(4)] + [(105, 0, "u", "c"), (105, 1, "u", "d")]
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    own = trie.sequences(turns)
    got = {r.conv_id: len(r.turns) for r in trie.with_shared_head(own, F.expr("conv_id - conv_id % 100"), F.lit(2)).collect()}
    assert got == {0: 3, 1: 4, 105: 0}  # nobody leads 105, so its head is gone
    assert found(trie.with_shared_head(own, F.expr("conv_id - conv_id % 100"), F.lit(2))) == plain({
        0: [("u", "a0"), ("u", "a1"), ("u", "a2")], 1: [("u", "a0"), ("u", "a1"), ("u", "b2"), ("u", "b3")], 105: []})


def test_empty(spark):
    turns = spark.createDataFrame([], SCHEMA)
    nodes, members = trie.prefix_trie(trie.sequences(turns))
    assert nodes.count() == 0 and trie.ends_digests(members).count() == 0


def test_deep_conversation(spark):
    rows = [(c, t, "u", "same" if t < 150 - 20 * c else f"{c} {t}") for c in range(3) for t in range(180 - c)]
    turns = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    assert found(trie.sequences(turns)) == plain(by_conversation(rows))
