"""Near copies by HyperMinHash registers, banding and exact verification.

A document's set are its distinct five-word shingles, as 64-bit hashes.  The hashes are
dealt over registers; each keeps the smallest as its number of leading zeros and ten
bits behind them.  Documents with one set are one class, and classes that agree in
all registers of a band are candidates.  Within a bucket of a band they are compared by
the lowest bits of the registers.  A tile with many likely pairs hands on a spanning
forest of them; of buckets with such tiles those that then still hold several components
are compared again, by more bits, and in the last round all likely pairs are handed on.
These are compared by the estimate from all of the registers, corrected for chance
collisions, and every link is confirmed on the full sets before it counts.

A bucket of more than ``TILE`` classes is dealt over blocks, within which its classes meet
first.  From then on the classes of its largest component stay in their blocks, and the
others meet every block, so a group of near copies is no square of rows.

Two classes at the limit of 0.85 share no band with a probability of 5e-9; that and the
margins of five standard deviations of the estimate and of six of the lowest bits are all
that can lose a link.

Defined cases: null, empty and blank texts have an empty set and are linked with
nothing; fewer than five words are one shingle; rows that repeat a doc_id count as one
document if their sets agree, and else are linked as texts of that id; a null doc_id is
not linked; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.common import Workspace, map_texts, partitions, per_worker
from shelf.llm.components import components

WORDS = 5
REGISTERS, ROWS, MANTISSA = 480, 8, 10
EMPTY = 0xFFFF
#: Lowest bits of each register in a sketch, and those that the first round compares;
#: a plane of one bit of all registers has so many bytes.
BITS, FIRST_BITS, PLANE = 4, 2, 64
#: Members of a bucket that are compared in one tile, and pairs that are at once.
TILE = 2048
PAIRS = 1 << 18
FOREST_ROUNDS = 3
#: Ids up to this number are broadcast to pick out texts, 16 MB; more are joined.
BROADCAST_IDS = 2_000_000
HOT_SHARE = 1e-3

_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    size = 1 << max(12, int(n).bit_length())

    def make():
        inverse = pow(int(_BASE), -1, 1 << 64)
        both = []
        for b in (int(_BASE), inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        return tuple(both)

    return per_worker(("powers", size), make)


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, A-Z in lower case."""
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * power[:len(raw)])])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(WORDS, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        total += w[i:len(w) - n + 1 + i] * _U(0xD6E8FEB86659FD93 + 2 * i * 0x10001)
    return np.unique(mix(total + _U(n)))


def registers(shingles: np.ndarray) -> np.ndarray:
    own = mix(shingles ^ _U(0x2545F4914F6CDD1D))
    place = (own % _U(REGISTERS)).astype(np.int64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, place, (own // _U(REGISTERS)) << _U(7))
    # the top bit's place counts the leading zeros; the bits behind it are the mantissa
    _, top = np.frexp(np.maximum(least >> _U(11), _U(1)).astype(np.float64))
    top = top + 11
    mantissa = (least >> np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)) & _U((1 << MANTISSA) - 1)
    packed = ((64 - top).astype(np.uint64) << _U(MANTISSA)) | mantissa
    filled = np.zeros(REGISTERS, bool)
    filled[place] = True
    return np.where(filled, packed, _U(EMPTY)).astype("<u2")


def _collision(n: np.ndarray) -> np.ndarray:
    """Probability of each number of leading zeros of the least of n hashes of a
    register's share, by n."""
    zeros = np.arange(0, 56)
    rate = np.maximum(n, 1)[:, None] / REGISTERS
    return np.exp(-rate * 2.0 ** -(zeros + 1)) - np.exp(-rate * 2.0 ** -zeros)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard of rows of registers, less chance collisions, and the registers used."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=-1)
    count = np.maximum(used.sum(axis=-1), 1)
    chance = (_collision(n_a) * _collision(n_b)).sum(axis=-1) / (1 << MANTISSA)
    return (same / count - chance) / (1 - chance), count


def _likely(value: np.ndarray, count: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, limit: float) -> np.ndarray:
    """Whether an estimate is less than five standard deviations below the limit.  The
    registers are a sample without repeats of the union, so small sets are nearly exact."""
    union = np.maximum((n_a + n_b) / (1 + limit), count)
    deviation = np.sqrt(limit * (1 - limit) / count * (1 - count / union))
    return value >= limit - 5 * deviation - 2 / np.maximum(union, 1)


def sketch(own: np.ndarray) -> bytes:
    """The lowest bits of registers, in planes of one bit of each; those of empty ones are 0."""
    bits = np.where(own == EMPTY, 0, own) >> np.arange(BITS)[:, None] & 1
    return np.pad(np.packbits(bits.astype(np.uint8), axis=1), ((0, 0), (0, PLANE - REGISTERS // 8))).tobytes()


def _most_unlike(n_a: np.ndarray, n_b: np.ndarray, limit: float, bits: int) -> np.ndarray:
    """The most registers whose lowest bits differ between sets at the limit: six standard
    deviations above their mean, and no more than shingles that only one set has."""
    union = (n_a + n_b) / (1 + limit)
    share = union / REGISTERS
    used = REGISTERS * -np.expm1(-share)
    spread = REGISTERS * np.exp(-share) * (1 - (1 + share) * np.exp(-share))
    # registers that differ, and of these the ones whose lowest bits do
    unlike, seen = (1 - limit) * used, 1 - 2.0 ** -bits
    deviation = np.sqrt(np.maximum(seen ** 2 * (unlike * limit * (1 - used / union) + (1 - limit) ** 2 * spread) + seen * (1 - seen) * unlike, 0))
    return np.minimum(seen * unlike + 6 * deviation, (1 - limit) * union + 1e-9)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (two sums over the set), registers, sketch."""
    def sign(texts: list[str]) -> list[list]:
        sets = [shingle_set(t) for t in texts]
        keys = [np.array([s.sum(), mix(s ^ _BASE).sum()], np.uint64).tobytes() if len(s) else None for s in sets]
        own = [registers(s) if len(s) else None for s in sets]
        return [[len(s) for s in sets], keys, [r if r is None else r.tobytes() for r in own], [r if r is None else sketch(r) for r in own]]

    return map_texts(docs, ("doc_id",), "n_shingles long, set_key binary, registers binary, sketch binary", lambda: sign)


def buckets(classes: DataFrame, work: Workspace) -> DataFrame:
    """(bucket, size, hub, rep): the members of the buckets that hold several
    classes; of buckets with the same members the one of the first band."""
    width = 2 * ROWS
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // ROWS - 1)), lambda i: F.struct(
        i.alias("i"), F.substr("registers", i * width + 1, F.lit(width)).alias("own"))))
    rows = classes.select("rep", band.alias("b")).where(F.col("b.own") != F.lit(b"\xff" * width))
    keyed = work.write(rows.select("rep", F.col("b.i").alias("band"), F.xxhash64("b.i", "b.own").alias("bucket")), "bands")
    full = keyed.groupBy("bucket").agg(
        F.min("band").alias("band"), F.count(F.lit(1)).alias("size"), F.min("rep").alias("hub"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("size > 1")
    first = F.min(F.struct("band", "bucket"))
    once = work.write(full.groupBy("size", "hub", "x", "y").agg(first.alias("b")).select("b.bucket", "size", "hub"), "buckets")
    members = work.write(keyed.drop("band").join(once, "bucket").select("bucket", "size", "hub", "rep"), "members")
    work.drop("bands")
    work.drop("buckets")
    return members


def _dealt(pairs: DataFrame, values: DataFrame, test: Callable[[list, list], list[bool]], work: Workspace, name: str) -> DataFrame:
    """The pairs (u, v, task) that pass, by the values (doc_id, own) of both.  A value goes
    once to a task and not once to each of its pairs.  ``test`` gets the values of the first
    and second of all pairs of a task; rows that repeat a doc_id may have several."""
    def check(key, some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, list] = {}
        for doc_id, value in zip(own["doc_id"], own["own"], strict=True):
            held.setdefault(doc_id, []).append(value)
        return some.loc[test([held[x] for x in some["u"]], [held[x] for x in some["v"]]), ["u", "v", "task"]]

    needed = work.write(pairs.select("task", F.explode(F.array("u", "v")).alias("doc_id")).distinct(), f"{name}-needed")
    dealt = needed.join(values, "doc_id").select("task", "doc_id", "own")
    passed = work.write(pairs.groupBy("task").cogroup(dealt.groupBy("task")).applyInPandas(check, "u long, v long, task long"), name)
    work.drop(f"{name}-needed")
    return passed


def _confirmed(pairs: DataFrame, hubs: DataFrame, classes: DataFrame, docs: DataFrame, limit: float, work: Workspace, name: str) -> DataFrame:
    """The pairs whose full sets are similar enough, of those that the registers allow.

    Pairs are dealt to tasks by the hubs (rep, hub) of both, in 64 parts for each two hubs."""
    u, v = (hubs.select(F.col("rep").alias(c), F.col("hub").alias(f"h{c}")) for c in "uv")
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.lit(8))
    tasks = 16 * partitions(docs.sparkSession)
    task = F.pmod(F.xxhash64("hu", "hv", part("u"), part("v")), F.lit(tasks)).alias("task")
    pairs = work.write(pairs.join(u, "u").join(v, "v").select("u", "v", task), f"{name}-pairs")

    def likely(first: list, second: list) -> np.ndarray:
        good = np.zeros(len(first), bool)
        both = [(k, a, b) for k, (x, y) in enumerate(zip(first, second, strict=True)) for a in x for b in y]
        for k in range(0, len(both), 4096):
            which, *packed = zip(*both[k:k + 4096], strict=True)
            (a, n_a), (b, n_b) = ((x[:, :REGISTERS], x[:, REGISTERS:].copy().view("<u8")[:, 0].byteswap().astype(np.int64)) for x in (
                np.frombuffer(b"".join(x), "<u2").reshape(-1, REGISTERS + 4) for x in packed))
            good[np.array(which)[_likely(*estimate(a, b, n_a, n_b), n_a, n_b, limit)]] = True
        return good

    size = F.unhex(F.lpad(F.hex("n_shingles"), 16, "0"))
    values = classes.select(F.col("rep").alias("doc_id"), F.concat("registers", size).alias("own"))
    near = _dealt(pairs, values, likely, work, f"{name}-near")
    work.drop(f"{name}-pairs")
    ids = work.write(near.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), f"{name}-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    own = work.write(map_texts(texts, ("doc_id",), "own binary", lambda: lambda t: [[shingle_set(x).tobytes() for x in t]]), f"{name}-sets")

    def alike(a: bytes, b: bytes) -> bool:
        a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= limit * (len(a) + len(b) - both) - 1e-9

    links = _dealt(near, own, lambda first, second: [
        any(alike(a, b) for a in x for b in y) for x, y in zip(first, second, strict=True)], work, f"{name}-links")
    for done in ("near", "ids", "sets"):
        work.drop(f"{name}-{done}")
    return links.select("u", "v")


def _forest(u: np.ndarray, v: np.ndarray, value: np.ndarray, component: np.ndarray) -> list[int]:
    """Which of the pairs (u, v) of places join components, the least unlike first."""
    names, own = np.unique(component, return_inverse=True)
    root, order, out = np.arange(len(names)), np.argsort(value, kind="stable"), []
    for k in range(0, len(order), 4096):
        some = order[k:k + 4096]
        for pair in some[root[own[u[some]]] != root[own[v[some]]]].tolist():
            a, b = (int(root[own[x[pair]]]) for x in (u, v))
            while root[a] != a:
                a = int(root[a])
            while root[b] != b:
                b = int(root[b])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append(pair)
        while (root[root] != root).any():
            root = root[root]
    return out


def _tile_pairs(tile: np.ndarray, sketches: np.ndarray, n: np.ndarray, own: np.ndarray, rep: np.ndarray, limit: float,
                every: bool) -> tuple[set[tuple[int, int]], np.ndarray]:
    """Likely pairs of different components within tiles, and the tiles that hold some
    back: where pairs are more than members, those of a spanning forest have to do at
    first.  Rows are in order of their tile; a sketch is a row of words for each bit."""
    start = np.flatnonzero(np.diff(tile, prepend=-1))
    size = np.diff(np.append(start, len(tile)))
    later = np.repeat(start + size, size) - np.arange(len(tile)) - 1  # a row meets those behind it
    done = np.concatenate([[0], np.cumsum(later)])
    found: set[tuple[int, int]] = set()
    held: list[int] = []

    def near(low: int, high: int) -> tuple[np.ndarray, ...]:
        i = np.repeat(np.arange(low, high), later[low:high])
        j = np.arange(done[low], done[high]) - done[i] + i + 1
        for passes in (lambda: own[i] != own[j], lambda: rep[i] != rep[j], lambda: np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * limit):
            good = passes()
            i, j = i[good], j[good]
        unlike = np.bitwise_count(np.bitwise_or.reduce(sketches[i] ^ sketches[j], axis=1)).sum(axis=1, dtype=np.int32)
        good = unlike <= _most_unlike(n[i], n[j], limit, sketches.shape[1])
        return i[good].astype(np.int32), j[good].astype(np.int32), unlike[good]

    at = 0
    while at < len(start):
        # whole tiles up to so many pairs, or one of more in several steps
        upto = max(at + 1, int(np.searchsorted(done[start], done[start[at]] + PAIRS, side="right")) - 1)
        low, end, parts = int(start[at]), int(start[upto]) if upto < len(start) else len(tile), []
        while low < end:
            high = min(end, max(low + 1, int(np.searchsorted(done, done[low] + PAIRS, side="right")) - 1))
            parts.append(near(low, high))
            low = high
        i, j, unlike = (np.concatenate(x) for x in zip(*parts, strict=True))
        where = tile[i]
        many = np.zeros(0, np.int64) if every else np.flatnonzero(np.bincount(where - tile[start[at]], minlength=upto - at) > size[at:upto]) + tile[start[at]]
        plain = ~np.isin(where, many)
        pairs = [(i[plain], j[plain])]
        for one in many.tolist():
            a, b = np.searchsorted(where, [one, one + 1])
            first = int(start[one])
            some = a + np.array(_forest(i[a:b] - first, j[a:b] - first, unlike[a:b], own[first:first + size[one]]), np.int64)
            pairs.append((i[some], j[some]))
        held += many.tolist()
        for a, b in pairs:
            u, v = np.minimum(rep[a], rep[b]), np.maximum(rep[a], rep[b])
            found.update(zip(u.tolist(), v.tolist(), strict=True))
        at = upto
    return found, np.array(held, np.int64)


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their components, of the buckets that hold several of them."""
    held = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    several = held.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("bucket")
    return held.join(several, "bucket")


def _tiles(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, tile, across, rep, component): who meets whom.  Without labels all members
    are components and meet within the blocks of their bucket only (``across``: there are
    others).  With them, a bucket's largest component stays in its blocks, and its other
    members are in all of them."""
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    block = F.pmod(F.xxhash64("rep", F.lit(7)), blocks).cast("int")
    if labels is None:
        return members.select("bucket", block.alias("tile"), (blocks > 1).alias("across"), "rep", F.col("rep").alias("component"))
    rows = _unsettled(members, labels).withColumn("blocks", blocks).withColumn("block", block)
    most = rows.where("blocks > 1").groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"))
    own = F.col("component").eqNullSafe(F.col("main")) | (F.col("blocks") == 1)
    tile = F.explode(F.when(own, F.array("block")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.join(most, "bucket", "left").select("bucket", tile.alias("tile"), F.lit(False).alias("across"), "rep", "component")


def _left_over(members: DataFrame, labels: DataFrame | None, classes: DataFrame, limit: float, every: bool) -> DataFrame:
    """(u, v, bucket): likely pairs of different components within buckets; a row with a
    bucket instead says that it holds others back."""
    bits = FIRST_BITS if labels is None else BITS
    own = classes.select("rep", "n_shingles", F.substr("sketch", F.lit(1), F.lit(bits * PLANE)).alias("sketch"))
    # many tiles share a task; a tile's rows stay together
    rows = _tiles(members, labels).join(own, "rep").select(
        F.pmod(F.xxhash64("bucket", "tile"), F.lit(16 * partitions(members.sparkSession))).alias("task"),
        "bucket", "tile", "across", "rep", "component", "n_shingles", "sketch")

    def compare(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bucket", "tile"], kind="stable")
        bucket, tile = part["bucket"].to_numpy(), part["tile"].to_numpy()
        fresh = (np.diff(bucket, prepend=bucket[0]) != 0) | (np.diff(tile, prepend=tile[0]) != 0)
        sketches = np.frombuffer(b"".join(part["sketch"]), np.uint64).reshape(len(part), bits, PLANE // 8)
        number = np.cumsum(fresh)
        pairs, held = _tile_pairs(number, sketches, *(part[c].to_numpy() for c in ("n_shingles", "component", "rep")), limit, every)
        back = set(bucket[np.isin(number, held)].tolist()) | set(bucket[part["across"].to_numpy()].tolist())
        out = [(u, v, None) for u, v in pairs] + [(None, None, b) for b in back]
        return pd.DataFrame(out, columns=["u", "v", "bucket"], dtype=object).astype("Int64")

    return rows.groupBy("task").applyInPandas(compare, "u long, v long, bucket long").distinct()


def near_components(docs: DataFrame, limit: float = 0.85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    work = Workspace(docs.sparkSession, "minhash")
    signed = work.write(signatures(docs), "signatures")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = work.write(filled.groupBy("set_key", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("registers").alias("registers"),
        F.first("sketch").alias("sketch")), "classes")
    # from here on the registers are those of the classes
    signed = work.write(signed.drop("registers", "sketch"), "keys")
    work.drop("signatures")
    members = buckets(classes, work)
    hubs = work.write(members.groupBy("rep").agg(F.min("hub").alias("hub")), "hubs")
    links = tested = labels = None
    number, every = 0, False
    while True:
        likely = work.write(_left_over(members, labels, classes, limit, every), f"likely{number}")
        pairs = likely.where("u IS NOT NULL").select("u", "v")
        pairs = work.write(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), f"round{number}")
        found = not pairs.isEmpty()
        if found or labels is None:
            more = _confirmed(pairs, hubs, classes, docs, limit, work, f"round{number}")
            tested = pairs if tested is None else tested.unionByName(pairs)
            if labels is None or not more.isEmpty():
                links = more if links is None else links.unionByName(more)
                labels = components(links, work, f"components{number}")
        held = likely.where("bucket IS NOT NULL").select("bucket").distinct()
        if held.isEmpty():  # all likely pairs are tested now
            break
        members = members.join(held, "bucket", "left_semi")  # the other buckets are done with
        number += 1
        every = not found or number >= FOREST_ROUNDS
    named = work.write(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", "copies", F.coalesce("component", "rep").alias("component_id")), "named")
    most = max(1.0, signed.count() * HOT_SHARE)
    hot = F.broadcast(named.where(F.col("copies") > most).select("set_key", F.col("component_id").alias("hot_id")))
    own = signed.select("doc_id", "n_shingles", "set_key").join(hot, "set_key", "left")
    rest = own.where("hot_id IS NULL").join(named.where(F.col("copies") <= most), "set_key", "left")
    out = own.where("hot_id IS NOT NULL").select("doc_id", "n_shingles", F.col("hot_id").alias("component_id")).unionByName(
        rest.select("doc_id", "n_shingles", "component_id"))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, limit: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the
    smallest id, and all rows that are linked with nothing."""
    found = Workspace(docs.sparkSession, "near-kept").write(near_components(docs, limit), "components")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
