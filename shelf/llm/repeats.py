"""Repeated strings of 400 bytes, by run-length indexes of Burrows-Wheeler transforms.

Each string of ``LENGTH`` bytes is assigned to one of its own 64-byte grams, the one
with the least hash, so equal strings are assigned to equal grams at equal places
(winnowing).  The strings of one gram in a document are neighbours and make a context
of a few hundred bytes.  Contexts are grouped by gram: one that occurs twice is repeated
as a whole; grams with several different contexts are dealt over shards.  A shard builds
the transform of its contexts, keeps it as runs with the samples at their ends, and
streams the matching statistics of all places from the samples: where a run begins, the
length shared with the suffix before is compared, and it falls by one with each place up
to the next sample.  Places with a length of ``LENGTH`` or more, and their partners,
are repeated.  A gram with very many contexts is cut into blocks, and what a block does
not find repeated is compared between the blocks by two 64-bit hashes.

Defined cases: null and empty texts have no bytes, and their checksum is that of nothing;
texts shorter than ``LENGTH`` lose nothing; rows that repeat an id and a text are two
documents, so their long strings are all repeated; a null doc_id is an id like others;
texts of any length are read whole; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelf.llm.common import Workspace, map_texts, text_of
from shelf.llm.minhash import BROADCAST_IDS, _powers, mix

LENGTH, GRAM = 400, 64
#: Contexts of a shard, about 600 bytes each, and of a block of one gram.
SHARD, BLOCK = 4_000, 4_000
#: Windows of a document that are looked at in one piece.
PIECE = 1 << 22

_U = np.uint64
_CONTEXT = "anchor long, ctx long, lo int, hi int, at int"


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + _U(1)) * power[:len(raw)])]), inverse


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values, by blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def contexts_of(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchor, ctx, lo, hi, at: the windows lo..hi that one gram, at ``at``, stands for;
    ctx is a hash of their bytes and of the gram's place in them."""
    found: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, len(raw) - length + 1, PIECE):
        own = raw[begin:begin + PIECE + length - 1]
        sums, inverse = _sums(own)
        grams = mix((sums[gram:] - sums[:-gram]) * inverse[:len(own) - gram + 1])
        place = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least((grams & ~_U((1 << 24) - 1)) | place, length - gram + 1)
        at = (least & _U((1 << 24) - 1)).astype(np.int64)
        lo = np.flatnonzero(np.diff(at, prepend=-1))
        hi = np.append(lo[1:], len(at)) - 1
        at = at[lo]
        size = (hi - lo + length).astype(np.uint64)
        ctx = mix((sums[hi + length] - sums[lo]) * inverse[lo] + mix(size + ((at - lo).astype(np.uint64) << _U(32))))
        found.append((grams[at].view(np.int64), ctx.view(np.int64), lo + begin, hi + begin, at + begin))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class RunIndex:
    """Run-length index of several strings: the transform as run heads, with the place
    of each head, of the run end before it, and the length that the two share."""

    def __init__(self, parts: list[bytes]):
        sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        text = np.frombuffer(b"".join(parts), np.uint8)
        self.n = n = len(text)
        # places left in each place's string
        self.left = left = np.repeat(self.starts + sizes, sizes) - np.arange(n)
        order, self.ranks = self._sorted(text, left)
        before = text[order - 1].astype(np.int16)
        first = np.zeros(n, bool)
        first[self.starts[sizes > 0]] = True
        begins = first[order]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | begins[1:] | begins[:-1]
        runs = np.flatnonzero(head)
        self.head, self.end = order[runs], order[runs - 1]  # the end of the run before
        self.shared = self._shared(text, self.head, self.end)
        self.shared[runs == 0] = 0
        self.end[runs == 0] = self.head[runs == 0]

    @staticmethod
    def _sorted(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffix order within strings by prefix doubling, and the ranks on the way."""
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for i in range(8):
            key = (key << _U(8)) | np.where(left > i, padded[i:i + n], 0).astype(np.uint64)
        short = np.minimum(left, 8)
        order = np.lexsort((short, key))
        ranks, h, most = [], 8, int(left.max(initial=0))
        fresh = np.ones(n, bool)
        fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (short[order[1:]] != short[order[:-1]])
        while True:
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            ranks.append((h, rank.astype(np.int32)))
            if h >= most or fresh.all():
                return order, ranks
            further = np.where(left > h, rank[np.minimum(np.arange(n) + h, n - 1)], 0)
            pair = (rank << 32) | further
            order = np.argsort(pair, kind="stable")
            fresh = np.ones(n, bool)
            fresh[1:] = pair[order[1:]] != pair[order[:-1]]
            h *= 2

    def _shared(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at a and b have in common."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        room = np.minimum(self.left[a], self.left[b])
        steps = [(h, r) for h, r in self.ranks[::-1]]
        for h, rank in [x for x in steps for _ in range(1 if x is not steps[0] else 4)]:
            same = (room - out >= h) & (rank[np.minimum(a + out, self.n - 1)] == rank[np.minimum(b + out, self.n - 1)])
            out[same] += h
        for _ in range(8):
            more = out < room
            more[more] = text[(a + out)[more]] == text[(b + out)[more]]
            if not more.any():
                break
            out[more] += 1
        return out

    def repeated(self, length: int) -> np.ndarray:
        """For each place, whether ``length`` bytes from there stand in a second place.
        Streams the places in order; each takes the sample before it."""
        sample = np.full(self.n, -1, np.int64)
        sample[self.head] = np.arange(len(self.head))
        last = np.maximum.accumulate(np.where(sample >= 0, np.arange(self.n), -1))
        own = sample[last]
        past = np.arange(self.n) - last
        long = self.shared[own] - past >= length
        out = long.copy()
        out[(self.end[own] + past)[long]] = True
        return out


def _ranges(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, text_key, ...) with the texts, which alone are moved."""
    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    ids = wanted.select(F.col("text_key").alias("wanted_key")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    some = keyed.join(ids, keyed["text_key"] == ids["wanted_key"], "left_semi")
    other = wanted.withColumnRenamed("doc_id", "wanted_id").withColumnRenamed("text_key", "wanted_key")
    met = some.join(other, some["doc_id"].eqNullSafe(other["wanted_id"]) & (some["text_key"] == other["wanted_key"]))
    return met.drop("wanted_id", "wanted_key")


def _window_hashes(body: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """Two hashes of the strings of a body that start at ``at``."""
    raw = np.frombuffer(body, np.uint8)
    out = []
    for own in (raw, raw ^ np.uint8(0xA5)):  # other digits give another polynomial
        sums, inverse = _sums(own)
        out.append(mix((sums[at + length] - sums[at]) * inverse[at] + _U(len(out))))
    return np.array(out, np.uint64)


def _resolve(shards: DataFrame, length: int) -> DataFrame:
    """anchor, ctx, first, last: repeated windows of each context, from its first; and,
    of grams in several blocks, each different window of a block, by range of its hash,
    in ``packed``: two hashes, context and place."""
    def index(key, part: pd.DataFrame) -> pd.DataFrame:
        parts = [bytes(b) for b in part["body"]]
        runs = RunIndex(parts)
        marked = runs.repeated(length)
        rows, left = [], {}
        for anchor, ctx, blocks, body, start in zip(part["anchor"], part["ctx"], part["blocks"], parts, runs.starts, strict=True):
            own = marked[start:start + len(body) - length + 1]
            rows += [(anchor, ctx, a, b, None, None) for a, b in _ranges(own)]
            if blocks > 1:
                at = np.arange(len(own))
                x, y = _window_hashes(body, at, length)
                left.setdefault((anchor, blocks), []).append(np.array([x, y, np.full(len(at), ctx).view(np.uint64), at.astype(np.uint64)]))
        for (anchor, blocks), own in left.items():
            four = np.concatenate(own, axis=1)
            # of a string that the block has several times, one is enough for the others
            order = np.lexsort((four[1], four[0]))
            fresh = np.concatenate([[True], (four[:2, order[1:]] != four[:2, order[:-1]]).any(axis=0)])
            four = four[:, order[fresh]]
            meets = four[0] % _U(4 * blocks)
            rows += [(anchor, None, None, None, int(r), np.ascontiguousarray(four[:, meets == r]).tobytes()) for r in np.unique(meets)]
        out = pd.DataFrame(rows, columns=["anchor", "ctx", "first", "last", "meets", "packed"], dtype=object)
        return out.astype({c: "Int64" for c in ("anchor", "ctx", "first", "last", "meets")})

    return shards.groupBy("shard").applyInPandas(index, "anchor long, ctx long, first int, last int, meets int, packed binary")


def _meet(found: DataFrame) -> DataFrame:
    """Windows that blocks have in common, one range of hashes at a time."""
    def compare(key, part: pd.DataFrame) -> pd.DataFrame:
        four = np.concatenate([np.frombuffer(p, np.uint64).reshape(4, -1) for p in part["packed"]], axis=1)
        order = np.lexsort((four[1], four[0]))
        same = (four[:2, order[1:]] == four[:2, order[:-1]]).all(axis=0)
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        own = four[:, order[again]]
        rows = []
        for ctx in np.unique(own[2]):
            at = np.sort(own[3][own[2] == ctx]).astype(np.int64)
            cut = np.flatnonzero(np.diff(at, prepend=-9) != 1)
            rows += [(key[0], int(ctx.view(np.int64)), int(at[i]), int(at[j - 1])) for i, j in zip(cut, [*cut[1:], len(at)], strict=True)]
        return pd.DataFrame(rows, columns=["anchor", "ctx", "first", "last"])

    return found.where("packed IS NOT NULL").groupBy("anchor", "meets").applyInPandas(compare, "anchor long, ctx long, first int, last int")


def repeated_windows(docs: DataFrame, work: Workspace, length: int = LENGTH) -> DataFrame:
    """doc_id, text_key, windows: for each document with repeated strings, the ranges
    (first, last) of the places at which they start."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, which, columns = [], [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    own = contexts_of(np.frombuffer(text.encode(), np.uint8), length)
                    which.append(np.full(len(own[0]), row))
                    columns.append(own)
                ids = pa.array(np.concatenate(which) if which else np.zeros(0, np.int64), pa.int64())
                values = [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [np.zeros(0)] * 5
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(ids), part.column(1).take(ids), *[pa.array(v.astype(f.type.to_pandas_dtype()), f.type) for v, f in zip(values, list(arrow)[2:], strict=True)]],
                    schema=arrow)

    schema = T.StructType.fromDDL("doc_id long, text_key long, " + _CONTEXT)
    arrow = to_arrow_schema(schema)
    long = docs.select("doc_id", text_of().alias("text")).where(F.octet_length("text") >= length)
    rows = work.write(long.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(cut, schema), "rows")

    each = rows.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("doc_id", "text_key", "lo", "hi")).alias("one"))
    groups = work.write(each, "groups")
    # grams in one place only are done with; most are
    often = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.sum("copies").alias("copies")).where("copies > 1")
    held = work.write(groups.join(often.select("anchor", "contexts"), "anchor"), "held")
    mixed = held.where("contexts > 1")
    n = mixed.count()
    blocks = F.ceil(F.col("contexts") / BLOCK).cast("int")
    shard = F.pmod(F.xxhash64("anchor", F.pmod(F.xxhash64("ctx"), blocks)), F.lit(max(1, -(-n // SHARD)))).cast("int")
    wanted = mixed.select("one.doc_id", "one.text_key", F.struct(
        "anchor", "ctx", "one.lo", "one.hi", blocks.alias("blocks"), shard.alias("shard")).alias("c"))
    wanted = work.write(wanted.groupBy("doc_id", "text_key").agg(F.collect_list("c").alias("cs")), "wanted")
    met = _with_texts(docs, wanted)
    body = F.col("text").cast("binary")
    cuts = met.select(body.alias("raw"), F.explode("cs").alias("c")).select(
        "c.shard", "c.anchor", "c.ctx", "c.blocks", F.expr(f"substring(raw, c.lo + 1, c.hi - c.lo + {length})").alias("body"))
    cuts = cuts.dropDuplicates(["anchor", "ctx"])  # a document whose row is repeated gives its cuts twice
    found = work.write(_resolve(cuts, length), "found")
    more = _meet(found)
    whole = held.where("copies > 1").select("anchor", "ctx", F.lit(0).alias("first"), (F.col("one.hi") - F.col("one.lo")).alias("last"))
    matched = found.where("packed IS NULL").select("anchor", "ctx", "first", "last").unionByName(more).unionByName(whole)
    matched = work.write(matched.groupBy("anchor", "ctx").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "matched")
    placed = rows.join(matched, ["anchor", "ctx"]).select("doc_id", "text_key", F.explode("ranges").alias("r"), "lo")
    return work.write(placed.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(
        (F.col("lo") + F.col("r.first")).alias("first"), (F.col("lo") + F.col("r.last")).alias("last"))).alias("windows")), "windows")


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and
    kept, the bytes that stay).  Bytes under a string that starts twice are removed."""
    work = Workspace(docs.sparkSession, "repeats")
    windows = repeated_windows(docs, work, length)
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def plain(texts: list[str]) -> list[list]:
        raw = [t.encode() for t in texts]
        return [[len(b) for b in raw], [0] * len(raw), [0] * len(raw), [hashlib.sha256(b).hexdigest() for b in raw]] + [raw] * with_text

    keyed = docs.select("doc_id", text_of().alias("text")).withColumn("text_key", F.xxhash64("text"))
    keys = windows.select(F.col("text_key").alias("wanted_key"), F.col("doc_id").alias("wanted_id"))
    same = (keyed["text_key"] == keys["wanted_key"]) & keyed["doc_id"].eqNullSafe(keys["wanted_id"])
    small = keys.count() <= BROADCAST_IDS
    untouched = keyed.join(F.broadcast(keys) if small else keys, same, "left_anti")
    out = map_texts(untouched, ("doc_id",), fields, lambda: plain)

    schema = T.StructType.fromDDL("doc_id long, " + fields)
    arrow = to_arrow_schema(schema)

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns: list[list] = [[] for _ in range(4 + with_text)]
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    cover = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(cover, [r["first"] for r in ranges], 1)
                    np.add.at(cover, [r["last"] + length for r in ranges], -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    kept = raw[~gone].tobytes()
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    for c, v in zip(columns, (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]], schema=arrow)

    touched = _with_texts(docs, windows).select("doc_id", "text", "windows").mapInArrow(take_out, schema)
    return out.unionByName(touched)
