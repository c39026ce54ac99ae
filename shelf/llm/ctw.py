"""Byte language model by context-tree weighting.

A byte is coded as eight binary decisions, each in the context of the bits before it
and of up to ``DEPTH`` bytes before.  Every context node keeps a Krichevsky-Trofimov
estimate, and the weight of a node against its longer contexts is the ratio of the block
probabilities of context-tree weighting.  All contexts of all training documents
are counted.  Trees under the last three bytes are weighted in shards, the top of the tree
is put together from their sums, and a second pass gives each node its mixture over
all depths from the root.

Scoring looks every context up in the whole model, which stays dealt over its shards.
Documents are taken in blocks; the different grams of a block (at most about ``SLOTS``
for the memory of a task) are sent to their shards, the shard finds each in its complete
levels, and the answers meet the texts of their block again.  Nothing is left out or
predicted from a shorter context than the deepest one that was counted.  Probabilities
of the bytes in a context sum to one.

Word counts for the unigram base go the same way: the counts of all training documents
are one table; the most frequent words are looked up from a broadcast table of fixed size
and the other words of each document are joined to the whole table.

Defined cases: null and empty texts are one end symbol; A-Z count as lower case; texts
of any length are scored whole; repeated rows are counted and scored each; a null doc_id
is in fold 0; without training rows every bit has probability one half and all counts
are 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelf.llm.common import Workspace, partitions, text_of
from shelf.llm.minhash import mix, word_hashes

DEPTH, TOP = 6, 2
#: Shards of the deeper nodes, and different grams after which a block of documents
#: is closed: 8 bytes each, 20 MB.
SHARDS, SLOTS = 256, 5 << 19
#: Different grams, or words, that a task counts at once before it hands them on.
COUNTED = 600_000
#: Words looked up by broadcast, 16 bytes each.
FREQUENT = 200_000
#: Bits of a worker's table of grams already scored: 16 MB.
REMEMBERED = 20
#: Bytes worked on at once.
CHUNK = 1 << 20
#: Stand-ins that never occur in UTF-8: before a text, and after it.
START, STOP = 0xFE, 0xFF
#: Kind of a counted row: byte contexts, words, and documents.
GRAMS, WORDS, ENDS = 0, 1, 2
#: Rows between blocks and shards.  A shard's own row comes before those of blocks, the
#: texts of a block after its answers.
SENT = "block long, shard int, data binary, more binary"
MODEL, TEXTS = -1, 1 << 30

_U = np.uint64


def _mask(depth: int) -> np.uint64:
    return _U((1 << (8 * (depth + 1))) - 1)


def codes(text: str) -> np.ndarray:
    """Each byte with its context, the context's last byte next to it."""
    raw = text.encode().lower()
    b = np.frombuffer(bytes([START]) * DEPTH + raw + bytes([STOP]), np.uint8).astype(np.uint64)
    n = len(raw) + 1
    out = np.zeros(n, np.uint64)
    for k in range(DEPTH + 1):
        out = (out << _U(8)) | b[k:k + n]
    return out


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= CHUNK:
            yield own
            own, size = [], 0
    if own:
        yield own


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def count_corpus(docs: DataFrame) -> DataFrame:
    """(kind, key, n): contexts with their byte, words, and documents, over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAMS: [], WORDS: []}
        ends = 0

        def rows(kind):
            keys, n = _merged(held[kind])
            held[kind] = []
            for at in range(0, len(keys), 100_000):
                own = keys[at:at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), kind, np.int32)), pa.array(own), pa.array(n[at:at + 100_000])], names=["kind", "key", "n"])

        for batch in batches:
            for own in _chunks([t or "" for t in batch.column(0).to_pylist()]):
                ends += len(own)
                held[GRAMS].append(np.unique(np.concatenate([codes(t) for t in own]), return_counts=True))
                held[WORDS].append(np.unique(np.concatenate([word_hashes(t) for t in own]), return_counts=True))
                # what a task holds at once is bounded; the rest is added up later
                for kind in held:
                    if len(held[kind]) >= 4:
                        held[kind] = [_merged(held[kind])]
                        if len(held[kind][0][0]) > COUNTED:
                            yield from rows(kind)
        for kind in held:
            yield from rows(kind)
        yield pa.RecordBatch.from_arrays([pa.array([ENDS], pa.int32()), pa.array([0], pa.int64()), pa.array([ends], pa.int64())], names=["kind", "key", "n"])

    each = docs.select(text_of().alias("text")).mapInArrow(count, "kind int, key long, n long")
    return each.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    less = np.zeros_like(x)
    y = x.copy()
    while (small := y < 8).any():
        less[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - less


def block_probability(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _nodes(grams: np.ndarray, counts: np.ndarray, k: int):
    """Nodes of bit k: key (context, bits before with a leading one), n0, n1.  The
    grams have to be sorted, as their nodes then are too."""
    symbol = grams & _U(255)
    keys = (grams >> _U(8) << _U(8)) | (symbol >> _U(8 - k)) | _U(1 << k)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    one = ((symbol >> _U(7 - k)) & _U(1)).astype(np.float64)
    if not len(first):
        return keys, np.zeros(0), np.zeros(0)
    return keys[first], np.add.reduceat(counts * (1 - one), first), np.add.reduceat(counts * one, first)


def weigh(grams: np.ndarray, counts: np.ndarray, top: int):
    """Bottom-up pass over the trees of depths DEPTH to ``top``.

    Gives by depth and bit (keys, n0, n1, log odds of ending here), and by bit the
    sums over the topmost nodes by the context one byte shorter: keys, n0, n1, s."""
    levels: dict[int, list] = {}
    below = None
    for depth in range(DEPTH, top - 1, -1):
        own, at = np.unique(grams & _mask(depth), return_inverse=True)
        total = np.bincount(at, weights=counts, minlength=len(own))
        levels[depth], weighted = [], []
        for k in range(8):
            keys, n0, n1 = _nodes(own, total, k)
            ends = block_probability(n0, n1)
            if below is None:
                odds, value = np.full(len(keys), np.inf), ends
            else:
                parent = np.searchsorted(keys, below[k][0] & _mask(depth))
                goes_on = np.bincount(parent, weights=below[k][1], minlength=len(keys))
                odds, value = ends - goes_on, np.logaddexp(ends, goes_on) - math.log(2)
            levels[depth].append((keys, n0, n1, odds))
            weighted.append((keys, value))
        below = weighted
    sums = []
    for k in range(8):
        keys, n0, n1, _ = levels[top][k]
        up, at = np.unique(keys & _mask(top - 1), return_inverse=True)
        sums.append((up, *(np.bincount(at, weights=w, minlength=len(up)) for w in (n0, n1, below[k][1]))))
    return levels, sums


def _share(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def mixtures(levels: dict[int, list], start: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Top-down pass: by depth and bit, the probability of a one mixed over all depths
    down to each node.  ``start``: by bit, keys of the nodes above with what they hand
    down (probability so far, weight left)."""
    for depth in sorted(levels):
        handed = []
        for k, (keys, n0, n1, odds) in enumerate(levels[depth]):
            above, so_far, left = start[k]
            if len(above):
                at = np.minimum(np.searchsorted(above, keys & _mask(depth - 1)), len(above) - 1)
                so_far, left = so_far[at], left[at]
            else:
                so_far, left = np.zeros(len(keys)), np.ones(len(keys))
            own = (n1 + 0.5) / (n0 + n1 + 1)
            ends = _share(odds)
            yield depth, keys, so_far + left * own, n0 + n1
            handed.append((keys, so_far + left * ends * own, left * (1 - ends)))
        start = handed
    return start


def _drained(levels, start):
    """All of :func:`mixtures` and what its last level hands down."""
    steps, out = mixtures(levels, start), []
    while True:
        try:
            out.append(next(steps))
        except StopIteration as end:
            return out, end.value


def _shard_of(grams: np.ndarray) -> np.ndarray:
    return (mix((grams >> _U(8)) & _U(0xFFFFFF)) & _U(SHARDS - 1)).astype(np.int64)


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The different values, sorted.  (np.unique hashes, which is slower here.)"""
    x = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _packed(grams: np.ndarray) -> bytes:
    """Sorted grams, their bytes by place, compressed."""
    planes = np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8).T)
    return len(grams).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["block", "shard", "data", "more"])


def _questions(block: int, grams: np.ndarray) -> list[tuple]:
    """Rows (block, shard, packed grams, nothing) of sorted grams."""
    shard = _shard_of(grams)
    order = np.argsort(shard, kind="stable")
    own, first = np.unique(shard[order], return_index=True)
    return [(block, int(s), _packed(g), None) for s, g in zip(own, np.split(grams[order], first[1:]), strict=True)]


def _by_depth(steps: list[tuple]) -> dict[int, list]:
    """By depth and bit (keys, probability of a one) of what :func:`mixtures` gives."""
    out: dict[int, list] = {}
    for depth, keys, p, _ in steps:
        out.setdefault(depth, []).append((keys, p))
    return out


def gram_scores(grams: np.ndarray, levels: dict[int, list]) -> np.ndarray:
    """Log probability of each byte in its context, from the deepest nodes there are."""
    symbol, context = grams & _U(255), grams >> _U(8) << _U(8)
    total = np.zeros(len(grams))
    for k in range(8):
        node = context | (symbol >> _U(8 - k)) | _U(1 << k)
        p, rest = np.full(len(grams), 0.5), np.arange(len(grams))
        for depth in sorted(levels, reverse=True):
            keys, value = levels[depth][k]
            if not len(keys) or not len(rest):
                continue
            own = node[rest] & _mask(depth)
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            p[rest[hit]] = value[at[hit]]
            rest = rest[~hit]
        total += np.log10(np.where((symbol >> _U(7 - k)) & _U(1) == 1, p, 1 - p))
    return total


class Book:
    """The answers that one block has: sorted grams with their scores."""

    def __init__(self, answers: list[tuple[bytes, bytes]]):
        keys = np.concatenate([_unpacked(g) for g, _ in answers])
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.concatenate([np.frombuffer(v) for _, v in answers])[order]
        # no gram has all bits set
        self.seen_key = np.full(1 << REMEMBERED, np.iinfo(np.uint64).max, np.uint64)
        self.seen_value = np.zeros(1 << REMEMBERED)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """The score of each gram; those last seen are kept in a table of fixed size."""
        slot = ((grams * _U(0x9E3779B97F4A7C15)) >> _U(64 - REMEMBERED)).astype(np.int64)
        out = self.seen_value[slot]
        new = np.flatnonzero(self.seen_key[slot] != grams)
        if len(new):
            own, first, at = np.unique(grams[new], return_index=True, return_inverse=True)
            value = self.values[np.searchsorted(self.keys, own)]
            out[new] = value[at]
            slot = slot[new[first]]
            self.seen_key[slot], self.seen_value[slot] = own, value
        return out

    def scores(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        for own in _chunks(texts):
            each = [codes(t) for t in own]
            starts = np.concatenate([[0], np.cumsum([len(c) for c in each])[:-1]])
            out += np.add.reduceat(self.log10(np.concatenate(each)), starts).tolist()
        return out


class Model:
    """The counted grams by shard, and what is above them: ``top``, the nodes of two
    context bytes and less, and ``handed``, what they hand down."""

    def __init__(self, sharded: DataFrame, top: dict[int, list], handed: list[tuple], slots: int):
        self.sharded, self.slots = sharded, slots
        self.shared = sharded.sparkSession.sparkContext.broadcast((top, handed))

    def answers(self, asked: DataFrame) -> DataFrame:
        """The rows ``asked`` (SENT) with the scores of their grams in ``more``."""
        shared, most = self.shared, self.slots

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top, handed = shared.value
            at, levels, held, size = None, top, [], 0

            def told():
                grams = [_unpacked(data) for _, data in held]
                every = _distinct(grams)
                score = gram_scores(every, levels)
                # one by one, so that a batch does not hold them all
                for (block, data), own in zip(held, grams, strict=True):
                    yield _sent([(block, at, data, score[np.searchsorted(every, own)].tobytes())])

            for batch in batches:
                for block, shard, data, more in zip(*batch.columns, strict=True):
                    block, shard, data = block.as_py(), shard.as_py(), data.as_py()
                    if shard != at or size >= most:
                        yield from told()
                        held, size = [], 0
                    if shard != at:
                        at, levels = shard, top
                    if block == MODEL:
                        own = _unpacked(data)
                        counts = pa.decompress(more.as_py(), decompressed_size=8 * len(own), codec="zstd", asbytes=True)
                        own, _ = weigh(own, np.frombuffer(counts, np.int64), TOP + 1)
                        levels = top | _by_depth(_drained(own, handed)[0])
                    else:
                        held.append((block, data))
                        size += int.from_bytes(data[:8], "little")
            yield from told()

        own = self.sharded.select(F.lit(MODEL).cast("long").alias("block"), "shard", F.col("grams").alias("data"), F.col("counts").alias("more"))
        met = own.unionByName(asked).repartition(partitions(asked.sparkSession), "shard")
        return met.sortWithinPartitions("shard", "block").mapInArrow(answer, SENT)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each byte in its context, for a few grams of the driver."""
        asked = self.sharded.sparkSession.createDataFrame(_questions(0, _distinct([grams])), SENT)
        return Book([(r.data, r.more) for r in self.answers(asked).collect()]).log10(grams)


def train(counted: DataFrame, work: Workspace, slots: int = SLOTS) -> Model:
    """The model of a table of counts (kind, key, n).  ``slots``: see :func:`score_texts`."""
    grams = counted.where(F.col("kind") == GRAMS).select("key", "n")

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(keys).astype(np.int32)), *batch.columns], names=["shard", "key", "n"])

    def first_pass(key, part: pd.DataFrame) -> pd.DataFrame:
        own, n = part["key"].to_numpy().view(np.uint64), part["n"].to_numpy()
        order = np.argsort(own)
        own, n = own[order], n[order]
        _, sums = weigh(own, n, TOP + 1)
        flat = [np.concatenate(x) for x in zip(*[(np.full(len(s[0]), k, np.float64), *s) for k, s in enumerate(sums)], strict=True)]
        return pd.DataFrame({
            "shard": [key[0]], "grams": [_packed(own)], "counts": [pa.compress(n.astype(np.int64), codec="zstd", asbytes=True)],
            "bit": [flat[0].astype(np.int64)], "up": [flat[1].view(np.int64)], "n0": [flat[2]], "n1": [flat[3]], "s": [flat[4]]})

    sharded = grams.mapInArrow(shard_of, "shard int, key long, n long").groupBy("shard").applyInPandas(
        first_pass, "shard int, grams binary, counts binary, bit array<long>, up array<long>, n0 array<double>, n1 array<double>, s array<double>")
    sharded = work.write(sharded, "shards")
    zipped = sharded.select(F.explode(F.arrays_zip("bit", "up", "n0", "n1", "s")).alias("x")).select("x.*")
    top = zipped.groupBy("bit", "up").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "s")]).orderBy("bit", "up").toPandas()
    return Model(sharded, *_top(top), slots)


def _top(sums: pd.DataFrame):
    """The nodes of TOP context bytes and less, from the sums of the shards, by depth
    and bit, and what the level of TOP hands down."""
    levels: dict[int, list] = {d: [] for d in range(TOP + 1)}
    for k in range(8):
        own = sums[sums["bit"] == k]
        keys, n0, n1, s = own["up"].to_numpy(np.int64).view(np.uint64), own["n0"].to_numpy(), own["n1"].to_numpy(), own["s"].to_numpy()
        for depth in range(TOP, -1, -1):
            ends = block_probability(n0, n1)
            levels[depth].append((keys, n0, n1, ends - s))
            value = np.logaddexp(ends, s) - math.log(2)
            if depth:
                keys, at = np.unique(keys & _mask(depth - 1), return_inverse=True)
                n0, n1, s = (np.bincount(at, weights=w, minlength=len(keys)) for w in (n0, n1, value))
    none = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))] * 8
    steps, handed = _drained(levels, none)
    return _by_depth(steps), handed


def blocks(docs: DataFrame, keep: tuple[str, ...], slots: int) -> DataFrame:
    """Rows SENT of blocks of documents: their texts with the columns ``keep``, and for
    each shard the different grams of the block."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            at = 0
            for own in _chunks(texts):
                sink = pa.BufferOutputStream()
                part = batch.slice(at, len(own))
                at += len(own)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield _sent([(block, TEXTS, sink.getvalue().to_pybytes(), None)])
                held.append(_distinct([codes(t) for t in own]))
                size += len(held[-1])
                if size >= 2 * slots or len(held) >= 16:
                    held = [_distinct(held)]
                    size = len(held[0])
                    if size >= slots:
                        yield from (_sent([q]) for q in _questions(block, held[0]))
                        block, held, size = block + 1, [], 0
        if held:
            yield from (_sent([q]) for q in _questions(block, _distinct(held)))

    return docs.select(text_of().alias("own text"), *keep).mapInArrow(cut, SENT)


def _frequent(words: DataFrame, most: int = FREQUENT) -> DataFrame:
    """The words from the least power of two on that at most ``most`` words reach.  A
    sorted limit would send that many words of every task to the driver."""
    size = F.floor(F.log2("n")).cast("int")
    sizes = sorted(words.groupBy(size.alias("size")).count().collect(), reverse=True)
    least, total = 63, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["size"]
    return words.where(size >= least)


def score_texts(docs: DataFrame, held_out: str, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, the column ``held_out``, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte (the code length of the text over
    its bytes; null for an empty text).  Rows with ``held_out`` are not learned from.
    ``slots``: the different grams that a task holds at once, about; no result depends on it."""
    spark = docs.sparkSession
    work = Workspace(spark, "ctw")
    counted = work.write(count_corpus(docs.where(~F.col(held_out))), "counts")
    words = work.write(counted.where(F.col("kind") == WORDS).select("key", "n"), "words")
    in_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counted.where(F.col("kind") == ENDS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, kinds = in_words + ends, distinct + (ends > 0)
    often = _frequent(words).toPandas().sort_values("key")
    model = train(counted, work, slots)
    work.drop("counts")  # the shards have them
    sent = work.write(blocks(docs, ("doc_id", held_out), slots), "blocks")
    texts = sent.where(F.col("shard") == TEXTS)
    number = max(partitions(spark), texts.select("block").distinct().count())
    met = model.answers(sent.where(F.col("shard") != TEXTS)).unionByName(texts).repartition(number, "block").sortWithinPartitions("block", "shard")
    shared = spark.sparkContext.broadcast((often["key"].to_numpy(np.int64), often["n"].to_numpy(np.int64)))
    kept = docs.select("doc_id", held_out).schema.fields
    out = T.StructType(kept + T.StructType.fromDDL("n_tokens long, part double, seen long, rest array<long>, n_bytes long, score double").fields)
    types = [f.type for f in to_arrow_schema(out)]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value
        log_n = np.log10(n + 1.0)

        def each(texts: list[str], book: Book) -> list[list]:
            count, part, seen, rest = [], [], [], []
            for t in texts:
                w = word_hashes(t).view(np.int64)
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                hit = known[at] == w if len(known) else np.zeros(len(w), bool)
                count.append(len(w) + 1)
                part.append(float(log_n[at[hit]].sum()) if hit.any() else 0.0)
                seen.append(int(hit.sum()))
                rest.append(w[~hit])
            return [count, part, seen, rest, [len(t.encode()) for t in texts], book.scores(texts)]

        held, book = [], None
        for batch in batches:
            for _, shard, data, more in zip(*batch.columns, strict=True):
                if shard.as_py() != TEXTS:
                    held.append((data.as_py(), more.as_py()))
                    continue
                if held:  # the first texts of a block
                    book, held = Book(held), []
                for part in pa.ipc.open_stream(data.as_py()):
                    new = each(part.column(0).to_pylist(), book)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[1:], *[pa.array(c, type=t) for c, t in zip(new, types[len(kept):], strict=True)]], names=out.names)

    looked = work.write(met.mapInArrow(score, out).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = looked.select("row", F.explode("rest").alias("key")).join(words, "key")
    rare = rest.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("rare"))
    base = F.col("part") + F.coalesce("more", F.lit(0.0)) + math.log10(ends + 1) - F.col("n_tokens") * math.log10(tokens + kinds + 1)
    return looked.drop("rest").join(rare, "row", "left").select(
        "doc_id", held_out, "n_tokens", (F.col("seen") + F.coalesce("rare", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes",
        F.when(F.col("n_bytes") > 0, -F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
