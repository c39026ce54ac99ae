"""Best-fit packing of documents into token sequences, certified by lower bounds.

A document longer than a sequence is cut: whole sequences of it at its end, the rest
in front.  Pieces are dealt over partitions and packed best-fit decreasing.  A
partition's number of sequences is compared with the bound that dual feasible
functions give for its pieces.  Equal: certified, done.  Otherwise its open
sequences, those with room left, give their pieces to an exchange, where the pieces
of several such partitions meet and are packed again, until nothing is gained.

Defined cases: null texts are empty and are one end token; ties in length are packed
in order of (doc_id, piece); rows that repeat a doc_id are packed each, under equal
keys; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelf.llm.common import Workspace, per_worker, text_of
from shelf.llm.tokens import tokenizer_path

#: Pieces that one packing task holds, about 50 bytes each.
PIECES_A_TASK = 20_000
#: Room in a sequence's number for the round, and for its place in a part.
ROUND_BITS, PLACE_BITS = 10, 24
#: White space in a row from which on a text is left to the tokenizer file's own library.
LONG_BLANK = 50_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACE = f"{_PIECE}, part long, bin long, offset long, room long, gap long"


def encoder(path: str):
    return per_worker(("encoder", path), lambda: _encoder(path))


def _encoder(path: str):
    """A function from a text to its ids as an array of unsigned 32-bit numbers.

    The file's vocabulary is run by the faster of two libraries when it says the same
    in both: byte-level, merges in the order of their ids, no normaliser.  Texts with a
    very long run of white space, which only the file's own library takes, go to that."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    ranks, tokenizer = _merge_ranks(made), Tokenizer.from_file(path)

    def own(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    if ranks is None:
        return own
    import public_tokenizers
    import tiktoken

    added = {x["content"]: x["id"] for x in made["added_tokens"]}
    encoding = tiktoken.Encoding(
        "packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    blank = re.compile(r"\s{%d}" % LONG_BLANK)

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_BLANK and blank.search(text):
            return own(text)
        return encoding.encode_to_numpy(text, allowed_special="all")

    return encode


def _merge_ranks(made: dict) -> dict[bytes, int] | None:
    before, model = made.get("pre_tokenizer") or {}, made["model"]
    plain = (made.get("normalizer") is None and made.get("post_processor") is None
             and before.get("type") == "ByteLevel" and before.get("use_regex", True)
             and not before.get("add_prefix_space", True) and model["type"] == "BPE"
             and not model.get("dropout") and not model.get("ignore_merges")
             and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in made["added_tokens"]))
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    if not plain or ids != sorted(set(ids)) or -1 in ids:
        return None
    # the printable stand-ins of bytes: printable ones as they are, others from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    added = {x["content"] for x in made["added_tokens"]}
    return {bytes(map(back.__getitem__, token)): i for token, i in model["vocab"].items() if token not in added}


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the rest first, then whole sequences."""
    whole, rest = divmod(total, capacity)
    return [rest] * bool(rest) + [capacity] * whole


def tokenized(docs: DataFrame, capacity: int, path: str, end_id: int, with_ids: bool) -> DataFrame:
    """One row per piece, with a checksum of its ids and, if wanted, the ids."""
    schema = T.StructType.fromDDL(_PIECE + (", ids array<int>" if with_ids else ""))
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path), np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    ids = np.concatenate([encode(text).astype("<u4", copy=False), end])
                    start = 0
                    for piece, n in enumerate(cut_lengths(len(ids), capacity)):
                        own = ids[start:start + n]
                        rows.append((doc_id, piece, start, n, zlib.crc32(own.tobytes()), *([own.astype(np.int32)] * with_ids)))
                        start += n
                columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The least number of sequences that any packing needs: the best of the plain
    sum and two families of dual feasible functions over all thresholds.

    u(t): lengths over capacity-t count as whole, those under t as nothing.
    f(k): k times a length over the capacity, rounded down unless whole."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(counts * size)])
    number = np.concatenate([[0], np.cumsum(counts)])
    t = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = total[capacity - t + 1] - total[t]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, 101):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the room left in each bin.  Lengths have to
    be in falling order.  Bins are kept by their room, the rooms in use as bits of one
    number, so the tightest fit is found by a shift."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, room = 0, []
    for i, n in enumerate(lengths.tolist()):
        fits = used >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            own = by_room[r]
            b = own.pop()
            if not own:
                used &= ~(1 << r)
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r = r - n
        if r:
            by_room[r].append(b)
            used |= 1 << r
    return bins, offsets, np.array(room, np.int64)


def _pack_each(pieces: DataFrame, capacity: int) -> DataFrame:
    """Pack the pieces of each ``part``.  ``gap``: sequences above the bound."""
    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable")
        lengths = part["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        return part.assign(bin=bins, offset=offsets, room=room[bins], gap=len(room) - lower_bound(lengths, capacity))

    return pieces.groupBy("part").applyInPandas(pack, _PLACE)


def _dealt(pieces: DataFrame, n: int, seed: int) -> DataFrame:
    """Deal pieces over parts so that all lengths and sources mix."""
    parts = max(1, -(-n // PIECES_A_TASK))
    return pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), F.lit(parts)))


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 0,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids).  Sequences are numbered by round, part and place in it, not densely."""
    work = Workspace(docs.sparkSession, "packing")
    cut = work.write(tokenized(docs, capacity, path or tokenizer_path(), end_id, with_ids), "pieces")
    pieces = cut.drop("ids")
    placed = work.write(_pack_each(_dealt(pieces, pieces.count(), 0), capacity), "round0")
    done, before = [], None
    for number in range(1 << ROUND_BITS):
        # bins without room stay; of parts with a gap all others take part
        numbered = placed.withColumn(
            "sequence_id", F.shiftleft(F.shiftleft("part", ROUND_BITS) + number, PLACE_BITS) + F.col("bin"))
        open_pieces = placed.where("gap > 0 AND room > 0").select(*pieces.columns)
        state = placed.agg(
            F.sum(F.expr("int(gap > 0 AND room > 0)")), F.sum(F.expr("CASE WHEN gap > 0 THEN room * length END")),
            F.countDistinct(F.expr("CASE WHEN gap > 0 AND room > 0 THEN struct(part, bin) END"))).first()
        # an exchange that leaves as many sequences open as before has gained nothing
        if not state[0] or (before is not None and state[2] >= before) or number + 1 == 1 << ROUND_BITS:
            done.append(numbered)
            break
        done.append(numbered.where("NOT (gap > 0 AND room > 0)"))
        before = state[2]
        placed = work.write(_pack_each(_dealt(open_pieces, state[0], number + 1), capacity), f"round{number + 1}")
    out = functools.reduce(DataFrame.unionByName, done).select(*pieces.columns, "sequence_id", "offset")
    if with_ids:
        out = out.join(cut.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and where each document starts.
    ``packed`` is the result of :func:`pack` with ids; a group is one sequence."""
    part = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "start")))
    return packed.groupBy("sequence_id").agg(part.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["offset"], p["start"])).alias("documents"))
