"""Token counts by a two-tier look-up on the map side.

A text is cut before each blank that has no white space on both sides.  The
library's pre-tokenizer never joins what is on the two sides of such a cut, so each
piece, a pre-token with what is glued to it, has the same tokens alone as in the
text.  First the lengths of the most frequent pieces of the corpus are gathered:
each task keeps a bounded count of its pieces and hands on its top ones.  The table
made of them has a fixed number of entries and is broadcast.  In the second pass a
piece that is not in it goes to a bounded cache of the worker, and what is not there
either is encoded.  No pre-token is ever shuffled, only each task's summary.
The table and caches decide speed; the counts are exact whatever they hold.

Defined cases: null and empty texts have no tokens; texts with the string of an
added token, or with a cut that would have white space on both sides, go to the
library whole; repeated rows are counted each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import collections
import heapq
import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelf.llm.common import map_texts, per_worker, text_of

#: Entries of the broadcast table, and the longest piece in it: at most 4 MB of text.
TABLE_ENTRIES, TABLE_PIECE = 65_536, 64
#: Pieces that a task counts at once before it drops the rarer half, and hands on.
COUNTED, HANDED_ON = 400_000, 16_384
#: Entries of a worker's cache.
CACHED = 300_000

_UNSAFE_CUT = re.compile(r"\s (?:\s|\Z)")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def library(path: str):
    """The tokenizer of a file, as a function from texts to lists of ids."""
    return per_worker(("library", path), lambda: _library(path))


def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def added_tokens(path: str) -> tuple[str, ...]:
    if path.endswith(".model"):
        return ()
    with open(path, encoding="utf-8") as file:
        return tuple(x["content"] for x in json.load(file)["added_tokens"])


def cuts_at_blanks(path: str) -> bool:
    """Whether the tokenizer splits before blanks as the module's text says: a
    byte-level pre-tokenizer with its own pattern, and no normaliser."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    before = made.get("pre_tokenizer") or {}
    return (made.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space", True))


def pieces(text: str, added: tuple[str, ...]) -> list[str] | None:
    """The text cut before its blanks, or None if the library has to see it whole.
    Pieces lack their leading blank; the first has one as a mark that it had none."""
    if _UNSAFE_CUT.search(text) or any(x in text for x in added):
        return None
    first, *rest = text.split(" ")
    return [" " + first, *rest]


def whole(piece: str) -> str:
    return piece[1:] if piece[:1] == " " else " " + piece


def frequent_pieces(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """The lengths of the most frequent pieces, counted over all documents."""
    if not cuts_at_blanks(path):
        return {}

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        added, seen = added_tokens(path), collections.Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(pieces(text, added) or ())
                if len(seen) > COUNTED:
                    seen = collections.Counter(dict(seen.most_common(COUNTED // 2)))
        top = heapq.nlargest(HANDED_ON, ((n, p) for p, n in seen.items() if len(p) <= TABLE_PIECE))
        yield pd.DataFrame({"piece": pd.Series([p for _, p in top], dtype=object), "n": [n for n, _ in top]})

    counts = docs.select(text_of().alias("text")).mapInPandas(summaries, "piece string, n long")
    top = counts.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries)
    found = [r.piece for r in top.select("piece").collect()]
    return dict(zip(found, map(len, library(path)([whole(p) for p in found])), strict=True))


class _Lengths(dict):
    """Lengths of pieces: the broadcast table, and below it the worker's cache."""

    def __init__(self, table: dict[str, int]):
        super().__init__()
        self.table, self.missing = table, set()

    def __missing__(self, piece: str) -> int:
        n = self.table.get(piece)
        if n is None:
            self.missing.add(piece)
            return 0
        return n


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512,
                 table: dict[str, int] | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    spark: SparkSession = docs.sparkSession
    path = path or tokenizer_path()
    shared = spark.sparkContext.broadcast(frequent_pieces(docs, path) if table is None else table)

    def counter():
        encode, added, known, by_piece = library(path), added_tokens(path), _Lengths(shared.value), cuts_at_blanks(path)

        def count(texts: list[str]) -> list[list[int]]:
            cut = [pieces(t, added) if by_piece else None for t in texts]
            numbers = [0 if c is None else sum(map(known.__getitem__, c)) for c in cut]
            if known.missing:
                new, known.missing = known.missing, set()
                if len(known) + len(new) > CACHED:
                    known.clear()
                own = list(new)
                known.update(zip(own, map(len, encode([whole(p) for p in own])), strict=True))
                # pieces of this part that were dropped just now are encoded again
                for i, c in enumerate(cut):
                    if c is not None and not new.isdisjoint(c):
                        numbers[i] = sum(map(known.__getitem__, c))
                        if known.missing:
                            again, known.missing = list(known.missing), set()
                            known.update(zip(again, map(len, encode([whole(p) for p in again])), strict=True))
                            numbers[i] = sum(map(known.__getitem__, c))
            at = [i for i, c in enumerate(cut) if c is None]
            for i, ids in zip(at, encode([texts[i] for i in at]), strict=True):
                numbers[i] = len(ids)
            return [[len(t.encode()) for t in texts], numbers]

        return count

    return map_texts(docs, ("doc_id",), "n_bytes long, n_tokens long", counter).withColumn("over_limit", F.col("n_tokens") > limit)
