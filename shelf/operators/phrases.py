"""Large block lists: a dictionary of phrases joined to texts by its rarest words.

A pattern that names every phrase is right for a list of dozens.  A list of thousands is
a table, and this is the join for it.  Each phrase is filed under the one of its words
that fewest texts have.  Words of the texts look up whether anything is filed there;
where it is, the words around them are cut out as the phrases filed there would have
them, and that piece has to equal a phrase.  Both look-ups are made in a table of bits
first, where the text lies, so that only pieces that are phrases, and few others, are
dealt out to be compared with the list.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.functions.text import match_text
from shelf.operators import windows
from shelf.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

def phrase_words(phrases: DataFrame, phrase: str = "phrase") -> DataFrame:
    """The different phrases (phrase, words) that can occur in a normalised text: words of
    lower-case letters and digits.  Any other is in no text, as with a pattern."""
    plain = F.btrim(F.regexp_replace(F.col(phrase), r"(?U)\s+", " "))
    # as an array of none or one, for before a plain filter Spark makes the phrases twice
    usable = F.filter(F.array(plain), lambda p: p.rlike("^[a-z0-9]+(?: [a-z0-9]+)*$"))
    return phrases.select(F.explode_outer(usable).alias("phrase")).where("phrase IS NOT NULL").distinct().withColumn(
        "words", F.split("phrase", " "))


def filed(phrases: DataFrame, texts: DataFrame, words: str = "words") -> DataFrame:
    """Each phrase under its rarest word: phrase, word, at (place of the word), n (words).

    Words are counted in the texts per task before the shuffle."""
    each = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    each = written(each, "phrase-words")
    listed = each.select("word").distinct()
    seen = texts.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    often = seen.join(listed, "word", "left_semi")
    rank = F.struct(F.coalesce("often", F.lit(0)), "word", "at")
    best = each.join(often, "word", "left").groupBy("phrase", "n").agg(F.min_by(F.struct("word", "at"), rank).alias("best"))
    return best.select("phrase", "best.word", "best.at", "n")


def _salt(at: int, n: int) -> int:
    """Tells the hash of a phrase of n words, filed under the one at ``at``, from that of a word."""
    return (n << 32) + at + 1


def _filed_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of phrases (phrase, at, n) as they are filed, the hash of the word and of the phrase."""
    kept: dict = {}
    for batch in batches:
        for part, texts in windows.parts(batch):
            units, ends = windows.units_of(texts)
            own = windows.Windows(units, kept)
            starts = np.r_[0, ends[:-1]]
            shapes = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
            split = [t.split(" ") for t in texts]
            before = np.array([sum(map(len, w[:at])) + at for w, (at, _) in zip(split, shapes, strict=True)], np.int64)
            size = np.array([len(w[at]) for w, (at, _) in zip(split, shapes, strict=True)], np.int64)
            out = [own.of(starts + before, starts + before + size, 0)]
            for shape in set(shapes):
                rows = np.array([i for i, s in enumerate(shapes) if s == shape])
                out.append(own.of(starts[rows], ends[rows], _salt(*shape)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["h"])


def _pieces(plain: DataFrame, keys: Sequence[str], table: DataFrame) -> DataFrame:
    """(keys, phrase) for the pieces of normalised texts (column plain) that pass the bits of
    the list as it is filed; a piece comes once for a text."""
    shapes = sorted((r.at, r.n) for r in table.select("at", "n").distinct().collect())
    hashes = table.select("phrase", "at", "n").mapInArrow(_filed_hashes, "h long")
    shared = plain.sparkSession.sparkContext.broadcast((windows.bit_table(hashes, 2 * table.count()), shapes))
    source = plain.select(F.col("plain").alias("own text"), *keys)
    out = T.StructType([*source.schema.fields[1:], T.StructField("phrase", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, shapes), kept = shared.value, {}
        for batch in batches:
            for part, texts in windows.parts(batch):
                data = np.frombuffer("\n".join([*texts, ""]).encode(), np.uint8)
                own = windows.Windows(data, kept)
                ends = np.flatnonzero(data <= 32)
                starts = np.r_[0, ends[:-1] + 1]
                starts, ends = starts[starts < ends], ends[starts < ends]
                row = np.searchsorted(np.flatnonzero(data == 10), starts)
                at_word = windows.known(bits, own.of(starts, ends, 0))
                found = []
                for at, n in shapes:
                    first = at_word[(at_word >= at) & (at_word < len(starts) + at + 1 - n)] - at
                    first = first[row[first] == row[first + n - 1]]
                    here = first[windows.known(bits, own.of(starts[first], ends[first + n - 1], _salt(at, n)))]
                    found.append(np.stack([row[here], starts[here], ends[here + n - 1]]))
                if not sum(f.shape[1] for f in found):
                    continue
                rows, a, b = np.concatenate(found, axis=1)
                once = pa.table({"row": pa.array(rows), "phrase": pa.array(windows.as_text(data, a, b), pa.string())}).group_by(
                    ["row", "phrase"], use_threads=False).aggregate([]).combine_chunks()
                rows = once.column("row").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [*[c.take(rows) for c in part.columns[1:]], once.column("phrase").combine_chunks()], names=out.names)

    return source.mapInArrow(run, out)


def _hits(plain: DataFrame, phrases: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, phrase) where a normalised text (column plain) holds a phrase, once for each text."""
    table = written(filed(phrase_words(phrases), plain.select(F.split("plain", " ").alias("words"))), "filed")
    return _pieces(plain, keys, table).join(table.select("phrase"), "phrase", "left_semi").select(*keys, "phrase")


def phrase_hits(texts: DataFrame, phrases: DataFrame, keys: Sequence[str], text: str = "text",
                cleaned: bool = False) -> DataFrame:
    """The different (keys, phrase) where a text holds a phrase of the list.

    A phrase is matched as whole words of the normalised text.  The list is written
    first, so that Spark knows its size and broadcasts it only if it is small.  The hits
    are dealt out by key, as most of what is made of them is.
    """
    plain = written(texts.select(*keys, match_text(F.col(text), cleaned).alias("plain")), "plain")
    return _hits(plain, phrases, keys).repartition(*keys).distinct()


def with_blocked(texts: DataFrame, phrases: DataFrame, keys: Sequence[str], text: str = "text",
                 patterns: Sequence[str] = (), cleaned: bool = False) -> DataFrame:
    """``keys`` and whether the text holds a phrase of the list or fits a pattern.  Keys
    have to tell the texts apart."""
    plain = written(texts.select(*keys, match_text(F.col(text), cleaned).alias("plain")), "plain")
    hit = _hits(plain, phrases, keys).select(*keys).distinct().withColumn("_hit", F.lit(True))
    # as ``rules.is_blocked``, for which the text is normal already
    fits = F.col("plain").rlike("|".join(patterns)) if patterns else F.lit(False)
    rows = plain.select(*keys, fits.alias("_fits")).join(hit, list(keys), "left")
    return rows.select(*keys, (F.col("_fits") | F.coalesce("_hit", F.lit(False))).alias("blocked"))
