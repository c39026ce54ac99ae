"""An index for repeated searches of a part of a text.

A search that reads every text is right once.  For many, the texts' character trigrams
are written as postings, in order of trigram, with the number of texts of each.  A row of
the postings has a trigram and the ids of a stretch of texts that hold it, so that ids are
sorted in their task and only stretches are dealt out.  A term is looked up by its rarest
trigram only, and what that gives is checked with the term itself, so the result is that
of the full search.

Many terms at once are looked for together.  Their rarest trigrams say which of them can
be found at all, and which texts have to be read, where those are fewer than all.  In the
texts, windows as long as the terms are looked up in a table of bits, so a text is gone
through once for all terms and never meets them one by one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.operators import windows
from shelf.session import new_folder, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# not from within a character of two units on
_GRAM = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(...))"


def grams(text: Column) -> Column:
    """The different trigrams of a text, of any length, in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_GRAM), F.lit(1)))


def term_of(text: Column) -> Column:
    """A term as the search reads it: trimmed, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def pieces(texts: DataFrame, size: int) -> DataFrame:
    """(gram, n, ids): the different pieces of ``size`` characters, up to three, of stretches
    of texts (id, text), and the ids of the n texts there that hold each."""
    source = texts.select(F.make_valid_utf8("text"), "id")
    out = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.IntegerType()),
                        T.StructField("ids", T.ArrayType(source.schema["id"].dataType))])

    def held(part: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """The pieces in order, how many texts hold each, and these by their place."""
        units, ends = windows.units_of(part)
        n = len(units) - size + 1
        if n < 1:
            return
        letters = np.zeros(int(units.max()) + 1, bool)
        letters[units] = True
        letters = np.flatnonzero(letters)
        wide, deep = max(1, int(len(letters) - 1).bit_length()), int(len(part) - 1).bit_length()
        if size * wide + deep > 63:
            half = len(part) // 2
            for at, some in ((0, part[:half]), (half, part[half:])):
                for grams, sizes, rows in held(some):
                    yield grams, sizes, rows + at
            return
        code = np.searchsorted(letters, units)
        row = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
        key = np.zeros(n, np.int64)
        for i in range(size):
            key = key << wide | code[i:i + n]
        key = (key << deep | row[:n])[row[:n] == row[size - 1:]]
        if not len(key):
            return
        key = np.sort(key)
        key = key[np.r_[True, key[1:] != key[:-1]]]
        gram = key >> deep
        first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        at = np.stack([gram[first] >> wide * (size - 1 - i) & (1 << wide) - 1 for i in range(size)], axis=1)
        whole = letters[at.ravel()].astype(np.uint32).tobytes().decode("utf-32-le")
        yield [whole[i:i + size] for i in range(0, len(whole), size)], np.diff(first, append=len(key)), key & (1 << deep) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in windows.parts(batch, 2 * windows.TOGETHER):
                for grams, sizes, rows in held(own):
                    ids = part.column(1).take(pa.array(rows))
                    upto = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams, pa.string()), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(upto, ids)], names=out.names)

    return source.mapInArrow(run, out)


def _class(size: int) -> int:
    """Terms are looked for by their first characters, a power of two, and then as a whole."""
    return 1 << size.bit_length() - 1


def _term_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of terms, the hash of their first characters and of the whole."""
    kept: dict = {}
    for batch in batches:
        for _, terms in windows.parts(batch):
            units, ends = windows.units_of(terms)
            own = windows.Windows(units, kept)
            starts = np.r_[0, ends[:-1]]
            out = []
            for size in set(map(len, terms)) - {0}:
                rows = np.flatnonzero(ends - starts == size)
                out += [own.of(starts[rows], starts[rows] + _class(size), 0), own.of(starts[rows], ends[rows], size)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out or [np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])


def held_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, id) for the texts (id, text) that hold a term of the list, once for a text."""
    sizes = sorted(r.n for r in terms.select(F.length("term").alias("n")).distinct().collect())
    hashes = terms.select("term").mapInArrow(_term_hashes, "h long")
    shared = texts.sparkSession.sparkContext.broadcast((windows.bit_table(hashes, 2 * terms.count()), sizes))
    source = texts.select(F.make_valid_utf8("text"), "id")
    out = T.StructType([T.StructField("term", T.StringType()), source.schema["id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, sizes), kept = shared.value, {}
        for batch in batches:
            for part, own_texts in windows.parts(batch):
                units, ends = windows.units_of(own_texts)
                own = windows.Windows(units, kept)
                row = np.repeat(np.arange(len(own_texts)), np.diff(ends, prepend=0))
                found = []
                for short in sorted({_class(n) for n in sizes}):
                    begins = windows.known(bits, own.all(short, 0)) if short <= len(units) else np.zeros(0, np.int64)
                    for n in (n for n in sizes if _class(n) == short):
                        at = begins[begins + n <= ends[row[begins]]]
                        at = at[windows.known(bits, own.of(at, at + n, n))]
                        found.append(np.stack([row[at], at, at + n]))
                if not sum(f.shape[1] for f in found):
                    continue
                rows, a, b = np.concatenate(found, axis=1)
                once = pa.table({"row": pa.array(rows), "term": pa.array(windows.as_text(units, a, b), pa.string())}).group_by(
                    ["row", "term"], use_threads=False).aggregate([]).combine_chunks()
                ids = part.column(1).take(once.column("row").combine_chunks())
                yield pa.RecordBatch.from_arrays([once.column("term").combine_chunks(), ids], names=out.names)

    # some windows have the bits of a term by chance
    return source.mapInArrow(run, out).join(terms.select("term"), "term", "left_semi")


class TrigramIndex:
    """Postings, counts and texts under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, texts: DataFrame, search: Column, key: str, folder: str | None = None) -> TrigramIndex:
        """Index ``search`` (in lower case; null is empty) of rows told apart by ``key``."""
        index = cls(texts.sparkSession, folder or new_folder(texts.sparkSession, "trigrams"))
        rows = texts.select(F.col(key).alias("id"), F.coalesce(search, F.lit("")).alias("text"))
        index._write(rows, "texts")
        # dealt by (trigram, first id), so a trigram that most texts have is many files
        each = pieces(index.texts(), 3).withColumn("first", F.get("ids", F.lit(0)))
        index._write(each.repartitionByRange("gram", "first").sortWithinPartitions("gram", "first").drop("first"), "postings")
        index._write(index._read("postings").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
        return index

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def texts(self) -> DataFrame:
        return self._read("texts")

    def postings(self) -> DataFrame:
        """A row for each (trigram, id), in order of trigram."""
        return self._read("postings").select(F.explode("ids").alias("id"), "gram")

    def search(self, term: str) -> DataFrame:
        """The ids of the texts that hold a term, all for an empty one.  The trigram is
        looked up first, so only its stretch of the postings is read."""
        term = term.strip().lower()
        found = self.texts().where(F.contains("text", F.lit(term))) if term else self.texts()
        if len(term) < 3:
            return found.select("id")
        own = [term[i:i + 3] for i in range(len(term) - 2)]
        known = {r.gram: r.n for r in self._read("counts").where(F.col("gram").isin(own)).collect()}
        rarest = min(own, key=lambda g: (known.get(g, 0), g))
        ids = self.postings().where(F.col("gram") == rarest).select("id")
        return found.join(ids, "id", "left_semi").select("id")

    def search_all(self, terms: DataFrame, term: str = "term") -> DataFrame:
        """(term, id) for every text that holds a term, for a table of terms at once.

        Terms too short for a trigram are looked for in every text; there are few
        different ones, at most the pairs of characters."""
        wanted = written(terms.select(term_of(F.col(term)).alias("term")).where("term <> ''").distinct(), "terms")
        found = self._long(wanted.where(F.length("term") >= 3))
        short = wanted.where(F.length("term") < 3).select("term")
        if short.isEmpty():
            return found
        # a text's own characters and pairs of them are what short terms can be
        own = pieces(self.texts(), 1).unionByName(pieces(self.texts(), 2)).withColumnRenamed("gram", "term")
        return found.unionByName(own.join(short, "term", "left_semi").select("term", F.explode("ids").alias("id")))

    def _long(self, wanted: DataFrame) -> DataFrame:
        """(term, id) for terms that have a trigram; a null id is not found."""
        grams_of = wanted.select("term", F.explode(grams(F.col("term"))).alias("gram"))
        rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")
        rarest = grams_of.join(self._read("counts"), "gram", "left").groupBy("term").agg(F.min(rank).alias("at"))
        # a term with a trigram that no text has is not found
        filed = written(rarest.select("term", "at.gram", "at.n").where("n > 0"), "filed-terms")
        own = filed.select("gram", "n").distinct()
        texts, reach = self.texts().where("id IS NOT NULL"), own.agg(F.sum("n")).first()[0] or 0
        if reach < texts.count():
            texts = texts.join(self.postings().join(own, "gram", "left_semi").select("id").distinct(), "id", "left_semi")
        found = held_terms(texts, filed.select("term"))
        # texts that share an id meet in every pair of them, as its postings do
        shared = self.texts().groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 AND id IS NOT NULL").select("id")
        shared = written(shared, "shared-ids")
        if shared.isEmpty():
            return found
        found = written(found, "found")
        pairs = found.join(shared, "id", "left_semi").join(filed.select("term", "gram"), "term")
        return found.join(shared, "id", "left_anti").select("term", "id").unionByName(
            pairs.join(self.postings(), ["gram", "id"]).select("term", "id"))
