"""Windows of many texts that can be in a long list, found before anything is shuffled.

A window is hashed from sums that are made once for a text, whatever its length.  What the
list holds is kept as bits in a table of bounded size, two for each hash, that every task
has.  A window without both bits is not in the list; one that has them still has to be
compared with the list, as a few get there by chance.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# functions that run in tasks are shipped by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts are looked at together up to so many characters.
TOGETHER = 1 << 20
#: Least and most bits of a table, as powers of two: 32 MB however long the list is.
#: A longer one lets more windows through to the comparison, never fewer.
LEAST, MOST = 20, 28
#: Bits in a row of the table as Spark puts it together.
_ROW = 32768

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    def of(base: int) -> np.ndarray:
        out = np.full(n + 1, base, _U)
        out[0] = 1
        return np.cumprod(out, dtype=_U)

    return of(_BASE), of(_INVERSE)


class Windows:
    """Hashes of the windows of one run of characters."""

    def __init__(self, units: np.ndarray, kept: dict):
        n = len(units)
        if len(kept.get("powers", ((),))[0]) <= n:
            kept["powers"] = powers(max(n, TOGETHER))
        up, self.down = kept["powers"]
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(mix(units.astype(_U) + _U(_BASE)) * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + _U(salt * _BASE % (1 << 64)))

    def all(self, size: int, salt: int) -> np.ndarray:
        """The windows of one size, from every character on."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + _U(salt * _BASE % (1 << 64)))


def known(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes that have both bits."""
    last = _U(8 * len(table) - 1)

    def has(at: np.ndarray) -> np.ndarray:
        return (table[(at >> _U(3)).view(np.int64)] >> (at & _U(7)).astype(np.uint8)) & np.uint8(1) != 0

    places = np.flatnonzero(has(hashes & last))
    return places[has((hashes[places] >> _U(32)) & last)]


def bit_table(hashes: DataFrame, n: int) -> np.ndarray:
    """The table of ``n`` hashes (column h, long), put together by the tasks."""
    size = 1 << min(max((8 * n).bit_length() + 1, LEAST), MOST)
    spots = hashes.select(F.explode(F.array(
        F.col("h").bitwiseAND(size - 1), F.shiftrightunsigned("h", 32).bitwiseAND(size - 1))).alias("at"))
    rows = spots.select((F.col("at") + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    table = np.zeros(size // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = (row.row - 1) * _ROW // 8
        table[at:at + _ROW // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return table


def parts(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Stretches of a batch with the texts of its first column, of about ``most`` characters."""
    at, held, texts = 0, 0, []
    for i, text in enumerate(batch.column(0)):
        texts.append(text.as_py() or "")
        held += len(texts[-1]) + 1
        if held >= most:
            yield batch.slice(at, i + 1 - at), texts
            at, held, texts = i + 1, 0, []
    if texts:
        yield batch.slice(at), texts


def units_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of the texts in one run, and where each text ends."""
    units = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return units, np.cumsum([len(t) for t in texts], dtype=np.int64)


def as_text(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """Windows as strings."""
    sizes = ends - starts
    upto = np.cumsum(sizes)
    places = np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)
    whole = units[places].astype(np.uint32).tobytes().decode("utf-32-le")
    return [whole[a:b] for a, b in zip((upto - sizes).tolist(), upto.tolist(), strict=True)]
