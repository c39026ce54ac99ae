"""Snapshot documents, one JSON file a snapshot, as a data source that opens only what is
wanted and deals a large document over tasks.

The names of a folder are listed first; they carry the time, so the newest ones, or
those of a pattern, are chosen before any file is opened.  A document is then dealt by
ranges of bytes: a task runs over the structure of the file up to the end of its range,
which takes a few array operations a block, and parses only the items that start in it.

Use ``spark.read.format("snapshot_documents")`` after :func:`register`, with ``path``
and, if wanted, ``names`` (a pattern), ``newest`` (so many of the last names) and
``range_bytes``.  Rows: snapshot, generated_at, ord, and the members of an item.  A
document without items, or one that ends too early, gives one row without an item;
elements of ``items`` that are no objects count in ``ord`` and are no rows.
"""

from __future__ import annotations

import fnmatch
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelf.schemas import ITEM_COLUMNS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAMES = "list_*.json"
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
BATCH_ROWS = 5000


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pyarrow.fs.LocalFileSystem(), path)


def _escaped(block: np.ndarray, carried: bool) -> tuple[np.ndarray, bool]:
    """Places that stand behind an odd number of backslashes, and whether the place behind
    the block does."""
    slashes = np.flatnonzero(block == 0x5C)
    if not len(slashes):
        return np.zeros(int(carried), np.int64), False
    first = np.flatnonzero(np.concatenate([[True], np.diff(slashes) != 1]))
    start, end = slashes[first], slashes[np.concatenate([first[1:], [len(slashes)]]) - 1] + 1
    number = end - start
    if carried and start[0] == 0:
        number[0] -= 1
    places = end[number % 2 == 1]
    if carried and start[0] != 0:
        places = np.concatenate([[0], places])
    return places[places < len(block)], bool(end[-1] == len(block) and number[-1] % 2 == 1)


class Structure:
    """The structure of a document, read a block at a time: (place, character, depth behind
    it) of what stands outside strings at depth 3 at most."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.depth, self.closed = 0, False

    def events(self) -> Iterator[tuple[int, int, int]]:
        inside, escaped = 0, False
        for base in range(0, self.size, BLOCK_BYTES):
            block = np.frombuffer(self.at(base, BLOCK_BYTES), np.uint8)
            quotes = block == 0x22
            places, escaped = _escaped(block, escaped)
            quotes[places] = False
            open_string = (np.cumsum(quotes) + inside) & 1
            inside = int(open_string[-1])
            marks = np.flatnonzero(np.isin(block, np.frombuffer(b"{}[],:", np.uint8)) & (open_string == 0))
            kinds = block[marks]
            step = np.isin(kinds, np.frombuffer(b"{[", np.uint8)).astype(np.int64) - np.isin(kinds, np.frombuffer(b"}]", np.uint8))
            depth = self.depth + np.cumsum(step)
            wanted = depth <= 3
            if len(depth):
                self.depth = int(depth[-1])
            yield from zip((marks[wanted] + base).tolist(), kinds[wanted].tolist(), depth[wanted].tolist(), strict=True)
        self.closed = self.depth == 0 and not inside

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(min(n, self.size - offset))

    def key_before(self, place: int, name: bytes) -> bool:
        """Whether the member that ``place`` belongs to has this name."""
        low = max(0, place - 256)
        return re.search(rb'"' + name + rb'"\s*:?\s*\Z', self.at(low, place - low)) is not None


def _generated_at(structure: Structure) -> str | None:
    """The document's own member of that name; it is looked for wherever it stands."""
    for place, kind, depth in structure.events():
        if kind == 0x3A and depth == 1 and structure.key_before(place, b"generated_at"):
            value = re.match(rb'\s*("(?:[^"\\]|\\.)*")', structure.at(place + 1, 1024))
            return json.loads(value[1]) if value else None
    return None


def items_of(file, size: int, low: int, high: int) -> Iterator[tuple[int, dict | None]]:
    """(ord, item) of the items that start in [low, high).  The first range also says,
    by one row without an item, if there are none or the document is cut off."""
    structure = Structure(file, size)
    inside, order, start, some = False, 0, None, False
    for place, kind, depth in structure.events():
        if kind == 0x5B and depth == 2 and structure.key_before(place, b"items"):
            inside, order = True, 0
        elif inside and kind == 0x5D and depth == 1:
            inside = False
        elif inside and kind == 0x2C and depth == 2:
            order += 1
        elif inside and kind == 0x7B and depth == 3:
            if place >= high and low:
                return
            start, some = place, True
        elif inside and kind == 0x7D and depth == 2:
            if low <= start < high:
                try:
                    yield order, json.loads(structure.at(start, place + 1 - start))
                except ValueError:
                    some = False
    if low == 0 and not (some and structure.closed):
        yield None, None


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


@dataclass
class Range(InputPartition):
    file: str
    low: int
    high: int


class DocumentsReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"].rstrip("/")
        self.names = options.get("names", NAMES)
        self.newest = int(options.get("newest", 0))
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        fs, root = _open(self.folder)
        files = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.is_file and fnmatch.fnmatch(f.base_name, self.names)]
        files.sort(key=lambda f: f.base_name, reverse=True)
        chosen = files[:self.newest] if self.newest else files
        return [Range(f.base_name, low, low + self.range_bytes) for f in chosen for low in range(0, max(f.size, 1), self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not hasattr(partition, "file"):  # no files at all: Spark asks for one empty partition
            return
        fs, root = _open(self.folder)
        with fs.open_input_file(f"{root}/{partition.file}") as file:
            size, rows = file.size(), []
            made = _generated_at(Structure(file, size))
            for order, item in items_of(file, size, partition.low, partition.high):
                rows.append((partition.file, made, order, *[_text((item or {}).get(c)) for c in ITEM_COLUMNS]))
                if len(rows) == BATCH_ROWS:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * len(ITEM_COLUMNS)]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
            names=["snapshot", "generated_at", "ord", *ITEM_COLUMNS])


class SnapshotDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshot_documents"

    def schema(self) -> str:
        return "snapshot string, generated_at string, ord int, " + ", ".join(f"{c} string" for c in ITEM_COLUMNS)

    def reader(self, schema) -> DocumentsReader:
        return DocumentsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotDocuments)


def read_documents(spark: SparkSession, folder: str, newest: int = 0, names: str = NAMES) -> DataFrame:
    """The items of the snapshot documents of a folder, or of the ``newest`` so many."""
    register(spark)
    return spark.read.format("snapshot_documents").option("newest", newest).option("names", names).load(folder)
