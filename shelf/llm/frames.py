r"""Token ids in binary files of independent zstandard frames.

A file holds one frame for each document: its ids as little-endian unsigned 32-bit
numbers, with the frame's own checksum.  Behind them stand two skippable frames: a
directory of the documents' ids, and the seek table of the public seekable format
(sizes of all frames before and after compression and a checksum of each content).  A
plain zstandard decoder reads a file as the ids of all its documents; a reader that
knows the table goes straight to the documents it wants and decompresses no other.

    frame ... frame | 184D2A50 size directory | 184D2A5E size entries count 80 8F92EAB1

``spark.read.format("token_frames")`` and ``df.write.format("token_frames")`` are
available after :func:`register`.  A task writes files of its own; the files of the
tasks that Spark accepts are listed in ``_manifest.json``, in order, with the number of
ids before each, when the job commits.  What a lost or repeated task wrote is in no
manifest and is never read.

Defined cases: null texts are empty, a document of the end id only; rows are in order
of (doc_id, hash of the text), null ids first, and rows that repeat an id are documents
each; an empty table gives files without frames and reads back as no rows; other
columns are not read.  A frame whose checksum fails ends the read with an error.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from shelf.llm.common import map_texts, text_of
from shelf.llm.tokens import tokenizer_path

# fixed values of the public seekable format
SEEKABLE, SKIPPABLE, DIRECTORY, WITH_CHECKSUMS = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50, 0x80
FOOTER = "<IBI"
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
#: A file is closed at this size, or with so many documents (28 bytes each in memory).
FILE_BYTES, FILE_DOCUMENTS = 128 << 20, 1_000_000
#: Ids that a reader hands on at once; one document may have more.
BATCH_BYTES = 4 << 20
MANIFEST = "_manifest.json"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pyarrow.fs.LocalFileSystem(), path)


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FileWriter:
    """One file: frames as they come, then directory and seek table."""

    def __init__(self, folder: str, name: str):
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        self.name, self.out = name, fs.open_output_stream(f"{root}/{name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.entries, self.ids, self.bytes, self.tokens = [], [], 0, 0

    def _write(self, data: bytes, size: int, checksum: int) -> None:
        self.out.write(data)
        self.entries.append((len(data), size, checksum))
        self.bytes += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self._write(self.pack.compress(ids), len(ids), _checksum(ids))
        self.ids.append(doc_id)
        self.tokens += len(ids) // 4

    def close(self) -> dict:
        known = np.array([i is not None for i in self.ids], np.uint8).tobytes()
        packed = self.pack.compress(known + np.array([i or 0 for i in self.ids], "<i8").tobytes())
        self._write(struct.pack("<II", DIRECTORY, len(packed)) + packed, 0, _checksum(b""))
        entries = np.array(self.entries, ENTRY).tobytes()
        footer = struct.pack(FOOTER, len(self.entries), WITH_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        return {"file": self.name, "documents": len(self.ids), "tokens": self.tokens}


class FileReader:
    """One file: its table first, then the frames that are asked for."""

    def __init__(self, folder: str, name: str):
        fs, root = _open(folder)
        self.name, self.file = name, fs.open_input_file(f"{root}/{name}")
        end = self.file.size() - struct.calcsize(FOOTER)
        count, flags, magic = struct.unpack(FOOTER, self._at(end, struct.calcsize(FOOTER)))
        table = end - count * ENTRY.itemsize
        if magic != SEEKABLE or flags != WITH_CHECKSUMS or table < 8:
            raise ValueError(f"{name} has no seek table")
        self.entries = np.frombuffer(self._at(table, count * ENTRY.itemsize), ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        if self.offsets[-1] != table - 8:
            raise ValueError(f"the seek table of {name} does not fit its frames")
        self.unpack = zstandard.ZstdDecompressor()
        directory = self.unpack.decompress(self._at(int(self.offsets[-2]) + 8, int(self.entries["packed"][-1]) - 8))
        n = count - 1
        known = np.frombuffer(directory, np.uint8, n).astype(bool)
        self.ids = [i if k else None for i, k in zip(np.frombuffer(directory, "<i8", n, n).tolist(), known.tolist(), strict=True)]
        self.tokens = self.entries["size"][:-1].astype(np.int64) // 4

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def frame(self, number: int, data: bytes | None = None) -> bytes:
        """The ids of one document; no other frame is read."""
        packed, size, checksum = (int(x) for x in self.entries[number])
        data = self._at(int(self.offsets[number]), packed) if data is None else data
        try:
            ids = self.unpack.decompress(data, max_output_size=size)
        except zstandard.ZstdError as error:
            raise ValueError(f"frame {number} of {self.name} is damaged: {error}") from None
        if len(ids) != size or _checksum(ids) != checksum:
            raise ValueError(f"frame {number} of {self.name} is damaged")
        return ids

    def frames(self) -> Iterator[bytes]:
        """All documents in order, read in stretches of several frames."""
        number, last = 0, len(self.ids)
        while number < last:
            upto = max(number + 1, int(np.searchsorted(self.offsets, self.offsets[number] + BATCH_BYTES, side="right")) - 1)
            upto, base = min(upto, last), int(self.offsets[number])
            stretch = self._at(base, int(self.offsets[upto]) - base)
            for i in range(number, upto):
                yield self.frame(i, stretch[int(self.offsets[i]) - base:int(self.offsets[i + 1]) - base])
            number = upto


@dataclass
class Written(WriterCommitMessage):
    partition: int
    files: list[dict]


@dataclass
class OneFile(InputPartition):
    file: str
    start: int


class FramesWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        number, attempt, done, out = TaskContext.get().partitionId(), uuid.uuid4().hex, [], None
        for batch in iterator:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is not None and (out.bytes > FILE_BYTES or len(out.ids) >= FILE_DOCUMENTS):
                    done.append(out.close())
                    out = None
                out = out or FileWriter(self.folder, f"part-{number:06d}-{len(done):04d}-{attempt}.zst")
                out.add(doc_id, ids or b"")
        if out is not None:
            done.append(out.close())
        return Written(number, done)

    def commit(self, messages: list) -> None:
        files, start = [], 0
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for file in message.files:
                files.append(file | {"start": start})
                start += file["tokens"]
        fs, root = _open(self.folder)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = _open(self.folder)
        for message in messages:
            for file in message.files if message is not None else ():
                fs.delete_file(f"{root}/{file['file']}")


class FramesReader(DataSourceReader):
    def __init__(self, folder: str, directory: bool):
        self.folder, self.directory = folder, directory

    def partitions(self) -> list[OneFile]:
        fs, root = _open(self.folder)
        with fs.open_input_file(f"{root}/{MANIFEST}") as file:
            return [OneFile(x["file"], x["start"]) for x in json.loads(file.read())]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if not hasattr(partition, "file"):  # no files at all: Spark asks for one empty partition
            return
        reader = FileReader(self.folder, partition.file)
        starts = partition.start + np.concatenate([[0], np.cumsum(reader.tokens)])
        if self.directory:
            for low in range(0, len(reader.ids), 65_536):
                n = len(reader.ids[low:low + 65_536])
                yield pa.RecordBatch.from_arrays([
                    pa.array(reader.ids[low:low + n], type=pa.int64()), pa.array(starts[low:low + n]), pa.array(reader.tokens[low:low + n]),
                    pa.array([partition.file] * n), pa.array(np.arange(low, low + n))], names=["doc_id", "start", "n_tokens", "file", "frame"])
            return
        low, held, size = 0, [], 0
        for number, ids in enumerate(reader.frames()):
            held.append(ids)
            size += len(ids)
            if size >= BATCH_BYTES or number + 1 == len(reader.ids):
                n = len(held)
                yield pa.RecordBatch.from_arrays([
                    pa.array(reader.ids[low:low + n], type=pa.int64()), pa.array(starts[low:low + n]),
                    pa.array(reader.tokens[low:low + n]), pa.array(held, type=pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                low, held, size = low + n, [], 0


class TokenFrames(DataSource):
    """Options: ``path``; ``directory`` to read where documents are instead of their ids."""

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def _directory(self) -> bool:
        return str(self.options.get("directory", "false")).lower() == "true"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, " + ("file string, frame long" if self._directory() else "ids binary")

    def reader(self, schema) -> FramesReader:
        return FramesReader(self.options["path"].rstrip("/"), self._directory())

    def writer(self, schema, overwrite: bool) -> FramesWriter:
        return FramesWriter(self.options["path"].rstrip("/"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFrames)


def encoded(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row per document in the order of the files: doc_id and ``ids`` with the end id,
    as little-endian unsigned 32-bit numbers."""
    from shelf.llm.packing import encoder

    path = path or tokenizer_path()
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)

    def make():
        encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
        return lambda texts: [[encode(t).astype("<u4", copy=False).tobytes() + end for t in texts]]

    return map_texts(ordered, ("doc_id",), "ids binary", make)


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0) -> None:
    """Write the token ids of documents to ``folder``, in ascending order of doc_id."""
    register(docs.sparkSession)
    encoded(docs, path, end_id).write.format("token_frames").mode("append").save(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: doc_id, start (ids of all documents before it), n_tokens, ids."""
    register(spark)
    return spark.read.format("token_frames").load(folder)


def read_documents(wanted: DataFrame, folder: str) -> DataFrame:
    """The documents whose doc_id is in ``wanted``, as :func:`read_tokens` gives them.
    Only the tables of the files and the frames of these documents are read."""
    spark = wanted.sparkSession
    register(spark)
    where = spark.read.format("token_frames").option("directory", "true").load(folder)
    # frames of one file are dealt by thousands, so that a file is no limit to parallel reads
    found = where.join(wanted.select("doc_id"), "doc_id", "left_semi").withColumn("part", F.expr("frame div 1000"))
    found = found.repartition("file", "part").sortWithinPartitions("file", "frame").select("doc_id", "start", "n_tokens", "file", "frame")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = []
                for file, frame in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    if reader is None or reader.name != file:
                        reader = FileReader(folder, file)
                    ids.append(reader.frame(frame))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(ids, type=pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return found.mapInArrow(fetch, "doc_id long, start long, n_tokens long, ids binary")
