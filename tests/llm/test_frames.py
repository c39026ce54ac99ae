"""Token files: exact round trip, the public layout, damage, point look-ups."""

import glob
import json
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from shelf.llm import frames, tokens
from shelf.session import new_folder

ODD = [(5, "five " * 4000), (1, None), (-3, ""), (None, "no id"), (7, "x <|endoftext|> y"), (2, "é中\U0001f600"), (2, "again"), (2, "again")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [0]


@pytest.fixture
def folder(spark, docs_of, documents, monkeypatch):
    monkeypatch.setattr(frames, "FILE_DOCUMENTS", 60)
    folder = new_folder(spark, "frames-test")
    docs = docs_of(ODD).select("doc_id", "text").union(documents.select("doc_id", "text").where("doc_id > 7"))
    frames.write_tokens(docs.repartition(5), folder)
    return folder


def test_round_trip(spark, documents, library, folder):
    rows = frames.read_tokens(spark, folder).orderBy("start").collect()
    texts = ODD + [(r.doc_id, r.text) for r in documents.where("doc_id > 7").collect()]
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    start = 0
    for r in rows:
        assert (r.start, r.n_tokens * 4) == (start, len(r.ids))
        start += r.n_tokens
    got = sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in rows)
    assert got == sorted((str(i), zlib.crc32(np.array(ids_of(library, t), "<u4").tobytes())) for i, t in texts)


def test_a_plain_decoder_reads_the_files(spark, folder):
    with open(f"{folder}/{frames.MANIFEST}") as file:
        names = [x["file"] for x in json.load(file)]
    assert len(names) > 1
    whole = b""
    for name in names:
        with open(f"{folder}/{name}", "rb") as file:
            whole += zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert whole == b"".join(r.ids for r in frames.read_tokens(spark, folder).orderBy("start").collect())


def test_only_wanted_documents_are_read(spark, library, folder):
    wanted = spark.createDataFrame([(2,), (9,), (123456,)], "doc_id long")
    got = frames.read_documents(wanted, folder).collect()
    assert sorted(r.doc_id for r in got) == [2, 2, 2, 9]
    assert {zlib.crc32(r.ids) for r in got if r.doc_id == 2} == {
        zlib.crc32(np.array(ids_of(library, t), "<u4").tobytes()) for i, t in ODD if i == 2}
    # the first frame of each file is damaged; other documents are still read
    first = {r.file: r for r in spark.read.format("token_frames").option("directory", "true").load(folder).where("frame = 0").collect()}
    for name in first:
        with open(f"{folder}/{name}", "r+b") as file:
            file.seek(6)
            byte = file.read(1)
            file.seek(6)
            file.write(bytes([byte[0] ^ 255]))
    other = spark.read.format("token_frames").option("directory", "true").load(folder).where("frame = 1").select("doc_id").limit(1)
    keep = other.first().doc_id
    if keep not in {r.doc_id for r in first.values()}:
        assert frames.read_documents(other, folder).count() >= 1
    with pytest.raises(Exception, match="damaged"):
        frames.read_tokens(spark, folder).collect()


def test_files_are_closed_at_their_size(spark, docs_of, monkeypatch, tmp_path):
    monkeypatch.setattr(frames, "FILE_DOCUMENTS", 3)
    frames.write_tokens(docs_of([(i, f"text {i}") for i in range(20)]).coalesce(1), str(tmp_path / "out"))
    assert len(glob.glob(str(tmp_path / "out" / "*.zst"))) >= 7
    rows = frames.read_tokens(spark, str(tmp_path / "out")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(20))


def test_files_of_other_attempts_are_not_read(spark, docs_of, tmp_path):
    folder = str(tmp_path / "out")
    frames.write_tokens(docs_of([(1, "a"), (2, "b")]), folder)
    lost = frames.FileWriter(folder, "part-000000-0000-lost.zst")
    lost.add(99, b"\0\0\0\0")
    lost.close()
    assert {r.doc_id for r in frames.read_tokens(spark, folder).collect()} == {1, 2}


def test_empty(spark, docs_of):
    folder = new_folder(spark, "frames-test")
    frames.write_tokens(docs_of([]), folder)
    assert frames.read_tokens(spark, folder).count() == 0
    assert frames.read_documents(spark.createDataFrame([(1,)], "doc_id long"), folder).count() == 0
