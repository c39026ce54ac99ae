"""Token counts against the library, packing by its invariants."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelf.llm import packing, tokens

ODD = [(1, None), (2, ""), (3, "a  b   c \n d\n e \n"), (4, " lead  "), (5, "x <|endoftext|> y"), (6, "  　x \x1c y\x85 z"),
       (7, "it's 'quoted' 12 3"), (8, "a\n b \nc"), (9, "é中\U0001f600 " * 50), (10, "word " * 3000), (3, "a  b   c \n d\n e \n")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path())


@pytest.mark.parametrize("table", [None, {}])
def test_counts(docs_of, documents, library, table):
    docs = docs_of(ODD).select("doc_id", "text").union(documents.select("doc_id", "text"))
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, table=table).collect())
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512)
                  for r in docs.collect())
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 1.'\n\t   és")), max_size=30))
def test_pieces_have_the_same_tokens_alone(text):
    library = Tokenizer.from_file(tokens.tokenizer_path()) if not hasattr(tokens, "_test") else tokens._test
    tokens._test = library
    cut = tokens.pieces(text, ())
    if cut is not None:
        ids = [i for p in cut for i in library.encode(tokens.whole(p), add_special_tokens=False).ids]
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers(docs_of):
    import sentencepiece
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs_of(ODD[:5]), path).collect()}
    assert got == {i: len(model.encode(t or "")) for i, t in ODD[:5]}


def test_pack(docs_of, documents, library):
    docs = docs_of(ODD[:10]).select("doc_id", "text").union(documents.select("doc_id", "text").where("doc_id > 10"))
    packed = packing.pack(docs, capacity=256, with_ids=True).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for doc_id, own in packed.sort_values("piece").groupby("doc_id"):
        ids = library.encode(texts[doc_id], add_special_tokens=False).ids + [0]
        assert list(own["length"]) == packing.cut_lengths(len(ids), 256)
        assert list(own["start"]) == [0, *np.cumsum(own["length"])[:-1]]
        assert [i for x in own["ids"] for i in x] == ids
        assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(own["ids"], own["ids_crc32"]))
    assert set(packed["doc_id"]) == set(texts)
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 256 and list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]]
    assert packed["sequence_id"].nunique() <= packing.lower_bound(packed["length"].to_numpy(), 256) * 1.02 + 1


def test_exchange_closes_gaps(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_A_TASK", 6)
    docs = docs_of([(i, "w " * (20 + i % 23)) for i in range(200)])
    packed = packing.pack(docs, capacity=64).toPandas()
    assert len(packed) == 200 and (packed.groupby("sequence_id")["length"].sum() <= 64).all()
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert list(own["offset"]) == [0, *np.cumsum(own["length"])[:-1]]


def test_sequences(docs_of):
    packed = packing.pack(docs_of(ODD[:10]), capacity=64, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert all(len(r.ids) <= 64 for r in rows) and sum(len(r.documents) for r in rows) == packed.count()


def test_empty(docs_of):
    assert packing.pack(docs_of([])).count() == 0
    assert tokens.count_tokens(docs_of([])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_best_fit(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)

    def least(rest, bins):
        if not rest:
            return len(bins)
        best = len(rest) + len(bins)
        for b in range(len(bins)):
            if bins[b] >= rest[0] and bins[b] not in bins[:b]:
                best = min(best, least(rest[1:], bins[:b] + [bins[b] - rest[0]] + bins[b + 1:]))
        return min(best, least(rest[1:], bins + [20 - rest[0]]))

    bins, _, room = packing.best_fit_decreasing(sizes, 20)
    assert packing.lower_bound(sizes, 20) <= least(sizes.tolist(), []) <= len(room)


@pytest.mark.parametrize("blank", [" ", "\n", "　", " \n"])
def test_very_long_runs_of_white_space(docs_of, library, blank):
    text = "a" + blank * 1_000_000 + "b"
    ids = library.encode(text, add_special_tokens=False).ids
    assert packing.encoder(tokens.tokenizer_path())(text).tolist() == ids
    packed = packing.pack(docs_of([(1, text), (2, "c")])).toPandas()
    assert packed[packed["doc_id"] == 1]["length"].sum() == len(ids) + 1
