"""Repeated strings against counting every string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelf.llm import repeats


def brute(rows, length=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[s:s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if counts[b[s:s + length]] > 1:
                gone[s:s + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows(documents):
    shared = words(0, 90)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(90001, "a" * 3000), (90002, None), (90003, "ab" * 700), (90004, "x" * 399), (90005, "q" * 400), (90006, "q" * 401),
             (None, "z" * 100), (90007, words(7, 300)), (90007, words(7, 300)), (90008, "")]
    rows += [(91000 + i, words(i + 1, 40) + shared + words(-i - 1, 40)) for i in range(12)]
    return rows


@pytest.mark.parametrize("block", [None, 3])
def test_against_brute_force(docs_of, rows, monkeypatch, block):
    if block:
        monkeypatch.setattr(repeats, "BLOCK", block)
        monkeypatch.setattr(repeats, "SHARD", 50)
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs_of(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_kept_text(docs_of):
    got = repeats.remove_repeats(docs_of([(1, "k" + "a" * 500), (2, "short")]), with_text=True).collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == {1: b"k", 2: b"short"}


def test_empty(docs_of):
    assert repeats.remove_repeats(docs_of([])).count() == 0


def test_index():
    rnd = random.Random(1)
    for _ in range(40):
        length = rnd.choice([3, 5, 12])
        base = bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(1, 60)))
        parts = []
        for _ in range(rnd.randint(1, 6)):
            i = rnd.randint(0, len(base))
            parts.append(bytes(rnd.choice(b"ab\x00") for _ in range(rnd.randint(0, 9))) + base[i:i + rnd.randint(1, 50)] + b"x")
        marked = repeats.RunIndex(parts).repeated(length).tolist()
        counts = Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
        assert marked == [i + length <= len(p) and counts[p[i:i + length]] > 1 for p in parts for i in range(len(p))]
