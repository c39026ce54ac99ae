"""Periodic runs against every lag of every document."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelf.llm import runs
from shelf.llm.queries import _with_periods, QUERIES


def plain(words):
    """All runs by trying every lag; the smallest lag of a stretch is its period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def check(documents):
    for words, (got, text) in zip(documents, runs._search([[w.encode() for w in d] for d in documents]), strict=True):
        want = plain(words)
        assert got == want
        assert text.decode() == " ".join(collapsed(words, want))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_small_alphabets(documents):
    check(documents)


def test_repeated_and_broken_stretches():
    rng = random.Random(7)
    for _ in range(150):
        documents = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.choice([0, 1, 11, 12, 13, 40, 150, 300]), rng.choice([1, 2, 3, 50])
            words = [str(rng.randrange(letters)) for _ in range(n)]
            if n > 4 and rng.random() < 0.8:
                p = rng.randint(1, n // 2)
                words = (words[:p] * (n // p + 1))[:n]
                for _ in range(rng.choice([0, 0, 1, 3])):
                    words[rng.randrange(n)] = "x"
            documents.append((words + ["z"]) * rng.choice([1, 1, 1, 2, 4]))
        check(documents)


def test_runs_made_of_runs():
    base = [str(i) for i in range(24)]
    check([(base * 3 + ["x"] + base[5:] * 3) * 5, ["a"] * 700 + ["b"] + ["a"] * 700, (["a"] * 50 + ["b"]) * 9])
    a, b = ["a"], ["a", "b"]
    while len(b) < 1500:
        a, b = b, b + a
    check([b])


def test_very_repetitive_text_is_searched_quickly():
    assert runs._search([[b"w"] * 400_000])[0][0] == [(0, 400_000, 1)]
    words = [b"%d" % i for i in range(30_000)]
    assert runs._search([words * 7])[0][0] == [(0, 210_000, 30_000)]


def test_blocks(monkeypatch, docs_of):
    monkeypatch.setattr(runs, "BLOCK_WORDS", 30)
    docs = docs_of([(1, None), (2, ""), (3, "a b " * 20), (3, "a b " * 20), (None, " x\n" * 13), (4, "a b " * 12), (5, "a b c")])
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in runs.periodic_runs(docs, "doc_id", "row", "digest").collect()}
    assert got == {(1, ""): [], (2, ""): [], (3, "a b"): [(0, 40, 2)], (None, "x"): [(0, 13, 1)],
                   (4, "a b"): [(0, 12, 1)], (5, "a b c"): []}
    assert runs.periodic_runs(docs_of([])).count() == 0


def test_query(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    some = documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).limit(12).union(
        documents.where("length(text) < 3000").limit(30)).collect()
    for d in some:
        words, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = plain(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = rows[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest()


def test_stated_texts_of_odd_rows(docs_of):
    rows = [(i, t) for i in range(60) for t in (None, "", " \n", "one", "a b c d e f g h i j k")]
    assert _with_periods(docs_of(rows + [(None, "a b")])).count() == len(rows) + 1
