"""Near copies against all pairs, and tiling against planted passages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from shelf.llm import minhash, tiling


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t))
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, both in Counter(j for g in s for j in where[g] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def edited(words, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() > share else f"new{seed}x{k}" for k, w in enumerate(words))


@pytest.fixture(scope="module")
def rows(documents):
    base = [f"w{i * 37 % 900}" for i in range(400)]
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    rows += [(5000 + i, edited(base, i, 0.012)) for i in range(60)]  # a group whose links are at the limit
    rows += [(6001, None), (6002, ""), (6003, " \t\n"), (6004, "one two"), (6005, "ONE  two"), (6006, "one two three"),
             (6007, "a b c d e f g h"), (6008, "a b c d e f g h"), (6009, "A b c d e f g h i")]
    return rows


@pytest.mark.parametrize("tile", [None, 7])
def test_components(docs_of, rows, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(minhash, "TILE", tile)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_components(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_deduplicate(docs_of):
    docs = docs_of([(4, "a b c d e f"), (2, "a b c d e f"), (7, None), (8, None), (None, "lone words")])
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["2", "7", "8", "None"]


def test_empty(docs_of):
    assert minhash.near_components(docs_of([])).count() == 0


def test_estimate():
    r = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.85, 1.0):
        off = []
        for _ in range(60):
            both = r.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, (4000 - len(both)) // 2, dtype=np.uint64)])) for _ in "ab")
            value, _ = minhash.estimate(minhash.registers(a), minhash.registers(b), np.array([len(a)]), np.array([len(b)]))
            off.append(float(value[0]) - share)
        assert abs(np.mean(off)) < 0.015


@pytest.mark.parametrize("size, limit", [(9, 0.85), (60, 0.85), (400, 0.85), (400, 0.8), (6000, 0.85)])
def test_sketches_lose_no_link(size, limit):
    r = np.random.default_rng(size)
    for bits in (minhash.FIRST_BITS, minhash.BITS):
        for _ in range(100):
            both = r.integers(0, 1 << 63, int(np.ceil(size * limit)), dtype=np.uint64)
            rest = r.integers(0, 1 << 63, size - len(both), dtype=np.uint64)
            cut = r.integers(0, len(rest) + 1)
            sets = [np.concatenate([both, x]) for x in (rest[:cut], rest[cut:])]
            sketches = np.array([np.frombuffer(minhash.sketch(minhash.registers(s)), np.uint64).reshape(-1, 8)[:bits] for s in sets])
            n = np.array([len(s) for s in sets])
            found, held = minhash._tile_pairs(np.zeros(2, int), sketches, n, np.arange(2), np.array([7, 5]), limit * n.min() / n.max(), True)
            assert found == {(5, 7)} and not len(held)


def test_tiles_hold_back_for_a_forest():
    own = np.array([np.frombuffer(minhash.sketch(minhash.registers(np.arange(1, 400, dtype=np.uint64))), np.uint64).reshape(-1, 8)] * 9)
    args = np.array([0] * 2 + [1] * 7), own, np.full(9, 399), np.array([1, 1, 1, 1, 5, 6, 7, 8, 9]), np.arange(9), 0.85
    found, held = minhash._tile_pairs(*args, False)
    assert len(found) == 5 and held.tolist() == [1]
    found, held = minhash._tile_pairs(*args, True)
    assert len(found) == 20 and not len(held)


def test_rows_of_a_large_group(spark, monkeypatch):
    """Members of one large component come once, and the few others once in each block."""
    monkeypatch.setattr(minhash, "TILE", 10)
    count = {}
    for n in (200, 800):
        members = spark.range(n).selectExpr("1L AS bucket", f"{n}L AS size", "0L AS hub", "id AS rep")
        labels = spark.range(n).selectExpr("id AS node", "if(id < 4, id, 4L) AS component")
        assert minhash._tiles(members, None).count() == n
        tiles = minhash._tiles(members, labels).collect()
        count[n] = len(tiles)
        where = {}
        for t in tiles:
            where.setdefault(t.rep, set()).add(t.tile)
        assert all(where[a] & where[b] for a in range(4) for b in range(n))
    assert count == {200: 196 + 4 * 20, 800: 796 + 4 * 80}


def test_tiles():
    w = tiling.words
    item = w("a b c d e f g h i j")
    assert tiling.tiles(item, w("x a b c d e y f g h i j"), 5) == [(0, 1, 5), (5, 7, 5)]
    assert tiling.tiles(item, w("f g h i j, A B c d E"), 5) == [(0, 5, 5), (5, 0, 5)]
    assert tiling.tiles(item, w("a b c d x e f g h"), 5) == []
    assert tiling.tiles(w("a a a a a a"), w("a a a a a a a a a"), 5) == [(0, 0, 6)]


def greedy(item, doc, least):
    """Greedy tiling by looking at every pair of places for the longest match."""
    free_i, free_d, covered = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        n, i, d = best[0], -best[1], -best[2]
        if n < least:
            return covered
        for k in range(n):
            free_i[i + k] = free_d[d + k] = False
        covered += n


def test_tiles_against_brute_force():
    r = random.Random(3)
    for _ in range(150):
        item = [r.choice("abcd") for _ in range(r.randint(3, 14))]
        doc = [r.choice("abcd") for _ in range(r.randint(0, 25))]
        got = tiling.tiles(tiling.words(" ".join(item)), tiling.words(" ".join(doc)), 3)
        assert all(item[i:i + n] == doc[d:d + n] for i, d, n in got)
        assert sum(n for *_, n in got) == greedy(item, doc, 3)


def test_contamination(spark, docs_of, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = sorted(bench.collect())
    a, b = items[0].text.split(), items[1].text.split()
    cut = len(a) // 2
    docs = docs_of([(1, "before. " + " ".join(a[cut:] + a[:cut]) + " after"), (2, " ".join(b).upper()), (3, None), (4, ""),
                    (5, " ".join(a[:len(a) // 3])), (2, "nothing"), (None, " ".join(b))])
    got = {(r.doc_id, r.item_id) for r in tiling.contaminated_pairs(docs, bench).collect()}
    assert got == {(1, items[0].item_id), (2, items[1].item_id)}
    kept = tiling.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == ["3", "4", "5", "None"]
    assert tiling.contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert tiling.contaminated_pairs(docs_of([]), bench).count() == 0
