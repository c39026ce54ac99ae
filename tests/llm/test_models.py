"""Toxicity, language and language model by held-out figures and definitions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelf.llm import ctw, langid, toxic
from shelf.llm.common import fold

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxicity(spark, larger, docs_of):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxic.fit(toxic.labelled(larger.where(fold(larger, 4) != 2), labels))
    scored = toxic.score(larger, model, "doc_id").join(labels, "doc_id").join(larger.select("doc_id", "lang"), "doc_id")
    held = [r for r in scored.where(fold(scored, 4) == 2).collect() if r.lang == "en"]
    hits = sum(r.predicted for r in held if r.toxic)
    assert hits >= 0.7 * sum(r.toxic for r in held) and hits >= 0.9 * sum(r.predicted for r in held)
    odd = docs_of([(1, None), (2, ""), (3, "the th of " * 30), (4, "you are an i.d.i.o.t and a m o r o n, loser"), (5, "x" * 5000), (4, "scum moron idiot")])
    got = toxic.score(odd, model, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in got) and [r.predicted for r in got if r.doc_id == 4] == [1, 1]
    assert {r.predicted for r in got if r.doc_id in (1, 2, 3)} == {0}
    kept = toxic.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3} and 4 not in {r.doc_id for r in kept.collect()}
    assert next(r for r in kept.collect() if r.doc_id == 1).text is None


def test_kernel_machine_is_its_folded_table():
    words = ["idiot", "moron", "their", "those", "thing", "weather"]
    label = np.array([1, 1, 0, 0, 0, 0])
    table, bias = toxic.train_machine(words, label, np.ones(6), words)
    values = toxic.margins(words, table, bias)
    assert (values[:2] > 0.5).all() and (values[2:] < -0.5).all()
    gapped = toxic.margins(["i-d-i-o-t", "idiiot", "mor.on"], table, bias)
    assert (gapped > 0).all()


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, text string, label int")
    model = toxic.fit(none)
    assert [r.score for r in toxic.score(docs_of([(1, "a"), (2, None)]), model, "doc_id").collect()] == [0.5, 0.5]
    assert toxic.score(docs_of([]), model, "doc_id").count() == 0


def test_language(larger, docs_of):
    model = langid.fit(larger.where(fold(larger, 5) != 0))
    held = langid.predict(larger.where(fold(larger, 5) == 0), model, "doc_id", "lang", reject=0.0).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    odd = docs_of([(1, None), (2, ""), (3, "123 !?"), (4, "the of and is"), (5, "αβ"), (5, "αβ")])
    got = langid.predict(odd, model, "doc_id", reject=0.0).collect()
    assert [r.lang_pred for r in got if r.doc_id < 4] == ["und"] * 3
    assert {r.lang_pred for r in got if r.doc_id > 3} <= {"de", "en", "es", "fr"}
    assert [r.lang_pred for r in langid.predict(odd.where("doc_id = 5"), model, "doc_id").collect()] == ["und"] * 2
    nothing = langid.fit(larger.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, nothing, "doc_id").collect()} == {"und"}
    assert langid.predict(larger.limit(0), model, "doc_id").count() == 0


def counted(docs):
    words = re.compile(rb"[^\x20\x09-\x0D]+")
    return {i: words.findall((t or "").encode().lower()) + ["end"] for i, t in docs}


def test_language_model(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(10**6, None), (10**6 + 1, " \t"), (10**6 + 2, "THE ofÉ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = {r.doc_id: r for r in ctw.score_texts(docs, "held_out", slots=1 << 18).collect()}
    words = counted(rows)
    c = Counter(w for i, own in words.items() if i % 7 != 2 for w in own)
    n, v = sum(c.values()), len(c)
    for i, own in words.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        size = len((dict(rows)[i] or "").encode())
        assert r.n_bytes == size and (r.bits_per_byte is None if not size else math.isclose(r.bits_per_byte, -r.score * math.log2(10) / size))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    size = sum(len(t.encode()) + 1 for i, t in rows if t and i % 7 == 2)
    assert -sum(r.score for r in held) / size / math.log10(2) < 3.6


def naive_weighted(data, depth):
    """Log probability of all bytes by context-tree weighting, tree by tree."""
    nodes = {}
    for i, byte in enumerate(data):
        past = [ctw.START] * depth + list(data[:i])
        for k in range(8):
            for d in range(depth + 1):
                key = (d, tuple(past[len(past) - d:]), (byte | 256) >> (8 - k))
                nodes.setdefault(key, [0, 0])[(byte >> (7 - k)) & 1] += 1

    def weighted(key):
        d, past, bits = key
        ends = ctw.block_probability(*(np.array([float(x)]) for x in nodes[key]))[0]
        if d == depth:
            return ends
        below = sum(weighted(x) for x in nodes if x[0] == d + 1 and x[1][1:] == past and x[2] == bits)
        return float(np.logaddexp(ends, below) - math.log(2))

    return sum(weighted(k) for k in nodes if k[0] == 0)


def test_weights_against_naive_trees(monkeypatch):
    monkeypatch.setattr(ctw, "DEPTH", 3)
    text = "abracadabra abra cadabra"
    grams, n = np.unique(ctw.codes(text), return_counts=True)
    _, sums = ctw.weigh(grams, n, 1)
    total = 0.0
    for _, n0, n1, s in sums:
        total += float((np.logaddexp(ctw.block_probability(n0, n1), s) - math.log(2)).sum())
    raw = text.encode() + bytes([ctw.STOP])
    assert math.isclose(total, naive_weighted(raw, 3), rel_tol=1e-9)


def test_probabilities_sum_to_one(spark, documents):
    counts = ctw.count_corpus(documents)
    from shelf.llm.common import Workspace
    model = ctw.train(counts, Workspace(spark, "test"), slots=1 << 16)
    for context in ("the of", "zzzzzz", "ééé"):
        past = int.from_bytes((bytes([ctw.START]) * 6 + context.encode())[-6:], "big")
        grams = np.array([past << 8 | b for b in range(256)], np.uint64)
        assert abs((10 ** model.log10(grams)).sum() - 1) < 1e-3


def test_language_model_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert ctw.score_texts(docs, "held_out").count() == 0
    one = spark.createDataFrame([(2, "abc", True)], "doc_id long, text string, held_out boolean")
    row = ctw.score_texts(one, "held_out").first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0)
    assert math.isclose(row.score, 32 * math.log10(0.5), rel_tol=1e-3)


def test_folds(spark):
    docs = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 7 for r in docs.withColumn("f", fold(docs, 7)).collect())


def test_language_model_scores_with_all_that_was_counted(spark, documents):
    """Each score is that of the whole tree, however few grams a task may hold."""
    docs = documents.limit(300).select("doc_id", "text").withColumn("held_out", F.col("doc_id") % 7 == 2)
    rows = [(r.doc_id, r.text or "", r.held_out) for r in docs.collect()]
    fixed = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    grams, n = np.unique(np.concatenate([ctw.codes(t) for _, t, held in rows if not held]), return_counts=True)
    levels, _ = ctw.weigh(grams, n, 0)
    none = [(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))] * 8
    p = {}
    for at, (depth, keys, own, _) in enumerate(ctw.mixtures(levels, none)):
        p |= {(depth, at % 8, int(key)): x for key, x in zip(keys, own, strict=True)}

    def naive(text):
        total = 0.0
        for gram in ctw.codes(text).tolist():
            byte, context = gram & 255, gram >> 8 << 8
            for k in range(8):
                node = context | byte >> (8 - k) | 1 << k
                found = [x for d in range(7) if (x := p.get((d, k, node & ((1 << 8 * (d + 1)) - 1)))) is not None]
                one = found[-1] if found else 0.5
                total += math.log10(one if byte >> (7 - k) & 1 else 1 - one)
        return total

    wanted = {i: naive(t) for i, t, _ in rows}
    for slots in (1 << 12, 1 << 22):
        got = {r.doc_id: r.score for r in ctw.score_texts(fixed, "held_out", slots=slots).collect()}
        assert got.keys() == wanted.keys() and all(math.isclose(got[i], wanted[i], rel_tol=1e-9) for i in wanted)
