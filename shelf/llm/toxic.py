"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel compares two units of text by their common subsequences of four
characters, each weighted down with the gaps in it, so inserted, doubled or dropped
characters cost little.  A unit is a run of non-blanks in lower case with all but its
letters taken out, and also a run of single letters put together ("i d i o t"); the
edges of a unit count as characters.  Sentences are labelled through their documents:
units that stand in toxic documents far more often than chance are the positive
examples, units of clean documents the negative ones.  Nystroem landmarks (positive
units and hard negative ones) span the feature space of a squared-hinge machine.  As
its kernel is a plain product, the machine folds into one weight per subsequence, of
which all tasks get a table of fixed size.  A document is scored from its three
highest units by a logistic function fitted on labelled documents.

The fit reads at most ``MAX_LABELLED`` labelled documents, chosen by a hash of their
id, and of near copies among them one; everything else covers all rows.

Defined cases: null and empty texts have no unit and get the score of a document with
the lowest margins; texts of any length are scored whole, units over 24 letters by
overlapping windows; labels that are null are not learned from; without labelled rows
of both kinds all scores are 0.5 if no label is known, else the share of label 1;
repeated rows are scored alike; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.common import Workspace, filter_texts, map_texts
from shelf.llm.minhash import mix, shingle_set

MAX_LABELLED = 16_000
#: Length and widest reach of a subsequence, weight of each gap, bits of the table.
LENGTH, REACH, DECAY, BITS = 4, 6, 0.6, 18
WINDOW = 24
MAX_POSITIVE, MAX_NEGATIVE, LANDMARKS, MINING = 1_000, 6_000, 320, 3
#: The score from which a document counts as toxic.
TOXIC = 0.3
CACHED = 300_000
_PATTERNS = [(0, *p) for p in itertools.combinations(range(1, REACH + 1), LENGTH - 1)]


def units(text: str) -> set[str]:
    words = text.lower().split()
    found = set(words)
    single = [i for i, w in enumerate(words) if len(w) == 1]
    for _, run in itertools.groupby(enumerate(single), lambda x: x[1] - x[0]):
        own = [words[i] for _, i in run]
        if len(own) >= 3:
            found.add("".join(own))
    return found


def letters(unit: str) -> str:
    return unit if unit.isalpha() else "".join(filter(str.isalpha, unit))


def _coded(words: list[str]) -> np.ndarray:
    """Words of one length as rows of 6-bit codes, with an edge on either side."""
    n = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), n)
    code = np.where((points >= 97) & (points <= 122), points - 96, 27 + (points * np.uint32(2654435761) >> np.uint32(16)) % 35)
    out = np.empty((len(words), n + 2), np.uint32)
    out[:, 1:-1], out[:, 0], out[:, -1] = code, 62, 63
    return out


def _norm(n: int) -> float:
    """Length of a unit's vector if its subsequences were all different."""
    total = sum((n + 2 - p[-1]) * DECAY ** (2 * (p[-1] + 1 - LENGTH)) for p in _PATTERNS if p[-1] < n + 2)
    return total ** 0.5 if total else 1.0


def _features(coded: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Table places of the subsequences, by pattern of gaps, and their weight."""
    width = coded.shape[1]
    for p in _PATTERNS:
        if (m := width - p[-1]) > 0:
            place = coded[:, :m]
            for at in p[1:]:
                place = (place << np.uint32(6)) | coded[:, at:at + m]
            yield (place * np.uint32(2654435761)) >> np.uint32(32 - BITS), DECAY ** (p[-1] + 1 - LENGTH)


def _windows(word: str) -> list[str]:
    return [word] if len(word) <= WINDOW else [word[i:i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def margins(found: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for each unit: the table folded over its subsequences."""
    out = np.full(len(found), -np.inf)
    by_length: dict[int, tuple[list[str], list[int]]] = {}
    for i, unit in enumerate(found):
        if word := letters(unit):
            for w in _windows(word):
                own = by_length.setdefault(len(w), ([], []))
                own[0].append(w)
                own[1].append(i)
    for n, (words, at) in by_length.items():
        for k in range(0, len(words), 20_000):
            coded = _coded(words[k:k + 20_000])
            value = np.zeros(len(coded), np.float32)
            for place, weight in _features(coded):
                value += np.float32(weight) * table[place].sum(axis=1)
            np.maximum.at(out, np.array(at[k:k + 20_000]), value / _norm(n) + bias)
    return out


@dataclass
class Model:
    table: np.ndarray
    bias: float
    logistic: np.ndarray  # of 1 and the three highest margins
    lowest: float


def _sparse(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for w in words:
        places, weights = zip(*((p[0], np.full(p.shape[1], v)) for p, v in _features(_coded([w]))), strict=True)
        out.append((np.concatenate(places), np.concatenate(weights) / _norm(len(w))))
    return out


def train_machine(words: list[str], label: np.ndarray, weight: np.ndarray, marks: list[str]) -> tuple[np.ndarray, float]:
    """A squared-hinge machine on Nystroem features, folded into a table."""
    vectors = _sparse(marks)
    used = np.unique(np.concatenate([p for p, _ in vectors]))
    basis = np.zeros((len(used) + 1, len(marks)), np.float32)  # the last row: subsequences of no landmark
    for j, (p, v) in enumerate(vectors):
        np.add.at(basis[:, j], np.searchsorted(used, p), v)
    where = np.full(1 << BITS, len(used), np.int32)
    where[used] = np.arange(len(used))

    def kernel(pairs):
        return np.array([v.astype(np.float32) @ basis[where[p]] for p, v in pairs])

    values, vectors_ = np.linalg.eigh(kernel(vectors).astype(np.float64))
    keep = values > 1e-4 * values[-1]
    half = vectors_[:, keep] / np.sqrt(values[keep])
    x = np.hstack([kernel(_sparse(words)) @ half, np.ones((len(words), 1))])
    y, w, ridge = 2.0 * label - 1, np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.02), 1e-6]
    for _ in range(25):
        active = y * (x @ w) < 1
        xa, sa = x[active], weight[active]
        new = np.linalg.solve((xa * sa[:, None]).T @ xa + np.diag(ridge), (xa * sa[:, None]).T @ y[active])
        done = np.allclose(new, w, atol=1e-6)
        w = new
        if done:
            break
    table = np.zeros(1 << BITS, np.float32)
    table[used] = basis[:-1] @ (half @ w[:-1])
    return table, float(w[-1])


def _variants(word: str) -> list[str]:
    """The word with a letter put in, doubled and taken out, at places the word sets."""
    at = 1 + sum(map(ord, word)) % (len(word) - 1)
    return [f"{word[:at]}{x}{word[at:]}" for x in ("x", word[at - 1])] + [word[:at] + word[at + 1:]] * (len(word) > 4)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * s[:, None]).T @ x + np.eye(x.shape[1]) * 0.1, x.T @ (y - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _highest(values: list[float], lowest: float) -> list[float]:
    top = sorted(values, reverse=True)[:3]
    return [min(max(v, lowest), 2.0) for v in top] + [lowest] * (3 - len(top))


def _bounded(labelled: DataFrame, n: int) -> DataFrame:
    """At most about ``n`` rows, chosen by a hash of their id."""
    total = labelled.count()
    return labelled if total <= n else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(n / total * (1 << 30)))


def _without_copies(work: Workspace, sample: DataFrame) -> DataFrame:
    """Of documents that share one of four minima over hashed shingles
    only the first: copies of one toxic document must not make all its words stand
    out."""
    def minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                h = shingle_set(text or "")
                rows.append([int(mix(h + np.uint64(i)).min() >> np.uint64(1)) if len(h) else -1 for i in range(4)])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "minima": pd.Series(rows, dtype=object)})

    rows = sample.select("doc_id", "text").mapInPandas(minima, "doc_id long, minima array<long>")
    each = work.write(rows.select("doc_id", F.posexplode("minima").alias("i", "h")), "minima")
    firsts = each.groupBy("i", "h").agg(F.min("doc_id").alias("first"))
    copies = each.join(firsts, ["i", "h"]).where("first < doc_id").select("doc_id").distinct()
    return sample.join(copies, "doc_id", "left_anti")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with a toxicity label, as :func:`fit` takes them."""
    own = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return docs.select("doc_id", "text").join(own, "doc_id")


def fit(labelled: DataFrame) -> Model:
    """Learn from rows (doc_id, text, label)."""
    spark = labelled.sparkSession
    work = Workspace(spark, "toxic")
    sample = work.write(_bounded(labelled.where("label IS NOT NULL"), MAX_LABELLED), "sample")
    sample = work.write(_without_copies(work, sample), "distinct")
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        share = 0.5 if not n else n_toxic / n
        return Model(np.zeros(1 << BITS, np.float32), -1.0, np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0, 0, 0]), -1.0)

    def each_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, y) for text, y in zip(batch["text"], batch["label"], strict=True)
                    for w in {letters(u) for u in units(text or "")} if 3 <= len(w) <= WINDOW]
            yield pd.DataFrame({"word": pd.Series([r[0] for r in rows], dtype=object), "label": [r[1] for r in rows]})

    counts = sample.select("text", F.col("label").cast("int")).mapInPandas(each_unit, "word string, label int")
    stats = work.write(counts.groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("c")), "words")
    n_words = max(1, stats.where("a >= 3").count())
    share = n_toxic / n
    # how unlikely as many toxic documents are by chance, for all words tried
    often = F.col("a") * np.log(share) + F.col("c") * np.log(1 - share) + F.expr("a + c") * np.log(2) + np.log(n_words)
    lift = (F.col("a") / n_toxic) / ((F.col("c") + 0.5) / (n - n_toxic))
    strong = (often < np.log(0.5)) & (lift > 10)
    positive = [r.word for r in stats.where(strong & (F.col("a") >= 3)).orderBy(F.desc("a"), "word").limit(MAX_POSITIVE).collect()]
    clean = stats.where((F.col("c") > 0) & (lift < 2))
    by_hash = clean.orderBy(F.xxhash64("word")).limit(MAX_NEGATIVE)
    negative = [r.word for r in by_hash.collect()] + [r.word for r in clean.orderBy(F.desc("c"), "word").limit(500).collect()]
    negative = list(dict.fromkeys(negative))
    if not positive or not negative:
        return Model(np.zeros(1 << BITS, np.float32), -1.0, np.array([np.log(share / (1 - share)), 0, 0, 0]), -1.0)
    hard: list[str] = []
    table, bias = np.zeros(1 << BITS, np.float32), 0.0
    for round_ in range(MINING + 1):
        rest = [w for w in negative if w not in set(hard)]
        varied = [v for w in positive for v in _variants(w)]
        words = positive + varied + hard + rest
        label = np.r_[np.ones(len(positive) + len(varied)), np.zeros(len(hard) + len(rest))]
        weight = np.where(label == 1, 0.5 * len(words) / len(positive), 1.0)
        weight[len(positive):len(positive) + len(varied)] *= 0.1
        marks = list(dict.fromkeys(positive[:LANDMARKS // 2] + hard[-LANDMARKS // 2:] + rest[:LANDMARKS]))[:LANDMARKS]
        table, bias = train_machine(words, label, weight, marks)
        if round_ < MINING:
            shared = spark.sparkContext.broadcast((table, bias))

            def scored(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    value = margins(list(batch["word"]), *shared.value)
                    yield pd.DataFrame({"word": batch["word"], "value": value})[value > -1]

            found = clean.select("word").mapInPandas(scored, "word string, value double")
            hard = list(dict.fromkeys(hard + [r.word for r in found.orderBy(F.desc("value"), "word").limit(800).collect()]))
    lowest = -1.5
    highest = _scorer(spark.sparkContext.broadcast((table, bias, lowest)))

    def tops():
        each = highest()
        return lambda texts: [each(texts)]

    top = map_texts(sample.select("text", F.col("label").cast("int")), ("label",), "top array<double>", tops)
    rows = np.array([[r.label, *r.top] for r in top.collect()], np.float64)
    work.drop()
    return Model(table, bias, _logistic(rows[:, 1:], rows[:, 0]), lowest)


def _scorer(shared):
    """A function that gives the three highest margins of each of many texts."""
    def make():
        table, bias, lowest = shared.value
        known: dict[str, float] = {}

        def top(texts: list[str]) -> list[list[float]]:
            found = [units(t) for t in texts]
            new = list(set().union(*found).difference(known))
            if len(known) + len(new) > CACHED:
                known.clear()
                new = list(set().union(*found))
            known.update(zip(new, margins(new, table, bias).tolist(), strict=True))
            return [_highest([v for v in map(known.__getitem__, u) if v > lowest], lowest) for u in found]

        return top
    return make


def _probability(top: list[list[float]], logistic: np.ndarray) -> np.ndarray:
    x = np.array(top, np.float64).reshape(-1, 3)
    return 1 / (1 + np.exp(-np.clip(logistic[0] + x @ logistic[1:], -30, 30)))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns ``keep`` with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.lowest))
    top, logistic = _scorer(shared), model.logistic

    def make():
        highest = top()
        return lambda texts: [_probability(highest(texts), logistic)]

    scored = map_texts(docs, keep, "score double", make)
    return scored.withColumn("predicted", F.when(F.col("score") >= TOXIC, 1).otherwise(0))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not toxic, with all their columns: all of them if the model has
    learned no unit, as without labels of both kinds."""
    if not model.table.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias, model.lowest))
    top, logistic = _scorer(shared), model.logistic

    def make():
        highest = top()
        return lambda texts: _probability(highest(texts), logistic) < TOXIC

    return filter_texts(docs, make)
