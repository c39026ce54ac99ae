"""Language by the nearest centroid of TF-IDF vectors of byte n-grams.

A text is put in lower case, and all but letters becomes a blank.  Its bigrams and
trigrams of bytes are counted in hashed places, damped, weighted by inverse document
frequency and brought to length one.  Each language has several centroids, found by
spherical k-means among its own documents.  A text gets the language of the centroid
with the highest cosine, or is rejected as ``und`` if that cosine is below a limit.

The fit reads at most ``MAX_PER_LANGUAGE`` documents of a language, chosen by a hash of
their id; prediction covers all rows and whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; equal
cosines go to the first language by name; rows without a language are not learned
from; with none learned all is ``und``; repeated rows are treated alike; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.llm.common import Workspace, map_texts

MAX_PER_LANGUAGE, CENTROIDS, ROUNDS = 1_200, 4, 12
PLACES = 4_096  # for bigrams, and as many for trigrams
#: Below this cosine a text is like no language learned.
REJECT = 0.05
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def _kept() -> np.ndarray:
    out = np.full(256, 32, np.uint32)
    out[97:123], out[128:] = np.arange(97, 123), np.arange(128, 256)
    return out


_BYTE = _kept()


def counts(text: str) -> np.ndarray:
    """Counts of the text's n-grams in their hashed places."""
    b = _BYTE[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    place = lambda x: (x * np.uint32(2654435761)) >> np.uint32(20)
    blank = np.uint32(0x2020)
    return np.concatenate([np.bincount(place(two[two != blank]), minlength=PLACES), np.bincount(place(three), minlength=PLACES)])


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(np.array([counts(t) for t in texts], np.float32).reshape(len(texts), 2 * PLACES)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, begun at the vectors farthest from those chosen."""
    chosen = [0]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    centre = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(axis=1)
        sums = np.array([x[own == j].sum(axis=0) if (own == j).any() else centre[j] for j in range(len(centre))])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centre


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Learn from rows (doc_id, text, lang): languages by centroid, centroids, idf."""
    spark = labelled.sparkSession
    work = Workspace(spark, "langid")
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return [], np.zeros((0, 2 * PLACES), np.float32), np.ones(2 * PLACES, np.float32)
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, MAX_PER_LANGUAGE / n)))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    sample = work.write(chosen, "sample")

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(2 * PLACES, np.int64)
        for batch in batches:
            for text in batch["text"]:
                total += counts(text) > 0
        yield pd.DataFrame({"place": np.arange(2 * PLACES), "n": total})[total > 0]

    n = sample.count()
    df = np.zeros(2 * PLACES)
    for r in sample.select("text").mapInPandas(frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        df[r.place] = r.n
    idf = (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)

    def centroids(key, part: pd.DataFrame) -> pd.DataFrame:
        found = _clusters(vectors(list(part.sort_values("doc_id")["text"]), idf), CENTROIDS)
        return pd.DataFrame({"lang": [key[0]] * len(found), "k": range(len(found)), "centre": pd.Series(list(found.astype(np.float64)), dtype=object)})

    # a group is a language's sample, of stated size
    rows = sample.groupBy("lang").applyInPandas(centroids, "lang string, k int, centre array<double>").orderBy("lang", "k").collect()
    work.drop()
    return [r.lang for r in rows], np.array([r.centre for r in rows], np.float32), idf


def predict(docs: DataFrame, model, *keep: str, reject: float = REJECT) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, the cosine."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def nearest():
        languages, centre, idf = shared.value

        def each(texts: list[str]) -> list:
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            spelt = [i for i, t in enumerate(texts) if languages and _LETTER.search(t)]
            if spelt:
                cosine = vectors([texts[i] for i in spelt], idf) @ centre.T
                for i, best, value in zip(spelt, cosine.argmax(axis=1), cosine.max(axis=1), strict=True):
                    if value >= reject:
                        lang[i], score[i] = languages[best], min(1.0, max(0.0, float(value)))
            return [lang, score]

        return each

    return map_texts(docs, keep, "lang_pred string, score double", nearest)
