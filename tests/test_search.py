"""Large phrase lists and the search index against plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from shelf.functions import rules
from shelf.operators import phrases, search

TEXTS = [(1, "A Drip-Bag of tea"), (2, "drip  bags, and a GIFT card"), (3, None), (4, ""), (5, "the the the tea the"), (6, "café de la paix"),
         (7, "of the"), (8, "hario v60 drip assist set"), (9, "teaset"), (10, "x of the y of the z"), (11, "&amp; tea &lt;b&gt;cup")]
PHRASES = ["drip bag", "tea", "gift card", "of the", "the the the", "the the tea", "hario v60 drip assist set", "Tea", "co-ferment", "", " de  la ",
           "caf de", "y of the z", "cup", "bags and a gift", None, "tea"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(*r, "p", 1) for r in TEXTS], "id int, text string, phrase string, n int")


def test_phrases_match_as_a_pattern_does(spark, texts):
    listed = spark.createDataFrame([(p,) for p in PHRASES], "phrase string")
    hits = {(r.id, r.phrase) for r in phrases.phrase_hits(texts, listed, ["id"]).collect()}
    normal = {r.id: r.m for r in texts.select("id", rules.match_text(F.col("text")).alias("m")).collect()}
    plain = {" ".join(p.split()) for p in PHRASES if p and re.fullmatch(r"[a-z0-9 ]+", p)}
    want = {(i, p) for i, m in normal.items() for p in plain if re.search(rf"\b{p}\b", m)}
    assert hits == want and len(want) > 12
    pattern = rules.phrase_pattern(sorted(plain))
    blocked = {r.id: r.blocked for r in phrases.with_blocked(texts, listed, ["id"]).collect()}
    assert blocked == {r.id: r.b for r in texts.select("id", rules.is_blocked(F.col("text"), pattern).alias("b")).collect()}


def test_a_long_list_costs_look_ups(spark, texts):
    many = spark.range(50_000).select(F.concat(F.lit("tea number "), F.col("id").cast("string")).alias("phrase"))
    hits = phrases.phrase_hits(texts, many.union(spark.createDataFrame([("tea",)], "phrase string")), ["id"])
    assert {r.id for r in hits.collect()} == {1, 5, 11}
    filed = phrases.filed(phrases.phrase_words(many), texts.select(F.split("text", " ").alias("words")))
    # under the number, which no text has, and never under 'tea'
    assert filed.where("word IN ('tea')").count() == 0


def test_empty_lists(spark, texts):
    none = spark.createDataFrame([], "phrase string")
    assert phrases.phrase_hits(texts, none, ["id"]).count() == 0
    assert phrases.phrase_hits(texts.limit(0), spark.createDataFrame([("tea",)], "phrase string"), ["id"]).count() == 0
    assert phrases.with_blocked(texts, none, ["id"], patterns=[r"\btea\b"]).where("blocked").count() == 3


def test_search_index(spark, texts):
    haystack = {i: (t or "").lower() for i, t in TEXTS}
    index = search.TrigramIndex.build(texts, F.lower("text"), "id")
    terms = ["tea", "  OF THE ", "e", "f t", "café", "é ", "zzz", "the the", "hario v60", "", "x of the y of the z", ".a", "　cup"]
    for term in terms:
        t = term.strip().lower()
        assert sorted(r.id for r in index.search(term).collect()) == sorted(i for i, h in haystack.items() if t in h), term
    found = index.search_all(spark.createDataFrame([(t,) for t in [*terms, None, "tea"]], "term string"))
    want = {(t.strip().lower(), i) for t in terms for i, h in haystack.items() if t.strip() and t.strip().lower() in h}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_postings_are_read_by_trigram(spark, texts):
    index = search.TrigramIndex.build(texts, F.lower("text"), "id")
    plan = index.search("hario v60")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram," in plan
    assert search.TrigramIndex.build(texts.limit(0), F.lower("text"), "id").search("tea").count() == 0


def test_many_terms_meet_a_text_once(spark):
    # a term for every text, all of them with trigrams that every text has
    rows = spark.range(300).selectExpr("id", "concat('abcabdabeabf', lpad(id, 4, '0'), 'cab dab eab fab') AS text")
    index = search.TrigramIndex.build(rows, F.col("text"), "id")
    stored = index._read("postings")
    assert stored.count() < index.postings().count() / 5
    assert {r.gram: r.n for r in index._read("counts").collect()} == {
        r.gram: r.n for r in index.postings().groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = index.search_all(rows.selectExpr("substr(text, 8, 12) AS term").union(rows.limit(1).selectExpr("'abcabd'")))
    folders = {f.split("/")[-2].rsplit("-", 1)[0] for f in found.inputFiles()}
    assert found.count() == 600 and "candidates" not in folders
    assert found.where("term <> 'abcabd'").select("term", "id").distinct().count() == 300
    # few texts have the rarest trigram of the only term, so only those are read
    assert [tuple(r) for r in index.search_all(spark.createDataFrame([("0007cab",)], "term string")).collect()] == [("0007cab", 7)]


def test_texts_that_share_an_id(spark):
    rows = spark.createDataFrame([(1, "one tea"), (1, "tea two"), (1, "x"), (2, "tea 𝒳𝒴𝒵 é"), (None, "tea")], "id int, text string")
    found = search.TrigramIndex.build(rows, F.col("text"), "id").search_all(
        spark.createDataFrame([("tea",), ("𝒳𝒴𝒵",), ("𝒴",), ("te",), ("no tea",)], "term string"))
    # as a join of postings with texts gives them; a null id meets nothing in one
    assert sorted((r.term, r.id or 0) for r in found.collect()) == sorted(
        [("tea", 1)] * 4 + [("tea", 2), ("𝒳𝒴𝒵", 2), ("𝒴", 2), ("te", 1), ("te", 1), ("te", 2), ("te", 0)])


def test_pieces_of_wide_alphabets(spark):
    texts = ["".join(chr(0x4E00 + (i * 7919 + k * 31) % 20000) for i in range(3000)) for k in range(40)] + ["", "ab"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for size in (1, 2, 3):
        got = {(r.gram, i) for r in search.pieces(rows, size).collect() for i in r.ids}
        assert got == {(t[j:j + size], k) for k, t in enumerate(texts) for j in range(len(t) - size + 1)}
