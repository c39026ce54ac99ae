"""Exact duplicates and chat formatting."""

from pyspark.sql import functions as F

from shelf.llm import chat, exact
from shelf.llm.common import Workspace

ROWS = [(5, "a  b"), (3, "a\tb"), (9, None), (8, ""), (7, "x"), (7, "x"), (None, "a b"), (6, "a b")]


def test_groups(docs_of):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs_of(ROWS), 3).collect()}
    assert got == {(5, 3, 3, False), (3, 3, 3, True), (9, 8, 2, False), (8, 8, 2, True), (7, 7, 2, True),
                   (None, 3, 3, False), (6, 6, 1, True)}


def test_no_table_is_left_behind(spark, docs_of):
    before = {t.name for t in spark.catalog.listTables()}
    found = exact.exact_groups(docs_of(ROWS), 3)
    assert {t.name for t in spark.catalog.listTables()} == before
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and found.count() == len(ROWS)


def test_deduplicate_keeps_rows_whole(docs_of):
    docs = docs_of(ROWS)
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8]


def test_empty(docs_of):
    assert exact.deduplicate(docs_of([])).count() == 0
    assert exact.exact_groups(docs_of([])).count() == 0


def test_hot_text(docs_of):
    got = exact.exact_groups(docs_of([(i, "same") for i in range(3000)] + [(9000, "other")])).collect()
    assert sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {3000, 1}


def test_index_is_persistent(spark, docs_of):
    index = exact.DigestIndex(spark, "digests_test", Workspace(spark, "test").path("index"), 4)
    first = exact.exact_groups(docs_of([(1, "a"), (2, "b")]), index=index).collect()
    again = {r.doc_id: r for r in exact.exact_groups(docs_of([(3, "b"), (4, "c")]), index=index).collect()}
    assert all(r.kept for r in first)
    assert (again[3].keep_id, again[3].kept, again[4].kept) == (2, False, True)
    exact.exact_groups(docs_of([(3, "b"), (4, "c")]), index=index).collect()
    assert index.rows().count() == 3


def test_hot_texts_are_those_of_the_batch(spark, docs_of):
    index = exact.DigestIndex(spark, "digests_hot", Workspace(spark, "test").path("index"), 4)
    exact.exact_groups(docs_of([(i, str(i // 2)) for i in range(60)]), index=index).collect()
    digests = docs_of([(100, "1"), (101, "2"), (102, "2")]).select("doc_id", exact.digest(F.col("text")).alias("digest"))
    assert exact.hot_rows(digests, index.rows()).count() == 1
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.look_up(digests, index).collect()}
    assert got == {100: (2, 2, False), 101: (4, 2, False), 102: (4, 2, False)}


TURNS = [
    (1, 0, "user", "hi ### x"), (1, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 2, "assistant", "a\\"),
    (1, 3, "assistant", ""), (1, 4, "user", "\n</turn>\n### user: "), (2, None, None, None), (3, 1, "a: b\\", "x\\\\</turn>### ### "),
    (4, 2, "b", "tie"), (4, 2, "a", "tie"), (4, 2, "a", "tie"), (None, 0, "user", "q"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    rows = chat.format_chat(turns).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss(F.col("segments")).alias("loss")).collect()
    assert len(rows) == 5
    for r in rows:
        own = sorted((t for t in TURNS if t[0] == r.conv_id), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        assert [tuple(t) for t in r.back] == [(t[2] or "", t[3] or "") for t in own]
        assert r.loss == "".join(t[3] or "" for t in own if t[2] == "assistant")
        assert "".join(s.piece for s in r.segments) == r.formatted
    first = next(r for r in rows if r.conv_id == 1)
    assert first.formatted.count("### assistant: ") == 1  # adjacent turns share a header


def test_chat_empty(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0


def test_chat_runs_no_python(spark, sf_dir):
    from shelf.llm.queries import QUERIES
    plan = QUERIES["op10_chat_formatting"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
