"""Plans and calls whose number decides how a query grows."""

import pandas as pd
from pyspark.sql import types as T

from shelf.operators import phrases
from shelf.plans import registry, streams, texts  # noqa: F401
from shelf.streaming import expiring


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_refused_values_are_worked_out_once(spark, sf_dir):
    import shelf.plans.extraction  # noqa: F401

    plan = optimized(registry.QUERIES["refused_values"](spark, sf_dir))
    assert "Filter" not in plan.split("Generate")[1] and "Repartition" in plan


def test_phrases_are_made_once(spark):
    rows = spark.createDataFrame([("  a b ",), ("a b",), ("A",), ("",), (None,), ("c-d",)], "phrase string")
    found = phrases.phrase_words(rows)
    assert [(r.phrase, r.words) for r in found.collect()] == [("a b", ["a", "b"])]
    assert "RLIKE" not in "".join(line for line in optimized(found).split("\n") if "Filter" in line and "Generate" not in line)


def test_only_pieces_that_are_phrases_are_dealt_out(spark):
    # every word is filed, at every place, and still only what is in the list leaves its text
    listed = spark.range(2000).selectExpr("concat('w', id, ' w', (id * 7 + 1) % 2000, ' w', (id * 11 + 5) % 2000) AS phrase")
    rows = spark.range(50).selectExpr("id", "concat_ws(' ', transform(sequence(0, 1999), i -> concat('w', (i * 3 + id) % 2000))) AS text")
    rows = rows.union(spark.createDataFrame([(50, "w3 w22 w38, w3 w22 w38!"), (51, None)], "id long, text string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = phrases.phrase_hits(rows, listed, ["id"])
        assert [tuple(r) for r in found.collect()] == [(50, "w3 w22 w38")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = optimized(found)
    # words are not dealt out with their neighbours, and a filed table is read for the comparison only
    assert "posexplode" not in plan and plan.count("Join") == 1 and "MapInArrow" in plan
    plain = rows.selectExpr("id", "regexp_replace(coalesce(text, ''), '[^a-z0-9 ]', '') AS plain")
    table = phrases.filed(phrases.phrase_words(listed), plain.selectExpr("split(plain, ' ') AS words"))
    # of 100,000 words, each tried at up to three places
    assert phrases._pieces(plain, ["id"], table).count() < 1000


def test_hits_are_dealt_out_once(spark, sf_dir):
    plan = registry.QUERIES["phrase_dictionary"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(kind" in plan


def test_links_of_a_small_file_are_dealt_out(spark, sf_dir):
    assert registry.QUERIES["shop_slug_links"](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


class State:
    """State in memory that counts the calls on it."""

    def __init__(self):
        self.held, self.calls = {}, []

    def __getattr__(self, call):
        def run(*given):
            self.calls.append(call)
            if call in ("exists", "containsKey"):
                return (given[0] if given else "seen") in self.held
            if call in ("get", "getValue"):
                return self.held.get(given[0] if given else "seen")
            if call in ("update", "updateValue"):
                self.held[given[0] if len(given) > 1 else "seen"] = given[-1]
            if call == "clear":
                self.held.clear()
            return iter(list(self.held.items()) if call == "iterator" else [])
        return run


def test_owners_state_is_asked_once_per_key():
    class Handle(State):
        def __init__(self):
            super().__init__()
            self.getValueState, self.getMapState = (lambda *_: seen), (lambda *_: latest)

    seen, latest = State(), State()
    key = T.StructType([T.StructField("key", T.StringType())])
    state = T.StructType([T.StructField("ts", T.LongType()), T.StructField("deleted", T.BooleanType())])
    owner = expiring._processor("code", "key", ["ts", "deleted"], ["ts", "deleted"], "deleted", 100, key, state)
    owner.init(Handle())

    def write(*rows):
        latest.calls.clear()
        frame = pd.DataFrame(rows, columns=["code", "key", "ts", "deleted", "first_us", "last_us"])
        got = pd.concat(list(owner.handleInputRows((1,), iter([frame]), None)) or [pd.DataFrame()])
        return [tuple(r) for r in got.sort_values("key")[["key", "ts", "deleted", "expired"]].itertuples(index=False)]

    assert write((1, "a", 5, False, 10, 10), (1, "a", 7, False, 11, 11), (1, "b", 1, False, 12, 12)) == [("a", 7, False, False), ("b", 1, False, False)]
    assert latest.calls == ["updateValue"] * 2
    # an older change loses, a newer one wins
    assert write((1, "a", 6, False, 20, 20), (1, "b", 2, True, 21, 21)) == [("b", 2, True, False)]
    assert sorted(latest.calls) == ["getValue"] * 2 + ["updateValue"]
    # behind a gap the owner starts anew, also with what came before the gap in the same batch
    assert write((1, "c", 1, False, 30, 30), (1, "a", 1, False, 500, 500)) == [("a", 1, False, False), ("c", 1, True, True)]
    assert latest.held == {("a",): (1, False)}
