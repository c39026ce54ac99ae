"""State that expires, and the cool-down over spans, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelf.operators import cooldown
from shelf.session import new_folder
from shelf.streaming import base, expiring, spans

DAY = 86_400_000_000


def landed(spark, folder, steps, schema, follow):
    """Land each step's rows and follow the stream after each."""
    for i, rows in enumerate(steps):
        df = spark.createDataFrame(rows, schema)
        df.write.mode("append").parquet(f"{folder}/landing/step{i}")
        follow(base.landing(spark, f"{folder}/landing", df.schema))


def favourites(spark, steps):
    folder = new_folder(spark, "favourites-test")
    landed(spark, folder, steps, "code string, key string, ts long, deleted boolean, id long, day long",
           lambda stream: expiring.follow_favourites(
               stream.withColumn("written", F.timestamp_micros((F.col("day") + 20_000) * DAY)).drop("day"), "code", "key",
               ["ts", "deleted", "id"], "written", base.append_batches(f"{folder}/log"), f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/log")


def test_old_writes_expire(spark):
    log = favourites(spark, [
        [("a", "x", 1, False, 1, 0), ("b", "x", 1, False, 2, 0), ("d", "x", 9, False, 3, 0), (None, "x", 1, False, 9, 0)],
        [("b", "y", 2, False, 4, 300), ("c", "x", 1, False, 5, 300), ("c", "x", 2, True, 6, 300), (None, "y", None, False, 8, 300)],
        [("d", "x", 1, False, 7, 500), ("b", "x", 0, False, 10, 500)]])
    kept = {(r.code, r.key, r.id) for r in expiring.merged_favourites(log, ["code", "key"]).collect()}
    # 'a' wrote nothing for over a year; 'b' renewed both its keys, and its older write of x loses;
    # 'c' deleted its key; 'd' came back after a year and starts anew, whatever its clock says
    assert kept == {("b", "x", 2), ("b", "y", 4), ("d", "x", 7), (None, "x", 9), (None, "y", 8)}
    assert {(r.code, r.key) for r in log.where("expired").collect()} == {("a", "x")}


def test_a_gap_inside_one_batch(spark):
    log = favourites(spark, [[("a", "x", 9, False, 1, 0), ("a", "y", 1, False, 2, 400), ("b", "x", 1, False, 3, 400)]])
    assert {(r.code, r.key) for r in expiring.merged_favourites(log, ["code", "key"]).collect()} == {("a", "y"), ("b", "x")}


def test_busy_owner_is_reduced_before_the_shuffle():
    import pandas as pd

    combine = expiring._combiner(["code", "key"], ["ts"], ["code", "key", "ts"], 365 * DAY)
    rows = pd.DataFrame({"code": "a", "key": [str(i % 7) for i in range(30_000)], "ts": range(30_000), "first_us": 5, "last_us": 5})
    out = pd.concat(list(combine(iter([rows, rows.assign(first_us=3), rows.assign(last_us=9, code="b")]))))
    assert len(out) == 14 and set(out["ts"]) == set(range(29_993, 30_000))
    assert set(out[out["code"] == "a"]["first_us"]) == {3} and set(out[out["code"] == "b"]["last_us"]) == {9}


def chain(times, last, gap):
    for t in times:
        if t >= last + gap:
            last = t
    return last


@pytest.mark.parametrize("full", [False, True])
def test_step_functions(full):
    rng = random.Random(5)
    for _ in range(3000):
        gap, begin, n = rng.choice([1, 3, 7, 20, 50]), rng.randint(0, 5) * 100, rng.randint(0, 40)
        times = sorted(rng.randint(begin, begin + rng.choice([5, 60, 300, 900])) for _ in range(n))
        f, array, cuts = cooldown.FullFunction(gap) if full else cooldown.StepFunction(begin, gap), np.array(times, np.int64), sorted(rng.randint(0, n) for _ in range(3))
        for a, b in zip([0, *cuts], [*cuts, n]):
            if b > a:
                f.take(array[a:b])
        starts, lasts = f.steps()
        assert starts == sorted(starts)
        for last in [cooldown.NEVER, *[rng.randint(begin - 60, begin + (900 if full else -1)) for _ in range(6)]]:
            at = int(np.searchsorted(np.asarray(starts, np.int64), last + gap))
            assert (lasts[at] if at < len(starts) else last) == chain(times, last, gap)


def test_cooldown_over_spans(spark):
    rng, gap = random.Random(1), 60
    steps = [[(rng.choice(["hot"] * 9 + [None, "a"]), rng.randint(low, high) * 1_000_000, 1000 * i + n) for n in range(400)]
             for i, (low, high) in enumerate([(0, 20_000), (15_000, 30_000), (10_000, 21_000), (30_000, 31_000)])]
    folder = new_folder(spark, "cooldown-test")
    landed(spark, folder, steps, "who string, t long, id long", lambda stream: spans.follow_cooldown(
        stream, "who", "t", "id", base.append_batches(f"{folder}/kept"), folder, gap, 8))
    want = set()
    for who in ("hot", None, "a"):
        last = cooldown.NEVER
        for rows in steps:
            for t, i in sorted((t, i) for w, t, i in rows if w == who):
                if t >= last + gap * 1_000_000:
                    want.add((who, i))
                    last = t
    assert {(r.who, r.id) for r in spark.read.parquet(f"{folder}/kept").collect()} == want
