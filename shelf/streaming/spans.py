"""The cool-down as a stream whose busy keys are dealt over tasks.

As in the batch (``operators.cooldown``), a key's time line is cut into spans, and what
passes through the state are the spans' step functions, not the events:

1. a batch's events are written, and each span gives its function.  Only the newest
   span that earlier batches had of a key can hold the last accepted event, and of that one
   all events count;
2. the functions run as a stream of their own through a state of one number per key,
   which says for every span what was accepted last before it;
3. the spans are resolved, each by itself, with that number.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from shelf import vocabulary as V
from shelf.operators.cooldown import FUNCTION, NEVER, SPAN, functions_of, name_of, passed_on, resolved
from shelf.streaming.base import landing, rocksdb_state, run_available

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _carrier(gap: int):
    class Carrier(StatefulProcessor):
        """Holds one number per key, the time of the last accepted event."""

        def init(self, handle) -> None:
            self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType())]))

        def handleInputRows(self, key, rows, timerValues):
            # a row is a span, not an event
            spans = pd.concat(list(rows)).sort_values(["batch", "span"], kind="stable")
            before = last = self.last.get()[0] if self.last.exists() else NEVER
            out = []
            for batch, span, starts, lasts in zip(spans["batch"], spans["span"], spans["starts"], spans["lasts"], strict=True):
                out.append((key[0], int(batch), int(span), last))
                last = passed_on(last, gap, starts, lasts)
            if last != before:
                self.last.update((last,))
            yield pd.DataFrame(out, columns=["name", "batch", "span", "at"])

        def close(self) -> None:
            pass

    return Carrier()


def follow_cooldown(events: DataFrame, key: str, time: str, tie: str, on_batch, folder: str,
                    gap_seconds: int = V.COOLDOWN_SECONDS, span_gaps: int = 64) -> None:
    """Hand accepted events to ``on_batch``.  ``time`` is in microseconds, ``tie`` orders
    events of one time; events without a key are one key.  An event that comes after a
    later one was accepted is refused, as it would be live.  ``folder`` keeps the
    stream's state, and the events of each batch until its spans are resolved."""
    spark, gap = events.sparkSession, gap_seconds * 1_000_000
    span, columns = gap * span_gaps, events.columns

    def rows_of(number: int) -> DataFrame:
        return spark.read.parquet(f"{folder}/rows/batch={number}")

    def deal(batch: DataFrame, number: int) -> None:
        named = batch.withColumns({
            "name": name_of(key), "batch": F.lit(number).cast("long"),
            "span": F.floor(F.col(time) / F.lit(span)).cast("long"), "at": F.col(time).cast("long")})
        named.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        rows = rows_of(number).select("name", "batch", "span", "at", F.lit(False).alias("mark"))
        newest = rows.select("name", "span")
        if number > 0:
            before = spark.read.parquet(f"{folder}/newest/batch={number - 1}")
            newest = newest.unionByName(before)
            rows = rows.unionByName(before.select(
                "name", F.lit(number).cast("long").alias("batch"), "span", F.lit(0).cast("long").alias("at"), F.lit(True).alias("mark")))
        functions = functions_of(rows, gap, span)
        functions.write.mode("overwrite").parquet(f"{folder}/spans/batch={number}")
        newest.groupBy("name").agg(F.max("span").alias("span")).write.mode("overwrite").parquet(f"{folder}/newest/batch={number}")

    def resolve(before: DataFrame, _: int) -> None:
        before = before.persist()
        try:
            for number in sorted(r[0] for r in before.select("batch").distinct().collect()):
                kept = resolved(rows_of(number), before.where(F.col("batch") == number), gap, columns, events.schema, tie)
                on_batch(kept, number)
        finally:
            before.unpersist()

    run_available(events, deal, f"{folder}/checkpoint-rows")
    with rocksdb_state(spark):
        spans = landing(spark, f"{folder}/spans", FUNCTION)
        carried = spans.groupBy("name").transformWithStateInPandas(
            statefulProcessor=_carrier(gap), outputStructType=T.StructType.fromDDL(f"{SPAN}, at long"),
            outputMode="Append", timeMode="None")
        run_available(carried, resolve, f"{folder}/checkpoint-spans")
