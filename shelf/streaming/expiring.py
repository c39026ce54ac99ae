"""Favourites as keyed state that forgets owners who stopped writing.

State is kept per owner: the latest change of every key, and when the owner last wrote.
A timer at that time plus the time to live is renewed by every write, whatever key it
is for; when it runs off, all keys of the owner leave the state and the log says so.
A write behind such a gap starts anew, even if the timer has not run yet.

Time is that of the write as the service received it, a column of the changes, so a
replay gives the same rows.  Which change of a key wins is decided by ``order`` alone.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from shelf import vocabulary as V
from shelf.operators.select import last_per_key
from shelf.streaming.base import rocksdb_state, run_available

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Different (owner, key) pairs that a task keeps while it reduces its rows.
COMBINED = 50_000


def _combiner(key: list[str], order: list[str], columns: list[str], ttl: int):
    """Reduce the changes of a task to one row per owner, key and stretch of time.

    Within one stretch of the time to live no gap can let the owner expire, so of a
    key's changes only the winner counts, and of their times the first and last."""
    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        by = [*key, "_stretch"]
        if len(rows) < 2:
            return rows
        winners = rows.sort_values([*by, *order], kind="stable", na_position="first").drop_duplicates(by, keep="last").set_index(by)
        times = rows.groupby(by, dropna=False, sort=False).agg(first_us=("first_us", "min"), last_us=("last_us", "max"))
        winners[["first_us", "last_us"]] = times.reindex(winners.index)[["first_us", "last_us"]]
        return winners.reset_index()[[*columns, "first_us", "last_us", "_stretch"]]

    def combine(batches):
        held, size = [], 0
        for batch in batches:
            batch["_stretch"] = batch["first_us"] // ttl
            held.append(batch)
            size += len(batch)
            if size > COMBINED:
                held = [reduce(pd.concat(held))]
                size = len(held[0])
                if size > COMBINED // 2:
                    yield held[0][[*columns, "first_us", "last_us"]]
                    held, size = [], 0
        if held:
            yield reduce(pd.concat(held))[[*columns, "first_us", "last_us"]]

    return combine


def _processor(owner: str, name: str, order: list[str], rest: list[str], deleted: str, ttl: int,
               key_type: T.StructType, state_type: T.StructType):
    names = [f.name for f in state_type.fields]

    def rank(row) -> tuple:
        """A change's place in the order, with null first."""
        return tuple((row[c] is not None, row[c]) if row[c] is not None else (False,) for c in order)

    class Favourites(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", T.StructType([T.StructField("at", T.LongType())]))
            self.latest = handle.getMapState("latest", key_type, state_type)

        def _expire(self, code) -> list[dict]:
            """Forget all keys of an owner; one row for each that was not deleted."""
            gone = []
            for k, state in self.latest.iterator():
                row = dict(zip(names, state))
                if not row[deleted]:
                    gone.append(row | {owner: code, name: k[0], deleted: True, "expired": True})
            self.latest.clear()
            self.seen.clear()
            self._stop_timers()
            return gone

        def _stop_timers(self) -> None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

        def _store(self, pending: dict) -> None:
            for k, state in pending.items():
                self.latest.updateValue(k, state)

        def _frame(self, rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=[owner, name, *names, "expired"])

        def handleInputRows(self, key, rows, timerValues):
            # reduced before the shuffle, so a document's keys bound them
            batch = pd.concat(list(rows)).sort_values(["first_us", *order], kind="stable")
            # every call on the state is a round trip: an owner without a time has no keys, and
            # of a key's changes only the last one is written
            code, changed, pending = key[0], {}, {}
            seen = self.seen.get()[0] if self.seen.exists() else None
            before, stored = seen, seen is not None
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                if seen is not None and row["first_us"] > seen + ttl:
                    self._store(pending)
                    changed |= {x[name]: x for x in self._expire(code)}
                    pending, stored = {}, False
                seen = max(row["last_us"], seen if seen is not None else row["last_us"])
                k, state = (row[name],), tuple(row[c] for c in names)
                held = pending.get(k) or (self.latest.getValue(k) if stored else None)
                if held is not None and rank(row) <= rank(dict(zip(names, held))):
                    continue
                pending[k] = state
                changed[row[name]] = {owner: code, name: row[name], **dict(zip(names, state)), "expired": False}
            self._store(pending)
            if seen != before:
                self.seen.update((seen,))
                if stored:
                    self._stop_timers()
                self.handle.registerTimer((seen + ttl) // 1000 + 1)
            if changed:
                yield self._frame(list(changed.values()))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            gone = self._expire(key[0])
            if gone:
                yield self._frame(gone)

        def close(self) -> None:
            pass

    return Favourites()


def follow_favourites(changes: DataFrame, owner: str, key: str, order: Sequence[str], written: str, on_batch,
                      checkpoint: str, deleted: str = "deleted", ttl_days: float = V.FAVOURITE_TTL_DAYS,
                      lateness: str = "1 day") -> None:
    """Hand every batch's changed keys to ``on_batch``: winners, deletions included, and
    keys that went because their owner expired (``deleted`` and ``expired`` are true).

    ``written`` is a timestamp, when the service took the write; one that comes more than
    ``lateness`` behind the newest is refused.  ``order`` ranks the changes of a key.
    A busy owner's changes are reduced in every task before they meet."""
    ttl = int(ttl_days * 86_400_000_000)
    columns = [c for c in changes.columns if c != written]
    rest = [c for c in columns if c not in (owner, key)]
    types = {f.name: f for f in changes.schema.fields}
    at = F.unix_micros(written)
    schema = T.StructType([types[c] for c in columns] + [T.StructField("first_us", T.LongType()), T.StructField("last_us", T.LongType())])
    reduced = changes.select(*columns, at.alias("first_us"), at.alias("last_us")).mapInPandas(
        _combiner([owner, key], list(order), columns, ttl), schema)
    # the event time of a reduced row is its last write
    reduced = reduced.withColumn(written, F.timestamp_micros("last_us")).withWatermark(written, lateness)
    state = T.StructType([types[c] for c in rest])
    out = T.StructType([types[owner], types[key], *state.fields, T.StructField("expired", T.BooleanType())])
    with rocksdb_state(changes.sparkSession):
        stream = reduced.groupBy(owner).transformWithStateInPandas(
            statefulProcessor=_processor(owner, key, list(order), rest, deleted, ttl, T.StructType([types[key]]), state),
            outputStructType=out, outputMode="Update", timeMode="EventTime")
        run_available(stream, on_batch, checkpoint, "update")


def merged_favourites(log: DataFrame, keys: Sequence[str], deleted: str = "deleted") -> DataFrame:
    """The state that the log of ``follow_favourites`` leads to: the last batch's row per
    key, deletions and expired keys left out.  The log is read once."""
    return last_per_key(log, keys, F.col("batch")).where(~F.col(deleted)).drop("batch", "expired", deleted)
