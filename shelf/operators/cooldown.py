"""The cool-down: an event is accepted only a while after the last accepted one.

The rule is a recurrence per key.  To keep a busy key out of one task, its time line is
cut into spans.  What a span does to a key is a step function from the last event accepted
before it to the last one accepted in it:

1. events are dealt by (key, span) and sorted; each span gives its function, for which only
   events within one cool-down of its start matter;
2. a pass over the functions in order of time gives what was accepted last before each
   span; rows stream through, one number is carried;
3. each span is then resolved by itself.

All passes hold a batch of rows at a time, however many a key or span has.  The stream form
is ``streaming.spans``.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelf import vocabulary as V
from shelf.operators.merge import micros

# the helpers used inside tasks travel with them, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NEVER = -(1 << 62)


class StepFunction:
    """From the last time accepted before a span to the last one accepted in it, built from
    the span's times as they come in order.

    Events of the span's first cool-down, and the one behind them, can be the first one
    accepted; those are the starts.  Each start leads a chain of accepted events.  Chains
    that meet go on as one and keep their order, so the starts of a chain are a range of
    all starts, which may run over the end to the beginning."""

    def __init__(self, begin: int, gap: int):
        self.end, self.gap = begin + gap, gap
        self.parts: list[np.ndarray] = []
        #: Chains that have accepted a second event: (last time, first start, last start).
        self.chains: deque[tuple[int, int, int]] | None = None

    def _close(self, time: int) -> None:
        """The first event behind the first cool-down: there are no more starts."""
        self.starts = np.unique(np.concatenate([*self.parts, [time]]))
        self.ahead = len(self.starts) - 1  # starts that are still alone, before the chains
        self.alone = int(np.searchsorted(self.starts[:-1], time - self.gap, side="right"))
        self.chains = deque([(time, self.ahead, (self.alone or self.ahead + 1) - 1)])

    def take(self, times: np.ndarray) -> None:
        at = 0
        if self.chains is None:
            at = int(np.searchsorted(times, self.end, side="left"))
            self.parts.append(times[:at])
            if at == len(times):
                return
            self._close(int(times[at]))
        while True:
            alone = self.alone < self.ahead
            due = (int(self.starts[self.alone]) if alone else self.chains[0][0]) + self.gap
            at += int(np.searchsorted(times[at:], due, side="left"))
            if at == len(times):
                return
            time, low, high = int(times[at]), None, None
            if alone:
                low = self.alone
                self.alone += int(np.searchsorted(self.starts[low:self.ahead], time - self.gap, side="right"))
                high = self.alone - 1
            while self.alone == self.ahead and self.chains and self.chains[0][0] + self.gap <= time:
                _, first, high = self.chains.popleft()
                low = first if low is None else low
            self.chains.append((time, low, high))

    def steps(self) -> tuple[list[int], list[int]]:
        """Rising times up to which a start has the same effect, and the last time
        accepted then.  A start behind all of them accepts nothing."""
        if self.chains is None:
            times = np.unique(np.concatenate([*self.parts, np.zeros(0, np.int64)])).tolist()
            return times, times
        end = len(self.starts) - 1
        ranges = [(i, int(self.starts[i])) for i in range(self.alone, self.ahead)]
        for last, low, high in self.chains:
            ranges.append((high, last))
            if low > high:  # the range runs over the end
                ranges.append((end, last))
        ranges.sort()
        return [int(self.starts[i]) for i, _ in ranges], [last for _, last in ranges]


class FullFunction:
    """The same for a span that may itself hold the last accepted event: all its events
    are starts.  Chains are followed for all of them at once, by doubling."""

    def __init__(self, gap: int):
        self.gap, self.parts = gap, [np.zeros(0, np.int64)]

    def take(self, times: np.ndarray) -> None:
        self.parts.append(times)

    def steps(self) -> tuple[list[int], list[int]]:
        times = np.unique(np.concatenate(self.parts))
        after = np.searchsorted(times, times + self.gap, side="left")
        chain = np.where(after < len(times), after, np.arange(len(times)))
        while not np.array_equal(further := chain[chain], chain):
            chain = further
        last = times[chain]
        change = np.concatenate([last[1:] != last[:-1], np.ones(min(1, len(last)), bool)])
        return times[change].tolist(), last[change].tolist()


#: A span of a key: ``name`` is the key as JSON, so that a missing key is one too.
SPAN = "name string, batch long, span long"
FUNCTION = f"{SPAN}, starts array<long>, lasts array<long>"


def name_of(key: str) -> Column:
    return F.to_json(F.struct(F.col(key).alias("k")))


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Stretches of one span in batches sorted by (name, batch, span): (span, is it new, rows)."""
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("name").dictionary_encode()
        keys = [names.indices.to_numpy(), batch.column("batch").to_numpy(), batch.column("span").to_numpy()]
        differs = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            differs |= k[1:] != k[:-1]
        starts = [0, *(np.flatnonzero(differs) + 1).tolist()]
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            values = (names.dictionary[int(keys[0][a])].as_py(), int(keys[1][a]), int(keys[2][a]))
            yield values, values != current, batch.slice(a, b - a)
            current = values


def _mark(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("mark").to_numpy(zero_copy_only=False)


def functions_of(rows: DataFrame, gap: int, span: int) -> DataFrame:
    """The step function of each span of ``rows`` (name, batch, span, at, mark).  A marked
    row says that its span may itself hold the last accepted event; it is none."""
    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), type=t) for c, t in zip(columns, types, strict=True)], names=["name", "batch", "span", "starts", "lasts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, step, values = [], None, None
        for own, new, some in _parts(batches):
            mark = _mark(some)
            if new:
                if step is not None:
                    done.append((*values, *step.steps()))
                values, step = own, FullFunction(gap) if mark[0] else StepFunction(own[2] * span, gap)
            step.take(some.column("at").to_numpy()[~mark])
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if step is not None:
            done.append((*values, *step.steps()))
        if done:
            yield batch_of(done)

    dealt = rows.select("name", "batch", "span", "at", "mark").repartition("name", "span")
    return dealt.sortWithinPartitions("name", "batch", "span", F.desc("mark"), "at").mapInArrow(run, FUNCTION).where(F.size("starts") > 0)


def passed_on(last: int, gap: int, starts: list[int], lasts: list[int]) -> int:
    """What is accepted last after a span, given what was before it."""
    at = int(np.searchsorted(np.asarray(starts, np.int64), last + gap, side="left"))
    return max(last, int(lasts[at])) if at < len(starts) else last


def resolved(rows: DataFrame, before: DataFrame, gap: int, columns: list[str], schema, tie: str) -> DataFrame:
    """The accepted events among ``rows`` (name, batch, span, at, and ``columns``), given what
    was accepted last before each span, ``before`` (name, batch, span, at)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = NEVER
        for _, new, some in _parts(batches):
            mark = _mark(some)
            if new:
                last = some.column("at")[0].as_py() if mark[0] else NEVER
            own = np.flatnonzero(~mark)
            times, kept, at = some.column("at").to_numpy()[own], [], 0
            while (at := at + int(np.searchsorted(times[at:], last + gap, side="left"))) < len(times):
                kept.append(at)
                last = int(times[at])
                at += 1
            if kept:
                yield some.select(columns).take(pa.array(own[kept]))

    marked = rows.withColumn("mark", F.lit(False)).unionByName(before.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    sort = ["name", "batch", "span", F.desc("mark"), "at", tie]
    return marked.repartition("name", "span").sortWithinPartitions(*sort).mapInArrow(run, schema)


def cooldown(events: DataFrame, key: str, ts: str, tie: str, gap_seconds: int = V.COOLDOWN_SECONDS,
             span_gaps: int = 64) -> DataFrame:
    """Events (key, tie) accepted under a cool-down that counts from the last accepted.
    Events without a key are one key; spans are ``span_gaps`` cool-downs long."""
    gap = gap_seconds * 1_000_000
    rows = events.select(
        key, tie, name_of(key).alias("name"), F.lit(0).cast("long").alias("batch"),
        micros(F.col(ts).cast("timestamp_ntz")).alias("at")).withColumn("span", F.floor(F.col("at") / F.lit(gap * span_gaps)).cast("long"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, NEVER
        for batch in batches:
            before = []
            for name, starts, lasts in zip(*(batch.column(c).to_pylist() for c in ("name", "starts", "lasts")), strict=True):
                if name != current:
                    current, last = name, NEVER
                before.append(last)
                last = passed_on(last, gap, starts, lasts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before, pa.int64())], names=["name", "batch", "span", "at"])

    functions = functions_of(rows.withColumn("mark", F.lit(False)), gap, gap * span_gaps)
    before = functions.repartition("name").sortWithinPartitions("name", "span").mapInArrow(carry, f"{SPAN}, at long")
    return resolved(rows, before, gap, [key, tie], events.select(key, tie).schema, tie)
