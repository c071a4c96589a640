"""Stateful ingest on ``transformWithState``: duplicate flags and links that late rows put right.

State of a subject, each part read and written by itself: its cases in chunks of one or
more spans of time (a map from a chunk's first span to its cases; a full chunk is cut in
two, so that calls to state don't grow with spans that hold few cases), the times of each
kind (a map from kind to times), and, for streams that never end, a timer. Chunks and times older than
``window + late`` before the newest case go, but for the newest case among them,
which later cases still link to.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Fixed value: days in which a repeat of a key is a duplicate.
DUPLICATE_DAYS = 30
#: spans that the kept time is cut into
SPANS = 64
#: cases of a chunk before it is cut in two between spans
CHUNK = 128

OUT = "event_id long, user_id long, event_type string, at long, base string, seen boolean, prior_id long"


class Cases:
    """The cases of a subject in order of (time, id), read from state as they are needed."""

    def __init__(self, state: Any, width: int):
        self.state, self.width = state, width
        self.begins = sorted(key[0] for key in state.keys())  # a chunk has the spans from its begin to the next one's
        self.stored = set(self.begins)
        self.read: dict[int, list[tuple]] = {}
        self.changed: set[int] = set()

    def place(self, at: int) -> int:
        return max(0, bisect_right(self.begins, at // self.width) - 1)

    def of(self, i: int) -> list[tuple]:
        """(at, event_id, kind, base, seen, prior_id) of a chunk, in order."""
        begin = self.begins[i]
        if begin not in self.read:
            self.read[begin] = [tuple(x) for x in self.state.getValue((begin,))[0]]
        return self.read[begin]

    def put(self, i: int, rows: list[tuple]) -> None:
        self.read[self.begins[i]] = rows
        self.changed.add(self.begins[i])

    def drop(self, i: int) -> None:
        begin = self.begins.pop(i)
        self.read.pop(begin, None)
        self.changed.discard(begin)

    def add(self, case: tuple) -> None:
        span = case[0] // self.width
        if not self.begins:
            self.begins.append(span)
            self.put(0, [case])
            return
        i = self.place(case[0])
        rows = self.of(i)
        if span < self.begins[i]:  # before all others: the first chunk begins here now
            self.drop(i)
            self.begins.insert(i, span)
        insort(rows, case, key=lambda c: (c[0], c[1]))
        self.put(i, rows)
        if len(rows) > CHUNK:
            span_of = lambda c: c[0] // self.width
            middle = span_of(rows[len(rows) // 2])
            cut = bisect_left(rows, middle, key=span_of) or bisect_right(rows, middle, key=span_of)
            if cut < len(rows):
                self.begins.insert(i + 1, span_of(rows[cut]))
                self.put(i + 1, rows[cut:])
                self.put(i, rows[:cut])

    def replace(self, old: tuple, new: tuple) -> None:
        i = self.place(old[0])
        rows = self.of(i)
        rows[rows.index(old)] = new
        self.put(i, rows)

    def neighbours(self, at: int, event_id: int) -> tuple[tuple | None, tuple | None]:
        """The cases just before and just after a place."""
        if not self.begins:
            return None, None
        i = self.place(at)
        rows = self.of(i)
        k = bisect_right(rows, (at, event_id), key=lambda c: (c[0], c[1]))
        before = rows[k - 1] if k else self.of(i - 1)[-1] if i else None
        after = rows[k] if k < len(rows) else self.of(i + 1)[0] if i + 1 < len(self.begins) else None
        return before, after

    def at_time(self, at: int, kind: str | None) -> list[tuple]:
        rows = self.of(self.place(at))
        return [c for c in rows[bisect_left(rows, at, key=lambda c: c[0]) : bisect_right(rows, at, key=lambda c: c[0])] if c[2] == kind]

    def at_place(self, at: int, event_id: int) -> list[tuple]:
        rows = self.of(self.place(at))
        key = lambda c: (c[0], c[1])
        return rows[bisect_left(rows, (at, event_id), key=key) : bisect_right(rows, (at, event_id), key=key)]

    def forget(self, before: int) -> None:
        """Drop cases older than a time; of these the newest stays. A chunk with newer ones is cut when it is written."""
        old = sum(begin * self.width <= before for begin in self.begins[1:])
        for _ in range(old - 1):
            self.drop(0)
        if old and len(self.of(0)) > 1:
            self.put(0, self.of(0)[-1:])
        elif not old and self.begins[0] in self.changed:
            rows = self.of(0)
            self.put(0, rows[max(0, bisect_left(rows, before, key=lambda c: c[0]) - 1) :])

    def save(self) -> None:
        for begin in sorted(self.stored.difference(self.begins)):
            self.state.removeKey((begin,))
        for begin in sorted(self.changed):
            self.state.updateValue((begin,), (self.read[begin],))


class Ingest(StatefulProcessor):
    def __init__(self, window: timedelta, late: timedelta, expire: bool):
        micros = timedelta(microseconds=1)
        self.window, self.keep, self.expire = window // micros, (window + late) // micros, expire
        self.width = max(1, self.keep // SPANS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cases = handle.getMapState("cases", "span long", "cases array<struct<at:long,event_id:long,kind:string,base:string,seen:boolean,prior_id:long>>")
        self.kinds = handle.getMapState("kinds", "kind string", "times array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        cases = Cases(self.cases, self.width)
        known_subject = bool(cases.begins)
        times: dict[str | None, list[int]] = {}
        out: dict[tuple, None] = {}  # places of new and changed cases

        def times_of(kind: str | None) -> list[int]:
            if kind not in times:
                stored = (kind or "",) if kind is not None else ("\0",)
                times[kind] = list(self.kinds.getValue(stored)[0]) if known_subject and self.kinds.containsKey(stored) else []
            return times[kind]

        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            at, kind = r["at"], r["event_type"]
            known = times_of(kind)
            k = bisect_left(known, at)
            seen = k > 0 and at - known[k - 1] <= self.window
            if k == len(known) or known[k] != at:
                known.insert(k, at)
                if k + 1 < len(known) and known[k + 1] - at <= self.window:  # the next time of the kind has now been preceded
                    for c in cases.at_time(known[k + 1], kind):
                        if not c[4]:
                            cases.replace(c, (*c[:4], True, c[5]))
                            out[c[:2]] = None
            before, after = cases.neighbours(at, r["event_id"])
            if after is not None:
                cases.replace(after, (*after[:5], r["event_id"]))
                out[after[:2]] = None
            cases.add((at, r["event_id"], kind, r["base"], seen, before[1] if before else None))
            out[at, r["event_id"]] = None
        for at, event_id in out:
            for c in cases.at_place(at, event_id):
                yield Row(event_id=c[1], user_id=key[0], event_type=c[2], at=c[0], base=c[3], seen=c[4], prior_id=c[5])
        newest = cases.of(len(cases.begins) - 1)[-1][0]
        cases.forget(newest - self.keep)
        cases.save()
        for kind, known in times.items():
            kept = known[bisect_left(known, newest - self.keep) :]
            self.kinds.updateValue((kind or "",) if kind is not None else ("\0",), (kept,))
        if self.expire:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.cases.clear()
        self.kinds.clear()
        return iter([])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """``transformWithState`` needs a store with column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ingest(
    stream: DataFrame,
    window: timedelta = timedelta(days=DUPLICATE_DAYS),
    late: timedelta = timedelta(days=DUPLICATE_DAYS),
    out_of_state: Column | None = None,
    flagged: Column | None = None,
    expire: bool = False,
) -> DataFrame:
    """Each case of a subject is flagged if its kind came within ``window`` before, linked to the subject's case before, and queued by the first that applies: Graylist, OutOfState, Flagged, Processed.

    ``stream``: event_id, user_id, event_type, ts; ``out_of_state`` and ``flagged``
    are conditions on its columns. Update mode: a row that comes late, by less than
    ``late`` behind its subject's newest, gets the flag and link of its place in time,
    and the rows that it changes (the next one's link, flags of the next of its kind)
    come again, put right; the newest output of an event counts. A row that is later
    still is judged by what is kept. Cases of one time go by event_id and are no
    duplicates of each other. A null kind is a kind. With ``expire`` (a timer in
    processing time, for streams that never end) a subject idle for ``window + late`` is
    forgotten. State is bounded by a subject's cases in ``window + late`` and a chunk.
    """
    use_state_store(stream.sparkSession)
    rule = F.lit("Processed")
    if flagged is not None:
        rule = F.when(flagged, "Flagged").otherwise(rule)
    if out_of_state is not None:
        rule = F.when(out_of_state, "OutOfState").otherwise(rule)
    rows = stream.select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), rule.alias("base"))
    made = rows.groupBy("user_id").transformWithState(Ingest(window, late, expire), OUT, "update", "processingTime" if expire else "none")
    return made.select("event_id", "user_id", "event_type", F.timestamp_micros("at").alias("ts"), "seen", "prior_id", F.when(F.col("seen"), "Graylist").otherwise(F.col("base")).alias("queue"))
