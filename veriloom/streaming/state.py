"""Append-only logs as streams with state: legality of phases, confirmations in a row, commands and their deadlines.

Each operator keeps a few values for each key in the state store (RocksDB) and reads its rows one by one, so no key is gathered in
memory, however many rows a micro-batch has of it.  Rows may come in any order within the watermark: what comes before its
predecessor waits in the state, and an event-time timer ends the wait when the predecessor can't come any more.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

START = "start"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocks(spark: SparkSession) -> None:
    """Timers and lists of state need this state store; it is a setting of the session and holds for queries started later."""
    spark.conf.set(PROVIDER, ROCKS)


class InOrder(StatefulProcessor):
    """Rows ``seq, value, at`` (milliseconds) of a key, handed to ``step`` by ascending ``seq``, each number once.

    A row follows its predecessor at once.  One that comes early waits, at most until the watermark passes its own time; then what is
    missing before it is taken for lost.  A number that was passed already is reported by ``late``.
    """

    #: Schema of what ``step`` carries from row to row, and its value before the first row.
    carried, first = "carried string", (None,)

    def __init__(self, first_seq: int):
        self.first_seq = first_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", f"next bigint, held bigint, {self.carried}")
        self.waiting = handle.getMapState("waiting", "seq bigint", "value string, at bigint")

    def step(self, key: str, carried: tuple, seq: int, value: str) -> tuple[tuple, Row | None]:
        raise NotImplementedError

    def late(self, key: str, seq: int, value: str) -> Row | None:
        return None

    def _state(self) -> tuple[int, int, tuple]:
        found = self.now.get()
        return (found[0], found[1], tuple(found[2:])) if found is not None else (self.first_seq, 0, self.first)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        following, held, carried = self._state()
        for row in rows:
            if row["seq"] < following:
                out = self.late(key[0], row["seq"], row["value"])
                if out is not None:
                    yield out
            elif row["seq"] > following:
                if not self.waiting.containsKey((row["seq"],)):
                    held += 1
                self.waiting.updateValue((row["seq"],), (row["value"], row["at"]))
                self.handle.registerTimer(row["at"])
            else:
                value = row["value"]
                while True:
                    carried, out = self.step(key[0], carried, following, value)
                    if out is not None:
                        yield out
                    following += 1
                    if not held or not self.waiting.containsKey((following,)):
                        break
                    value = self.waiting.getValue((following,))[0]
                    self.waiting.removeKey((following,))
                    held -= 1
        self.now.update((following, held, *carried))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        following, held, carried = self._state()
        over = expiredTimerInfo.getExpiryTimeInMs()
        numbers = sorted(k[0] for k in self.waiting.keys())  # of rows that wait for others of their key
        past = [k for k, seq in enumerate(numbers) if self.waiting.getValue((seq,))[1] <= over]
        last = past[-1] if past else -1
        for k, seq in enumerate(numbers):
            if k > last and seq != following:
                break
            carried, out = self.step(key[0], carried, seq, self.waiting.getValue((seq,))[0])
            if out is not None:
                yield out
            self.waiting.removeKey((seq,))
            held, following = held - 1, seq + 1
        self.now.update((following, held, *carried))

    def close(self) -> None:
        pass


class Legality(InOrder):
    carried, first = "phase string", (START,)

    def __init__(self, first_seq: int, legal: dict[str, tuple[str, ...]]):
        super().__init__(first_seq)
        self.allowed = {(a, b) for a, many in legal.items() for b in many}

    def step(self, key: str, carried: tuple, seq: int, value: str) -> tuple[tuple, Row | None]:
        bad = (carried[0], value) not in self.allowed
        return (value,), Row(stream=key, seq=seq, before=carried[0], phase=value, fault="illegal") if bad else None

    def late(self, key: str, seq: int, value: str) -> Row:
        return Row(stream=key, seq=seq, before=None, phase=value, fault="late")


def illegal_transitions(log: DataFrame, legal: dict[str, tuple[str, ...]], late: str = "1 hour", first_seq: int = 0) -> DataFrame:
    """``stream, seq, before, phase, fault`` of ``log(stream string, seq long, phase string, ts timestamp)``: rows whose phase doesn't follow
    the one before, in order of ``seq``, and rows that come after their place was passed (``late``)."""
    use_rocks(log.sparkSession)
    rows = log.withWatermark("ts", late).select("stream", "seq", F.col("phase").alias("value"), F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("stream").transformWithState(Legality(first_seq, legal), "stream string, seq bigint, before string, phase string, fault string", "append", "eventTime")


class Streak(InOrder):
    carried, first = "streak int, confirmed boolean", (0, False)

    def __init__(self, first_seq: int, times: int):
        super().__init__(first_seq)
        self.times = times

    def step(self, key: str, carried: tuple, seq: int, value: str) -> tuple[tuple, Row | None]:
        streak, confirmed = carried
        streak = min(streak + 1, self.times) if value == "true" else 0
        found = not confirmed and streak >= self.times
        return (streak, confirmed or found), Row(stream=key, seq=seq) if found else None


def confirmations(log: DataFrame, times: int, late: str = "1 hour", first_seq: int = 0) -> DataFrame:
    """``stream, seq`` where ``log(stream, seq, ok boolean, ts)`` was right for the ``times``-th time in a row, once per stream; a lost
    row doesn't break a streak."""
    use_rocks(log.sparkSession)
    rows = log.withWatermark("ts", late).select("stream", "seq", F.col("ok").cast("string").alias("value"), F.unix_millis("ts").alias("at"), "ts")
    return rows.groupBy("stream").transformWithState(Streak(first_seq, times), "stream string, seq bigint", "append", "eventTime")


class Deadline(StatefulProcessor):
    """One command: asked, done, or neither until its deadline."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "asked bigint, done bigint, told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found = self.seen.get()
        asked, done, told = found if found is not None else (None, None, False)
        before = (asked, done)
        for row in rows:  # the first of each kind counts
            if row["kind"] == "pending":
                asked = row["at"] if asked is None else min(asked, row["at"])
            else:
                done = row["at"] if done is None else min(done, row["at"])
        if told:
            return
        if asked is not None and done is not None and asked <= done <= asked + self.wait_ms:
            yield Row(command_id=key[0], asked=asked, done=done, outcome="completed")
            told = True
        elif (asked, done) != before:
            self.handle.registerTimer((asked if asked is not None else done) + self.wait_ms)
        self.seen.update((asked, done, told))
        if told:  # what repeats is swallowed until then
            self.handle.registerTimer(asked + self.wait_ms)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        found = self.seen.get()
        if found is None:
            return
        asked, done, told = found
        if (asked if asked is not None else done) + self.wait_ms > expiredTimerInfo.getExpiryTimeInMs():
            return  # of an earlier guess; the right timer is set
        if not told:
            yield Row(command_id=key[0], asked=asked, done=done, outcome="timed_out" if asked is not None else "completed_only")
        self.seen.clear()

    def close(self) -> None:
        pass


def command_outcomes(events: DataFrame, wait: int, late: str = "1 minute") -> DataFrame:
    """``command_id, asked, done, outcome`` of ``events(command_id string, kind string, ts)``, kinds ``pending`` and ``completed``.

    ``completed`` at once when both sides are there, ``done`` within ``wait`` seconds of ``asked``; ``timed_out`` when the watermark passes
    the deadline of a command without one (``done`` is then that of a completion out of time, if any); ``completed_only`` without a
    pending side.  A key's state is two times and goes with its timer.
    """
    use_rocks(events.sparkSession)
    rows = events.withWatermark("ts", late).select("command_id", "kind", F.unix_millis("ts").alias("at"), "ts")
    out = rows.groupBy("command_id").transformWithState(Deadline(wait * 1000), "command_id string, asked bigint, done bigint, outcome string", "append", "eventTime")
    return out.select("command_id", F.timestamp_millis("asked").alias("asked"), F.timestamp_millis("done").alias("done"), "outcome")
