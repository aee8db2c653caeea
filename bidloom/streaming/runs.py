"""Runs as a live state machine: keyed state that outlives micro-batches, illegal transitions as rows, timers for runs that stall.

The state of a key is the last event that counted.  Events of a batch are taken in
their own order (time, then id); one that is not after the last that counted is a
replay and does nothing, so a batch that is sent twice changes nothing.  Where a
transition is not legal the row says so and the new state holds all the same, as in
the check of a finished log.  With ``stalled_after`` a key that falls silent for that
long (event time, by the watermark) gives one STALLED row.

Defined results: a null status or time counts as no event; the first event of a key
is legal; late events (before the last that counted) are replays.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key long, event_id long, previous string, status string, kind string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Transitions(StatefulProcessor):
    """Rows (key, event_id, ts, status) to rows of OUTPUT; kind is ILLEGAL or STALLED."""

    def __init__(self, legal: list[tuple[str, str]], stalled_after: timedelta | None):
        self.legal, self.stalled_ms = frozenset(legal), None if stalled_after is None else int(stalled_after.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts_us long, event_id long, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        for ts_us, event_id, status in sorted((r.ts_us, r.event_id, r.status) for r in rows):
            if held is not None and (ts_us, event_id) <= (held[0], held[1]):
                continue
            if held is not None and (held[2], status) not in self.legal:
                yield Row(key=key[0], event_id=event_id, previous=held[2], status=status, kind="ILLEGAL")
            held = (ts_us, event_id, status)
        if held is not None:
            self.last.update(held)
            if self.stalled_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(held[0] // 1000 + self.stalled_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, event_id, status = self.last.get()
        yield Row(key=key[0], event_id=event_id, previous=status, status=None, kind="STALLED")

    def close(self) -> None:
        pass


def transitions(events: DataFrame, key: str, ts: str, event_id: str, status: str, legal: list[tuple[str, str]], stalled_after: timedelta | None = None, delay: str = "0 seconds") -> DataFrame:
    """The illegal transitions of a stream of events, and with ``stalled_after`` the runs that fell silent.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass = STATE_STORE).
    """
    d = events.filter(F.col(status).isNotNull() & F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp"))
    if stalled_after is not None:
        d = d.withWatermark(ts, delay)
    d = d.select(F.col(key).cast("long").alias("key"), F.col(event_id).cast("long").alias("event_id"), F.unix_micros(F.col(ts)).alias("ts_us"), F.col(status).alias("status"), F.col(ts).alias("ts"))
    mode = "None" if stalled_after is None else "EventTime"
    return d.groupBy("key").transformWithState(Transitions(legal, stalled_after), OUTPUT, "Append", mode)
