"""Leases of workers on tasks, judged from a stream of their events in the order of event times.

A worker acquires a task and gets a token; each later token is greater. Heartbeats and releases must bear the token that
is current, so a worker that lost its lease can't write any more. A lease without a heartbeat for `ttl` ends by a timer: the
task is queued again under a new token, or is dead once it was queued again `most_retries` times.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docketry.sources.shared import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "subject long, event_id long, at long, verdict string, token long"


class Lease:
    """The lease of one task: what an event, or time that passes, does to it."""

    def __init__(self, ttl: int, most_retries: int, state: tuple | None = None) -> None:
        self.ttl, self.most_retries = ttl, most_retries
        self.token, self.until, self.retries, self.dead = state or (0, None, 0, False)

    def state(self) -> tuple:
        return self.token, self.until, self.retries, self.dead

    def expire(self, now: int) -> tuple[int, str, int] | None:
        """(time, verdict, token) of a lease that has run out by now."""
        if self.until is None or self.until > now:
            return None
        at, self.until = self.until, None
        if self.retries < self.most_retries:
            self.retries += 1
            self.token += 1
            return at, "requeue", self.token
        self.dead = True
        return at, "dead_letter", self.token

    def apply(self, at: int, action: str, token: int | None) -> str:
        if action == "acquire":
            if self.dead:
                return "refused"
            if self.until is not None:
                return "held"
            self.token, self.until = self.token + 1, at + self.ttl
            return "granted"
        if self.until is None or token != self.token:
            return "stale"
        if action == "release":
            self.until, self.retries = None, 0
            return "released"
        self.until = at + self.ttl
        return "accepted"


class Leases(StatefulProcessor):
    """Holds a task's events until the watermark passes them, then judges them in order; a timer ends leases.

    State of a task is its lease and its events of the lateness that is allowed, whatever its number of events.
    """

    def __init__(self, ttl: int, most_retries: int) -> None:
        self.ttl, self.most_retries = ttl, most_retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, event_id long, action string, token long")
        self.lease = handle.getValueState("lease", "token long, until long, retries long, dead boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            events = [(int(r.at), int(r.event_id), r.action, None if pd.isna(r.token) else int(r.token)) for r in part.itertuples()]
            self.held.appendList(events)
            first = min([e[0] for e in events] + ([] if first is None else [first]))
        if first is not None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs() + 1))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted(tuple(e) for e in self.held.get()) if self.held.exists() else []
        lease = Lease(self.ttl, self.most_retries, tuple(self.lease.get()) if self.lease.exists() else None)
        out, later = [], [e for e in events if e[0] > now]
        for at, event, action, token in events[: len(events) - len(later)]:
            if ended := lease.expire(at):
                out.append((key[0], None, *ended))
            verdict = lease.apply(at, action, token)
            out.append((key[0], event, at, verdict, lease.token))
        if ended := lease.expire(now):
            out.append((key[0], None, *ended))
        self.held.clear()
        if later:
            self.held.put(later)
        self.lease.update(lease.state())
        waits = [e[0] for e in later[:1]] + ([] if lease.until is None else [lease.until])
        if waits:
            self.handle.registerTimer(min(waits))
        if out:
            frame = pd.DataFrame(out, columns=["subject", "event_id", "at", "verdict", "token"])
            yield frame.astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


def lease_decisions(spark: SparkSession, events: DataFrame, ttl_ms: int, most_retries: int, late: str) -> DataFrame:
    """subject, event_id (null for what time does), at (ms), verdict, token, of a stream of events.

    events: time (timestamp), subject, event_id, action (acquire, beat, release), token (claimed, null to acquire), as a stream.
    Events are judged once the watermark, `late` behind the latest event, has passed them; so are leases that have run
    out. What arrives later than that is dropped. Rows are appended once to a table below spark.checkpoint.dir.
    """
    out = f"{shared_folder(spark, 'stream')}/leases-{uuid.uuid4().hex}"
    rows = events.selectExpr("time", "subject", "event_id", "action", "cast(token as long) as token", "unix_millis(time) as at").withWatermark("time", late)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        judged = rows.groupBy("subject").transformWithStateInPandas(Leases(ttl_ms, most_retries), RESULT, "Append", "EventTime")
        written = judged.writeStream.format("parquet").outputMode("append").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state")
        written.trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    return spark.read.schema(RESULT).parquet(f"{out}/rows")
