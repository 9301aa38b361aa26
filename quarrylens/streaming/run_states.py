"""The state machine of runs over a stream of their events.

Events come late, out of order and more than once.  Each run keeps the events that may
still be overtaken, and its state; when the watermark passes an event's time, a timer
applies it, in the order of (time, id).  A run that is planning is gated: it starts only
after its plan is approved.  States that end a run take no further event.  Events later
than the watermark allows are dropped by the engine, as a batch up to then would have it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What an event turns a run's state into; others leave it as it is.
MOVES = {
    "queued": {"plan": "planning", "start": "running", "fail": "failed", "cancel": "cancelled"},
    "planning": {"approve": "queued", "fail": "failed", "cancel": "cancelled"},
    "running": {"succeed": "completed", "fail": "failed", "cancel": "cancelled"},
}
FIRST = "queued"
STEP = "run_id long, event_id long, at timestamp, event string, old string, new string"
NAMES = [x.split()[0] for x in STEP.split(", ")]
EVENT = ["run_id", "event_id", "at_us", "event"]
#: Runs whose state is kept together.
GROUP = 500


def moved(state: str, event: str) -> str:
    return MOVES.get(state, {}).get(event, state)


class Runs(StatefulProcessor):
    """State of the runs of a group: their statuses, and the events whose time hasn't come.

    A call for each group instead of each run: events wait as packed tables, one for each
    batch that brought some, and one timer waits for the first of them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.statuses = handle.getValueState("statuses", "packed binary")
        self.waiting = handle.getListState("waiting", "packed binary")
        self.first = handle.getValueState("first", "at_ms long")

    def _wait(self, at_ms: int) -> None:
        """A timer at that time, in the place of a later one."""
        before = self.first.get()[0] if self.first.exists() else None
        if before is None or at_ms < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at_ms)
            self.first.update((at_ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.waiting.appendValue((packed(pdf[EVENT]),))
                self._wait(int(pdf["at_us"].min()) // 1000 + 1)
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.first.clear()
        every = pd.concat([unpacked(x[0]) for x in self.waiting.get()], ignore_index=True)
        # a repeated event takes its own place
        every = every.drop_duplicates(["run_id", "event_id"], keep="last")
        ripe = every["at_us"] // 1000 + 1 <= now
        due, left = every[ripe].sort_values(["run_id", "at_us", "event_id"]), every[~ripe]
        statuses, steps = dict(pickle.loads(self.statuses.get()[0])) if self.statuses.exists() else {}, []
        for run_id, event_id, at, event in zip(*(due[c].tolist() for c in EVENT), strict=True):
            status = statuses.get(run_id, FIRST)
            new = moved(status, event)
            if new != status:
                steps.append((run_id, event_id, pd.Timestamp(at, unit="us"), event, status, new))
                statuses[run_id] = new
        self.statuses.update((pickle.dumps(statuses),))
        if len(left):
            self.waiting.put([(packed(left),)])
            self._wait(int(left["at_us"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        yield pd.DataFrame(steps, columns=NAMES)

    def close(self) -> None:
        pass


def packed(events: pd.DataFrame) -> bytes:
    return pickle.dumps([events[c].tolist() for c in EVENT])


def unpacked(data: bytes) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(EVENT, pickle.loads(data), strict=True)))


def steps(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The steps (run_id, event_id, at, event, old, new) that runs take.

    events: a stream of (run_id long, event_id long, at timestamp, event).  Runs share
    state in groups of ``GROUP`` neighbouring ids.  The session keeps streaming state in
    RocksDB, as ``transformWithState`` demands.
    """
    held = events.withWatermark("at", late).withColumn("at_us", F.unix_micros("at")).withColumn("runs", F.floor(F.col("run_id") / GROUP).cast("long"))
    return held.groupBy("runs").transformWithStateInPandas(Runs(), STEP, "append", "eventTime")
