"""Jobs that lie idle are dropped as a stateful stream: one record and one timer a job."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.votes import ACTIVE

#: Timers and keyed records live in RocksDB, on disk, so that jobs may be many.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class IdleJobs(StatefulProcessor):
    """Keeps each job's last event. When the watermark is `limit` seconds beyond it, a job that is neither queued nor running is told and forgotten."""

    def __init__(self, limit: float):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double, seq long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        events = [tuple(e) for pdf in rows for e in pdf[["t", "seq", "state"]].itertuples(index=False)]
        if self.last.exists():
            events.append(tuple(self.last.get()))
        t, seq, state = max(events, key=lambda e: e[:2])
        self.last.update((float(t), int(seq), state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((t + self.limit) * 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        if self.last.exists():
            t, _, state = self.last.get()
            if state not in ACTIVE:
                self.last.clear()
                yield pd.DataFrame({"job": [key[0]], "state": [state], "touched": [t]})

    def close(self) -> None:
        pass


def idle_jobs(events: DataFrame, limit: float = 3600.0, late: str = "0 seconds") -> DataFrame:
    """(job, state, touched) of jobs as they fall idle; events: job, t (seconds), seq, state and the event time `at`.

    A job that is queued or running when its time is up is kept, and looked at again after its next event. One that comes
    back after it was told starts anew.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("job", "t", F.col("seq").cast("long").alias("seq"), "state", "at").withWatermark("at", late)
    kind = events.schema["job"].dataType.simpleString()
    return rows.groupBy("job").transformWithStateInPandas(IdleJobs(limit), f"job {kind}, state string, touched double", "Append", "EventTime")
