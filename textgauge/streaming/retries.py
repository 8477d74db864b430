"""A worker's retries as a stream with timers: attempts in, due retries and ends out.

The state of a job is its attempts so far; a restart from the checkpoint goes on with
it, and a new stream rebuilds it from the attempt log, which is read from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textgauge.operators.worker import MOST

OUTPUT = "case_id string, event string, attempt int"
#: State stores that keep timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Retries(StatefulProcessor):
    """After a failed attempt k a job is due again in min(60, 10 k) seconds; a sound one
    or the last one ends it, and what comes later is dropped."""

    def __init__(self, most: int = MOST, second: int = 1000):
        self.most, self.second = most, second

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempts int, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used, ended = self.job.get() if self.job.exists() else (0, False)
        log = pd.concat(list(rows)).sort_values("attempt")
        out = None
        for attempt, sound in zip(log["attempt"], log["sound"], strict=True):
            # attempts that were seen before, or come after the end, change nothing
            if ended or attempt <= used:
                continue
            used = int(attempt)
            ended = bool(sound) or used >= self.most
            out = ("complete" if sound else "failed" if ended else "waiting"), used
        if out is None:
            return
        self.job.update((used, ended))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if not ended:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + min(60, 10 * used) * self.second)
        yield pd.DataFrame({"case_id": [key[0]], "event": [out[0]], "attempt": pd.array([out[1]], dtype="Int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        used, ended = self.job.get()
        if not ended:
            yield pd.DataFrame({"case_id": [key[0]], "event": ["due"], "attempt": pd.array([used + 1], dtype="Int32")})

    def close(self) -> None:
        return


def retries(attempts: DataFrame, most: int = MOST, second: int = 1000) -> DataFrame:
    """Stream of (case_id, attempt, sound) to (case_id, event, attempt): waiting, due with
    the attempt that is due, complete, failed.

    ``second`` is the length of a second in milliseconds.  The session needs a state
    store with timers (``STORE`` as spark.sql.streaming.stateStore.providerClass)."""
    return attempts.groupBy("case_id").transformWithStateInPandas(Retries(most, second), OUTPUT, "Append", "ProcessingTime")
