"""Attempts as a stream (a Spark-native extra: the batch operators do the same).

Each arriving response updates its job's state; a job is put out once, when it
passes or has used its attempts.  The state of a job is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "profile string, case_id string, status string, selected_attempt int, attempt_count int"
_STATE = "attempts int, last int, last_parsed boolean, done boolean"


def finished_jobs(attempts: DataFrame, most: int = 3, lenient: bool = True) -> DataFrame:
    """Stream of (profile, case_id, attempt, passed, parsed) to finished jobs."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        n, last, parsed, done = state.get if state.exists else (0, 0, False, False)
        rows = pd.concat(list(frames)).sort_values("attempt")
        out = None
        for attempt, passed, read in zip(rows["attempt"], rows["passed"], rows["parsed"], strict=True):
            if done:
                break
            n += 1
            if attempt > last:
                last, parsed = int(attempt), bool(read)
            if passed:
                done, out = True, ("pass", int(attempt))
            elif n >= most:
                done, out = True, (("pass_after_max_attempts", last) if parsed and lenient else ("invalid", None))
        state.update((n, last, parsed, done))
        if out:
            yield pd.DataFrame({"profile": [key[0]], "case_id": [key[1]], "status": [out[0]], "selected_attempt": pd.array([out[1]], dtype="Int32"), "attempt_count": [n]})

    return attempts.groupBy("profile", "case_id").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def attempt_counts(attempts: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Attempts and retry reasons by window of ``ts``; late rows beyond ``late`` are dropped."""
    return attempts.withWatermark("ts", late).groupBy(F.window("ts", window), "reason").agg(F.count(F.lit(1)).alias("attempts")).select(F.col("window.start").alias("start"), "reason", "attempts")
