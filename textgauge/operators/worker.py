"""States of a resumable batch worker, from its job list and its attempt log.

A job is done by the first attempt whose deliverable is sound, is skipped where a
sound one was there before, waits ``backoff_seconds`` after a failed attempt, and has
failed with its last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.operators.partitioning import backoff_seconds

#: Attempts that a job has.
MOST = 3


def job_states(jobs: DataFrame, attempts: DataFrame, present: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """Jobs with ``state``, ``attempts``, ``failure`` and ``due_at``.

    ``attempts`` has case_id, attempt (from 1), exit_code, ``delivered`` (a file is there),
    ``fault`` (null where it is sound) and finished_at; ``present`` the case_id of
    deliverables that were sound before.  What follows a success or the last attempt
    counts for nothing, and a repeated attempt counts once.  States: skipped, complete,
    failed, waiting (with ``due_at``), pending.
    """
    own = attempts.where(F.col("attempt").between(1, most))
    good = F.coalesce(F.col("delivered") & F.col("fault").isNull(), F.lit(False))
    told = F.when(
        F.coalesce("delivered", F.lit(False)), F.concat(F.lit("invalid deliverable after attempt "), F.col("attempt").cast("string"), F.lit(": "), F.coalesce("fault", F.lit("")))
    ).otherwise(F.concat(F.lit("attempt "), F.col("attempt").cast("string"), F.lit(" exited "), F.coalesce(F.col("exit_code").cast("string"), F.lit("?"))))
    last = F.max(F.struct("attempt", "finished_at", told.alias("failure")))
    log = own.groupBy("case_id").agg(F.min(F.when(good, F.col("attempt"))).alias("done"), last.alias("last"))
    out = jobs.join(log, "case_id", "left")
    if present is not None:
        out = out.join(present.select("case_id").distinct().withColumn("__present", F.lit(True)), "case_id", "left")
    else:
        out = out.withColumn("__present", F.lit(None).cast("boolean"))
    used = F.coalesce("done", "last.attempt", F.lit(0))
    state = F.when(F.col("__present"), "skipped").when(F.col("done").isNotNull(), "complete").when(used >= most, "failed").when(used > 0, "waiting").otherwise("pending")
    out = out.withColumns({"state": state, "attempts": F.when(F.col("__present"), 0).otherwise(used).cast("int")})
    failing = F.col("state").isin("failed", "waiting")
    due = F.col("last.finished_at") + F.make_dt_interval(secs=backoff_seconds(F.col("attempts")))
    return out.withColumns({"failure": F.when(failing, F.col("last.failure")), "due_at": F.when(F.col("state") == "waiting", due)}).drop("done", "last", "__present")


def worker_report(states: DataFrame, key: str = "worker", order: str = "pos") -> DataFrame:
    """A row for each worker: assigned, first and last id, completed, failed, state.

    A worker is complete when no job waits or is pending."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    out = states.groupBy(key).agg(
        F.count(F.lit(1)).alias("assigned_count"),
        F.min_by("case_id", order).alias("first_id"),
        F.max_by("case_id", order).alias("last_id"),
        n("skipped", "complete").alias("completed_count"),
        n("failed").alias("failed_count"),
        n("waiting", "pending").alias("open_count"),
    )
    ended = F.when(F.col("failed_count") > 0, "complete_with_failures").otherwise("complete")
    running = F.when(F.col("failed_count") > 0, "running_with_failures").otherwise("running")
    return out.withColumn("state", F.when(F.col("open_count") == 0, ended).otherwise(running))
