"""Attempts of a job: which one counts, what the next is told, truncation and budgets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.functions.answers import CHECKLIST_FEEDBACK, TRANSCRIPTION_FEEDBACK

KEYS = ("profile", "case_id")
MAX_ATTEMPTS, MOST_TOKENS = 3, 4096


def selected_attempts(attempts: DataFrame, keys: Sequence[str] = KEYS, lenient: bool = True, most: int = MAX_ATTEMPTS) -> DataFrame:
    """One row for each job: ``status`` and the attempt that counts.

    ``attempts`` has ``attempt``, ``passed`` and ``parsed``.  The first pass
    counts.  Without one a job with ``most`` attempts is accepted with its last
    attempt where that was parsed (``lenient``), else invalid; with fewer it is
    still being retried.  Ordered aggregates do it in one shuffle; no window sorts
    a job's attempts.
    """
    kept = attempts.groupBy(*keys).agg(
        F.min(F.when(F.col("passed"), F.col("attempt"))).alias("first_pass"),
        F.max("attempt").alias("last"),
        F.max_by("parsed", "attempt").alias("last_parsed"),
        F.count(F.lit(1)).alias("attempt_count"),
    )
    accept = F.col("last_parsed") if lenient else F.lit(False)
    status = F.when(F.col("first_pass").isNotNull(), "pass").when(F.col("last") < most, "retrying").when(accept, "pass_after_max_attempts").otherwise("invalid")
    chosen = F.when(status == "pass", F.col("first_pass")).when(status == "pass_after_max_attempts", F.col("last"))
    return kept.select(*keys, status.alias("status"), chosen.alias("selected_attempt"), "attempt_count")


def feedback_of(reason, task: str):
    known = TRANSCRIPTION_FEEDBACK if task == "wer" else CHECKLIST_FEEDBACK
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[reason]


def with_feedback(attempts: DataFrame, task: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """What each attempt was told of the one before it."""
    w = Window.partitionBy(*keys).orderBy("attempt")
    return attempts.withColumn("previous_feedback", F.lag(feedback_of(F.col("reason"), task)).over(w))


def truncation_streaks(attempts: DataFrame, keys: Sequence[str] = KEYS, order: str = "attempt") -> DataFrame:
    """How many of a job's latest attempts in a row ended for length.

    The streak is what follows the last attempt that ended otherwise.  Attempts by
    that one are counted in a second aggregation; no job's attempts are gathered.
    """
    cut = F.col("finish_reason").eqNullSafe(F.lit("length"))
    rows = attempts.select(*keys, F.col(order).alias("__at"), cut.alias("__cut"))
    other = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(F.when(~F.col("__cut"), F.col("__at"))).alias("__other"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    late = F.col("__cut") & (F.col("__other").isNull() | (F.col("__at") > F.col("__other")))
    return rows.join(other, same).groupBy(*keys).agg(F.count_if(late).cast("int").alias("streak"))


def token_budget(base: int, streak, most: int = MOST_TOKENS):
    """The base doubled for every truncation in the streak, up to ``most``."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), F.least(streak, F.lit(20)))).cast("int"))


def resume_guard(recorded: str | None, current: str, has_results: bool) -> None:
    """A run goes on only with the fingerprint that it began with."""
    if recorded is None and has_results:
        raise ValueError("results without a manifest")
    if recorded is not None and recorded != current:
        raise ValueError("the run's inputs have changed")
