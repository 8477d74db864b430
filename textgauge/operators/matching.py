"""Matching of cases, videos, answers and statuses: semi, anti and left joins.

Sides that are configuration (cases, questions) are left to Spark's own size
check; none is forced to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.operators.validation import require_none


def one_sided(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Ids of only one side, with the side; empty when the sets are equal."""
    a, b = left.select(on).distinct(), right.select(on).distinct()
    return a.join(b, on, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, on, "left_anti").withColumn("side", F.lit("right")))


def select_videos(videos: DataFrame, cases: DataFrame, requested: DataFrame | None = None, allow_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """Videos to judge, and requested ids without one.

    Unknown ids, ids with two videos and an empty choice are errors, as are
    missing ids unless allowed.
    """
    ids = cases.select("case_id").distinct()
    require_none(videos.select("case_id").join(ids, "case_id", "left_anti"), "videos without a case")
    require_none(videos.groupBy("case_id").count().where("count > 1"), "more than one video")
    wanted = ids if requested is None else requested.select("case_id").distinct()
    require_none(wanted.join(ids, "case_id", "left_anti"), "requested ids that are no cases")
    chosen = videos.join(wanted, "case_id", "left_semi")
    missing = wanted.join(videos.select("case_id"), "case_id", "left_anti")
    if not allow_missing and requested is not None:
        require_none(missing, "requested ids without a video")
    if chosen.isEmpty():
        raise ValueError("no videos were selected")
    return chosen, missing


def build_jobs(videos: DataFrame, cases: DataFrame, selected: list[str] | None = None, expected: int = 0) -> DataFrame:
    """(profile, case_id, ...) jobs, optionally only ``PROFILE:CASE_ID`` names."""
    jobs = videos.join(cases, "case_id")
    require_none(videos.select("profile", "case_id").join(cases.select("case_id"), "case_id", "left_anti"), "videos without a case")
    require_none(jobs.groupBy("profile", "case_id").count().where("count > 1"), "job twice")
    if selected:
        if bad := [s for s in selected if ":" not in s]:
            raise ValueError(f"jobs are PROFILE:CASE_ID: {bad}")
        names = videos.sparkSession.createDataFrame([tuple(s.split(":", 1)) for s in dict.fromkeys(selected)], "profile string, case_id string")
        require_none(names.join(jobs, ["profile", "case_id"], "left_anti"), "selected jobs not found")
        jobs = jobs.join(names, ["profile", "case_id"], "left_semi")
    if expected and (n := jobs.count()) != expected:
        raise ValueError(f"expected {expected} jobs, found {n}")
    return jobs


def with_status(jobs: DataFrame, status: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Jobs with their status, ``pending`` where none is recorded, and results."""
    keys = ["profile", "case_id"]
    out = jobs.join(status.select(*keys, "status"), keys, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    return out if results is None else out.join(results, keys, "left")


def unfinished(jobs: DataFrame, status: DataFrame, terminal: tuple[str, ...] = ("pass", "pass_after_max_attempts", "invalid")) -> DataFrame:
    """Jobs that a resumed run still has to do."""
    return jobs.join(status.where(F.col("status").isin(*terminal)), ["profile", "case_id"], "left_anti")


def zip_exact(*names: str):
    """Arrays side by side; an error where their lengths differ."""
    first = F.size(names[0])
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.size(n) == first)
    return F.when(F.assert_true(same).isNull(), F.arrays_zip(*names))
