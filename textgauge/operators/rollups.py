"""Roll-ups of finished jobs as counters that merge: (dimension, name, measure, value).

A batch of jobs becomes a few counters, and the counters of batches add up to those of
the whole, so a report needs no job twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTERS = "dimension string, name string, measure string, value bigint"


def _counts(rows: DataFrame, dimension: str, name: Column, /, **measures: Column) -> DataFrame:
    sums = rows.groupBy(name.cast("string").alias("name")).agg(*[F.sum(c.cast("bigint")).alias(m) for m, c in measures.items()])
    long = sums.unpivot(["name"], list(measures), "measure", "value")
    return long.where("value IS NOT NULL").select(F.lit(dimension).alias("dimension"), "name", "measure", "value")


def partials(jobs: DataFrame) -> DataFrame:
    """Counters of finished jobs (profile, case_id, family, status, selected_attempt,
    reasons, items, repaired).

    ``reasons`` are an attempt log's retry reasons, null ones left out; ``items`` the
    answers, null where the job has no result.  Dimensions: total, status,
    selected_attempt, reason, profile, family; the last two and total have case, item, yes and
    no counts of jobs with a result.  One exchange of counters for each dimension.
    """
    one = F.lit(1)
    yes = F.size(F.filter("items", lambda i: i == "yes"))
    items = {"case_count": one, "checklist_count": F.size("items"), "yes_count": yes, "no_count": F.size("items") - yes}
    results = jobs.where("items IS NOT NULL")
    reasons = jobs.select(F.explode("reasons").alias("reason")).where("reason IS NOT NULL")
    parts = [
        _counts(jobs, "total", F.lit("all"), attempted=one, valid=F.col("items").isNotNull().cast("int"), repaired=(F.col("items").isNotNull() & F.col("repaired")).cast("int")),
        _counts(results, "total", F.lit("all"), **items),
        _counts(jobs, "status", F.coalesce("status", F.lit("unknown")), jobs=one),
        _counts(jobs.where("selected_attempt IS NOT NULL"), "selected_attempt", F.col("selected_attempt"), jobs=one),
        _counts(reasons, "reason", F.col("reason"), attempts=one),
        _counts(results, "profile", F.col("profile"), **items),
        _counts(results, "family", F.col("family"), **items),
    ]
    return reduce(DataFrame.unionByName, parts)


def merged(*counters: DataFrame) -> DataFrame:
    """The sum of counters; the order and number of batches make no difference."""
    return reduce(DataFrame.unionByName, counters).groupBy("dimension", "name", "measure").agg(F.sum("value").alias("value"))


class RollUp:
    """Counters of batches in a folder, a file or so for each batch.

    ``add`` reads the batch alone.  A batch that is added again, after a failure or a
    restart, replaces its own counters; a job belongs to one batch."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, jobs: DataFrame, batch: int | str) -> None:
        partials(jobs).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def add_stream(self, jobs: DataFrame, checkpoint: str):
        """Add every micro-batch of a stream of finished jobs; the query that does so."""
        return jobs.writeStream.foreachBatch(lambda rows, n: self.add(rows, n)).option("checkpointLocation", checkpoint)

    def counters(self) -> DataFrame:
        """All batches' counters, added up."""
        return merged(self.spark.read.schema(COUNTERS).parquet(f"{self.folder}/batch=*"))


def progress(counters: DataFrame, expected: int) -> dict:
    """The progress report: totals, histograms, and rates by profile and family.

    The driver holds a row for each counter, which jobs do not add to."""
    tree: dict[str, dict[str, dict[str, int]]] = {}
    for r in counters.orderBy("dimension", "name", "measure").collect():
        tree.setdefault(r.dimension, {}).setdefault(r.name, {})[r.measure] = r.value
    total = tree.get("total", {}).get("all", {})
    n = lambda m: total.get(m, 0)
    rated = lambda c: {**c, "yes_rate": c["yes_count"] / c["checklist_count"] if c.get("checklist_count") else None}
    flat = lambda d, m: {k: v[m] for k, v in tree.get(d, {}).items()}
    return {
        "execution_status": "complete" if n("attempted") == expected else "partial",
        "expected_case_count": expected,
        "attempted_case_count": n("attempted"),
        "valid_case_count": n("valid"),
        "invalid_case_count": n("attempted") - n("valid"),
        "repaired_json_case_count": n("repaired"),
        "case_status_counts": flat("status", "jobs"),
        "selected_attempt_counts": flat("selected_attempt", "jobs"),
        "retry_reason_counts": flat("reason", "attempts"),
        "checklist_count": n("checklist_count"),
        "yes_count": n("yes_count"),
        "no_count": n("no_count"),
        "yes_rate": n("yes_count") / n("checklist_count") if n("checklist_count") else None,
        "by_profile": {k: rated(v) for k, v in tree.get("profile", {}).items()},
        "by_family": {k: rated(v) for k, v in tree.get("family", {}).items()},
    }
