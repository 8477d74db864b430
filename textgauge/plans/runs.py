"""Summaries of run folders: manifest, statuses and results to one nested report."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.functions.text import token_values
from textgauge.operators import scoring
from textgauge.operators.matching import one_sided, with_status
from textgauge.operators.validation import DIMENSIONS, ITEM_IDS, require_none
from textgauge.plans.reports import score_settings
from textgauge.sources import readers
from textgauge.sources.sinks import checkpointed


def expected_jobs(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.schema("job_identities array<struct<profile:string,case_id:string>>").option("multiLine", True).json(f"{root}/run_manifest.json")
    return raw.selectExpr("inline(job_identities)").distinct()


def _tree(row, names) -> dict:
    return {n: row[n] for n in names}


def summarize_run(spark: SparkSession, root: str, task: str, ids: list[str] | None = None, settings: tuple[int, ...] = scoring.N_SETTINGS) -> dict:
    """Nested report of a run.  The driver holds a row for each profile, scene,
    status and unscored job; cases stay in tables (``cases_table``)."""
    jobs = expected_jobs(spark, root)
    if ids is not None:
        require_none(one_sided(jobs.select("case_id"), spark.createDataFrame([(i,) for i in ids], "case_id string"), "case_id"), "requested ids that disagree with the manifest")
    allowed = scoring.SCORED_CHECKLIST if task == "checklist" else scoring.SCORED_WER
    results = readers.read_checklist_results(spark, root) if task == "checklist" else readers.read_scores(spark, root)
    state = with_status(jobs, readers.read_statuses(spark, root), results)
    usable = F.col("status").isin(*allowed) & F.col("items").isNotNull()
    done = state.where(usable).withColumn("scene", scoring.scene(F.col("case_id")))
    unscored = [r.asDict() for r in state.where(~usable).select("profile", "case_id", "status").orderBy("profile", "case_id").collect()]
    counts = {r.status: r["count"] for r in state.groupBy("status").count().collect()}
    total = sum(counts.values())
    report: dict = {"task": task, "expected_videos": total, "status_counts": counts, "all_scored": not unscored, "unscored_cases": unscored}
    if task == "checklist":
        require_none(done.where(~F.transform("items", lambda i: i["id"]).eqNullSafe(F.array(*map(F.lit, ITEM_IDS)))).select("profile", "case_id"), "results that are not C01 to C20")
        items = done.select("profile", "case_id", "scene", F.explode("items").alias("i")).select("profile", "case_id", "scene", F.coalesce("i.dimension", "i.category").alias("dimension"), "i.answer")
        require_none(items.where(~F.coalesce(F.col("answer").isin("yes", "no") & F.col("dimension").isin(*DIMENSIONS), F.lit(False))), "labels or dimensions")
        report["cases_table"] = items

        def dims(key: list[str]) -> list:
            return scoring.dimension_scores(items, key).collect()

        score = ("yes_count", "item_count", "yes_rate")
        videos = {(r.level, r.profile or r.scene): r.n for r in scoring.grouped(done, [(), ("profile",), ("scene",)], F.count(F.lit(1)).alias("n")).collect()}
        by_dim: dict = {}
        for key in ([], ["profile"], ["scene"]):
            for r in dims(key):
                by_dim.setdefault(("by_" + key[0] if key else "overall", r[key[0]] if key else None), {})[r.dimension] = _tree(r, ("yes_count", "item_count", "applicable_videos", "yes_rate"))
        for r in scoring.video_score(items).collect():
            where = (r.level, r.profile or r.scene)
            _put(report, where, {"scored_videos": videos.get(where, 0), **_tree(r, score), "dimensions": by_dim.get(where, {})})
    else:
        pairs = done.select("profile", "case_id", "scene", F.explode("items").alias("i")).select("profile", "case_id", "scene", token_values("i.reference").alias("reference"), token_values(F.coalesce("i.hypothesis", F.lit(""))).alias("hypothesis"))
        cases = checkpointed(score_settings(pairs, ["profile", "case_id", "scene"], settings))
        report["cases_table"] = cases
        for r in scoring.balanced_wer(cases, [("n",), ("n", "profile"), ("n", "scene")]).collect():
            level = "overall" if r.level == "by_n" else r.level.replace("n_", "")
            node = _put(report, (level, r.profile or r.scene), {"scored_videos": r.scored_videos})
            node.setdefault("case_balanced_wer", {})[f"R+{r.n}"] = r.case_balanced_wer
    return report


def _put(report: dict, where: tuple, value: dict) -> dict:
    level, name = where
    node = report.setdefault(level, {})
    if name is not None:
        node = node.setdefault(name, {})
    node.update(value)
    return node


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Summarize a run folder.")
    p.add_argument("--run-root", required=True)
    p.add_argument("--task", choices=["checklist", "wer"], required=True)
    p.add_argument("--n", type=int, nargs="+", default=list(scoring.N_SETTINGS))
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    report = summarize_run(spark, a.run_root, a.task, settings=tuple(a.n))
    report.pop("cases_table", None)
    print(json.dumps(report, ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
