"""One report for a folder of videos: checks the videos, then sums both tasks up.

Models run elsewhere; their run folders, one for each task, are inputs here.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.operators.matching import one_sided, select_videos
from textgauge.operators.validation import require_none
from textgauge.plans.runs import summarize_run
from textgauge.sources import readers, sinks

TASKS = ("checklist", "wer")


def chosen_videos(spark: SparkSession, videos: str, prompts: str, checklists: str) -> tuple[DataFrame, DataFrame]:
    """Videos to judge and cases without one.  Names that are no case, ids with two
    files, links out of the folder, cases and checklists of other ids, and an empty
    choice are errors; missing videos are not."""
    cases, lists = readers.read_cases(spark, prompts), readers.read_checklists(spark, checklists)
    require_none(one_sided(cases.select("id"), lists.select("id"), "id"), "ids of prompts and checklists")
    found = readers.videos_inside(readers.read_videos(spark, videos), videos)
    return select_videos(found, cases.select(F.col("id").alias("case_id")), allow_missing=True)


def evaluate(spark: SparkSession, videos: str, prompts: str, checklists: str, runs: dict[str, str], output: str | None = None) -> dict:
    """Reports by task (``TASKS``) for the run folders of these videos, written as
    ``<output>/<task>/reports/metrics.json`` and ``<output>/metrics.json``.

    A run that judged other videos than these is an error."""
    if unknown := sorted(set(runs) - set(TASKS)):
        raise ValueError(f"tasks: {unknown}")
    ids = [r.case_id for r in chosen_videos(spark, videos, prompts, checklists)[0].select("case_id").collect()]
    reports = {}
    for task in (t for t in TASKS if t in runs):
        reports[task] = summarize_run(spark, runs[task], task, ids=ids)
        reports[task].pop("cases_table", None)
    if output:
        sinks.write_metrics(spark, reports, output)
    return reports


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Sum up the runs that judged a folder of videos.")
    p.add_argument("videos", help="folder of MP4 files, or one")
    p.add_argument("--prompts", required=True)
    p.add_argument("--checklists", required=True)
    for task in TASKS:
        p.add_argument(f"--{task}-run", help=f"run folder of the {task} task")
    p.add_argument("--output")
    p.add_argument("--dry-run", action="store_true", help="check the inputs only")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.dry_run:
        chosen, missing = chosen_videos(spark, a.videos, a.prompts, a.checklists)
        print(json.dumps({"videos": chosen.count(), "cases_without_video": missing.count()}))
        return
    runs = {t: r for t in TASKS if (r := getattr(a, f"{t}_run"))}
    print(json.dumps(evaluate(spark, a.videos, a.prompts, a.checklists, runs, a.output), ensure_ascii=False, indent=2))


if __name__ == "__main__":
    main()
