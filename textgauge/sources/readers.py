"""Readers: cases, checklists, prompt files, videos, statuses, results and attempts.

Everything is read by Spark's own sources, so any file system that Spark knows
will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.operators.validation import case_faults, checklist_faults, require_none
from textgauge.sources.files import hashed, outside

CASES = "cases array<struct<id:string,prompt_en:string,required_text:array<struct<id:string,carrier:string,language:string,verbatim:string>>>>"
CHECKLISTS = "cases array<struct<id:string,checklist:array<struct<id:string,dimension:string,question_en:string>>>>"
SUITE = "suite string, case_count bigint, checklist_count_per_case bigint, cases array<struct<case_id:string,family:string,checklist:array<struct<id:string,category:string,question_en:string,expected_answer:string>>>>"
ANSWER_ITEMS = "array<struct<id:string,category:string,dimension:string,question_en:string,answer:string,expected_answer:string>>"


def read_cases(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Cases (id, prompt_en, required_text) of one or more ``{"cases": [...]}`` files."""
    out = spark.read.schema(CASES).option("multiLine", True).json(path).selectExpr("inline(cases)")
    if check:
        if out.isEmpty():
            raise ValueError("no cases")
        require_none(case_faults(out).where("size(errors) > 0").select("id", "errors"), "cases")
    return out


def read_checklists(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Checklists (id, checklist) of ``{"cases": [...]}`` files."""
    out = spark.read.schema(CHECKLISTS).option("multiLine", True).json(path).selectExpr("inline(cases)")
    if check:
        require_none(checklist_faults(out).where("size(errors) > 0").select("id", "errors"), "checklists")
    return out


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """The older suite form as (id, family, checklist): its category is the dimension."""
    raw = spark.read.schema(SUITE).option("multiLine", True).json(path)
    out = raw.select("case_count", F.inline("cases"))
    require_none(raw.where("case_count IS DISTINCT FROM size(array_distinct(transform(cases, c -> c.case_id)))").select("case_count"), "case_count")
    require_none(out.groupBy("case_id").count().where("count > 1 OR case_id IS NULL"), "case_id twice")
    items = F.transform("checklist", lambda i: F.struct(i["id"].alias("id"), i["category"].alias("dimension"), i["question_en"].alias("question_en"), F.coalesce(i["expected_answer"], F.lit("yes")).alias("expected_answer")))
    out = out.select(F.col("case_id").alias("id"), "family", items.alias("checklist"))
    require_none(checklist_faults(out).where("array_contains(errors, 'item_ids')").select("id"), "checklists")
    return out


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, prompt_en, ordinal) of a CSV (with or without a byte order mark),
    JSON lines or JSON file; the id is ``global_id`` or else ``id``."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    elif kind == "jsonl":
        raw = spark.read.json(path)
    else:
        raw = spark.read.option("multiLine", True).json(path)
        if "cases" in raw.columns:
            raw = raw.selectExpr("inline(cases)")
    raw = raw.withColumn("ordinal", F.monotonically_increasing_id())
    ids = [F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in ("global_id", "id") if c in raw.columns]
    prompt = F.col("prompt_en") if "prompt_en" in raw.columns else F.lit(None).cast("string")
    return raw.select((F.coalesce(*ids) if ids else F.lit(None).cast("string")).alias("case_id"), prompt.alias("prompt_en"), "ordinal")


def prompt_of(prompts: DataFrame, case_id: str) -> str:
    """The first prompt of an id."""
    row = prompts.where(F.col("case_id") == case_id).orderBy("ordinal").first()
    if row is None:
        raise KeyError(case_id)
    return row.prompt_en


def case_ids(prompts: DataFrame) -> DataFrame:
    """Ids in file order; blank and repeated ids are errors."""
    require_none(prompts.where("case_id IS NULL"), "rows without an id")
    require_none(prompts.groupBy("case_id").count().where("count > 1"), "ids twice")
    return prompts.select("case_id", "ordinal")


def read_videos(spark: SparkSession, root: str, profile: str | None = None) -> DataFrame:
    """(case_id, path, length, modificationTime) of the .mp4 files directly in a folder.

    With ``profile`` the layout is ``<root>/<case>/seed42.mp4`` and a profile column
    is added.  File contents are never read.
    """
    glob = f"{root}/*/seed42.mp4" if profile else root if root.lower().endswith(".mp4") else f"{root}/*.[mM][pP]4"
    files = spark.read.format("binaryFile").load(glob).drop("content")
    pattern = r"/([^/]+)/seed42\.mp4$" if profile else r"/([^/]+)\.[mM][pP]4$"
    out = files.withColumn("case_id", F.regexp_extract("path", pattern, 1))
    return (out.withColumn("profile", F.lit(profile)) if profile else out).select(*(["profile"] if profile else []), "case_id", "path", "length", "modificationTime")


def videos_inside(videos: DataFrame, root: str) -> DataFrame:
    """The videos, if none is a link that leads out of the folder ``root``; one file given
    as the root may lie anywhere."""
    if not root.lower().endswith(".mp4"):
        require_none(outside(videos, root).select("path", "real"), "links that lead out of the folder")
    return videos


def _keyed_by_folder(df: DataFrame) -> DataFrame:
    path = F.col("_metadata.file_path")
    return df.withColumns({"profile": F.regexp_extract(path, r"/([^/]+)/[^/]+/[^/]+$", 1), "case_id": F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)})


def read_statuses(spark: SparkSession, root: str) -> DataFrame:
    """(profile, case_id, status, selected_round) of ``*/*/case_status.json`` files."""
    raw = spark.read.schema("status string, selected_round int, selected_attempt int").option("multiLine", True).json(f"{root}/*/*/case_status.json")
    return _keyed_by_folder(raw).select("profile", "case_id", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("selected_round", "selected_attempt").alias("selected_round"))


def read_checklist_results(spark: SparkSession, root: str) -> DataFrame:
    """(profile, case_id, items) of ``*/*/result.json``; identities must agree with folders."""
    raw = spark.read.schema(f"profile string, case_id string, items {ANSWER_ITEMS}").option("multiLine", True).json(f"{root}/*/*/result.json")
    own = _keyed_by_folder(raw.withColumnsRenamed({"profile": "p", "case_id": "c"}))
    require_none(own.where("NOT (p <=> profile AND c <=> case_id)").select("profile", "case_id"), "result identity")
    return own.select("profile", "case_id", "items")


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    """(profile, case_id, items) of ``*/*/score.json``."""
    raw = spark.read.schema("items array<struct<text_id:string,reference:string,hypothesis:string>>").option("multiLine", True).json(f"{root}/*/*/score.json")
    return _keyed_by_folder(raw).select("profile", "case_id", "items")


def read_attempt_log(spark: SparkSession, root: str) -> DataFrame:
    """(case_id, attempt, finish_reason, output_token_count) of ``*/round_*/response.json``."""
    raw = spark.read.schema("raw string, finish_reason string, output_token_count int").option("multiLine", True).json(f"{root}/*/round_*/response.json")
    path = F.col("_metadata.file_path")
    return raw.select(F.regexp_extract(path, r"/([^/]+)/round_\d+/[^/]+$", 1).alias("case_id"), F.regexp_extract(path, r"/round_(\d+)/", 1).cast("int").alias("attempt"), "raw", "finish_reason", "output_token_count")


def read_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(name, size, hash) of a folder's files; weights are listed by name and size alone.

    Files are listed without their content and hashed as streams, so they may have any
    size."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "length")
    return hashed(listed).select(F.regexp_extract("path", r"/([^/]+)$", 1).alias("name"), "size", F.col("sha256").alias("hash"))


def read_weights(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(root).drop("content")
    return files.select(F.regexp_extract("path", r"/([^/]+)$", 1).alias("name"), F.col("length").alias("size"), F.lit("").alias("hash"))


def parse_probe(probe) -> object:
    """Width, height, frames, rate and duration from a probe's JSON column."""
    schema = "struct<streams:array<struct<codec_type:string,width:int,height:int,nb_frames:string,nb_read_frames:string,avg_frame_rate:string,duration:string>>,format:struct<duration:string>>"
    parsed = F.from_json(probe, schema)
    video = F.filter(parsed["streams"], lambda s: F.coalesce(s["codec_type"], F.lit("video")) == "video")[0]
    from textgauge.operators.validation import frame_rate

    return F.struct(
        video["width"].alias("width"),
        video["height"].alias("height"),
        F.coalesce(video["nb_read_frames"].try_cast("int"), video["nb_frames"].try_cast("int")).alias("frames"),
        frame_rate(video["avg_frame_rate"]).alias("rate"),
        F.coalesce(parsed["format"]["duration"].try_cast("double"), video["duration"].try_cast("double")).alias("duration"),
    )
