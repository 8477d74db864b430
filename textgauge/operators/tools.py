"""Tool calls as rows: argument checks, costs and effects on the candidate log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.operators.validation import blank, faults, positions_ok

#: Fields that a tool's arguments may have; every tool has a diagnosis.
FIELDS = {
    "generate_keyframes": ("generation_prompt", "negative_prompt", "count", "vary", "parent_id", "rollback_candidate_ids"),
    "inspect_keyframes": ("candidate_ids",),
    "edit_keyframe": ("candidate_id", "edit_instruction", "region_description", "rollback_candidate_ids"),
    "generate_video": ("keyframe_id", "motion_refinement", "parent_video_id", "rollback_candidate_ids"),
    "inspect_video": ("candidate_id", "sample_fps"),
    "extract_frames": ("candidate_id", "positions_seconds"),
    "compare_candidates": ("candidate_ids", "focus"),
    "finalize_candidate": ("candidate_id", "rationale", "rollback_candidate_ids"),
}
VARY = ("composition", "typography", "carrier_placement", "visual_treatment")
ARGUMENTS = (
    "diagnosis string, generation_prompt string, negative_prompt string, count int, vary array<string>, parent_id string, rollback_candidate_ids array<string>, candidate_ids array<string>, "
    "candidate_id string, edit_instruction string, region_description string, keyframe_id string, motion_refinement string, parent_video_id string, sample_fps double, positions_seconds array<double>, focus string, rationale string"
)
# Fixed value: what a video is told when a run has to be rescued from an image.
CONSERVATIVE_MOTION = (
    "Animate the depicted scene with restrained, physically coherent motion. Preserve every visible text string, typography, text-bearing surface, object identity, layout, and camera "
    "framing from the conditioning image. Keep printed surfaces readable and stable; avoid warping, occlusion, cropping, rotation away from camera, or newly invented text."
)


def _between(values: Column, low: int, high: int) -> Column:
    return F.coalesce(F.size(values).between(low, high), F.lit(False))


def argument_faults(calls: DataFrame) -> DataFrame:
    """``errors`` of each call's JSON ``arguments`` under its ``tool_name``."""
    a = F.from_json("arguments", ARGUMENTS)
    tool = F.col("tool_name")
    allowed = F.create_map(*[x for name, fields in FIELDS.items() for x in (F.lit(name), F.array(*map(F.lit, ("diagnosis", *fields))))])
    keys = F.json_object_keys("arguments")
    out = calls.withColumn("__a", a)
    a = F.col("__a")
    is_ = lambda *names: tool.isin(*names)
    return out.withColumn(
        "errors",
        faults(
            (~F.coalesce(tool.isin(*FIELDS), F.lit(False)), "tool"),
            (keys.isNull(), "not_an_object"),
            (F.size(F.array_except(keys, allowed[tool])) > 0, "unknown_field"),
            (F.coalesce(a["diagnosis"], F.lit("")) == "", "diagnosis"),
            (is_("generate_keyframes") & (F.coalesce(a["generation_prompt"], F.lit("")) == ""), "generation_prompt"),
            (is_("generate_keyframes") & ~F.coalesce(a["count"], F.lit(1)).between(1, 4), "count"),
            (is_("generate_keyframes") & (F.size(F.array_except(F.coalesce(a["vary"], F.array().cast("array<string>")), F.array(*map(F.lit, VARY)))) > 0), "vary"),
            (is_("inspect_keyframes") & ~_between(a["candidate_ids"], 1, 4), "candidate_ids"),
            (is_("compare_candidates") & ~_between(a["candidate_ids"], 2, 6), "candidate_ids"),
            (is_("edit_keyframe", "inspect_video", "extract_frames", "finalize_candidate") & a["candidate_id"].isNull(), "candidate_id"),
            (is_("edit_keyframe") & (F.coalesce(a["edit_instruction"], F.lit("")) == ""), "edit_instruction"),
            (is_("generate_video") & a["keyframe_id"].isNull(), "keyframe_id"),
            (is_("generate_video") & blank(a["motion_refinement"]), "motion_refinement"),
            (is_("inspect_video") & ~((F.coalesce(a["sample_fps"], F.lit(1.0)) > 0) & (F.coalesce(a["sample_fps"], F.lit(1.0)) <= 2)), "sample_fps"),
            (is_("extract_frames") & ~F.coalesce(positions_ok(a["positions_seconds"]), F.lit(False)), "positions_seconds"),
            (is_("finalize_candidate") & (F.coalesce(a["rationale"], F.lit("")) == ""), "rationale"),
            (F.size(F.array_distinct(a["rollback_candidate_ids"])) != F.size(a["rollback_candidate_ids"]), "rollback_repeated"),
            (is_("finalize_candidate") & F.array_contains(a["rollback_candidate_ids"], a["candidate_id"]), "rollback_of_final"),
        ),
    ).drop("__a")


def unknown_rollbacks(calls: DataFrame, candidates: DataFrame) -> DataFrame:
    """Ids that a call rolls back and its case does not have."""
    ids = calls.select("case_id", "seq", F.explode(F.from_json("arguments", ARGUMENTS)["rollback_candidate_ids"]).alias("candidate_id"))
    return ids.join(candidates.select("case_id", "candidate_id"), ["case_id", "candidate_id"], "left_anti")


def attached_observations(calls: DataFrame) -> DataFrame:
    """Observations by candidate: an inspection's observations go to every candidate it
    looked at; a comparison's go to none.  ``result`` holds them as JSON."""
    a = F.from_json("arguments", ARGUMENTS)
    seen = F.from_json("result", "observations array<struct<category:string,summary:string,severity:string,evidence_locations:array<string>>>")["observations"]
    looked = F.when(F.col("tool_name") == "inspect_keyframes", a["candidate_ids"]).when(F.col("tool_name") == "inspect_video", F.array(a["candidate_id"]))
    each = calls.where("status = 'complete'").select("case_id", "seq", F.explode(looked).alias("candidate_id"), seen.alias("o"))
    return each.select("case_id", "seq", "candidate_id", F.posexplode("o").alias("place", "o")).select("case_id", "seq", "candidate_id", "place", "o.*")


def call_effects(calls: DataFrame) -> DataFrame:
    """What completed calls do to the candidates, as an event log.

    Rows are (case_id, seq, place, event, candidate_id, kind, parent_id), in the
    order of ``seq`` and ``place``.  Generating and editing add the ids of the
    ``result``; the parent is the argument's, a video's its parent video or else its
    keyframe.  An inspection observes, a comparison prefers its preferred id, a
    finalisation finalizes; extracted frames change nothing.  Roll-backs come last.
    """
    a = F.from_json("arguments", ARGUMENTS)
    r = F.from_json("result", "candidate_ids array<string>, payload struct<preferred_candidate_id:string>")
    none = F.array().cast("array<struct<event:string,candidate_id:string,kind:string,parent_id:string>>")

    def events(name: str, ids: Column, kind: Column | None = None, parent: Column | None = None) -> Column:
        null = F.lit(None).cast("string")
        return F.transform(ids, lambda i: F.struct(F.lit(name).alias("event"), i.alias("candidate_id"), (null if kind is None else kind).alias("kind"), (null if parent is None else parent).alias("parent_id")))

    tool = F.col("tool_name")
    image, video = F.lit("image"), F.lit("video")
    given = lambda text: F.when(text != "", text)
    main = (
        F.when(tool == "generate_keyframes", events("add", r["candidate_ids"], image, given(a["parent_id"])))
        .when(tool == "edit_keyframe", events("add", r["candidate_ids"], image, a["candidate_id"]))
        .when(tool == "generate_video", events("add", r["candidate_ids"], video, F.coalesce(given(a["parent_video_id"]), a["keyframe_id"])))
        .when(tool == "inspect_keyframes", events("observe", a["candidate_ids"], image))
        .when(tool == "inspect_video", events("observe", F.array(a["candidate_id"]), video))
        .when(tool == "compare_candidates", events("prefer", F.array_compact(F.array(r["payload"]["preferred_candidate_id"]))))
        .when(tool == "finalize_candidate", events("finalize", F.array(a["candidate_id"]), video))
    )
    rolls = F.when(tool.isin("generate_keyframes", "edit_keyframe", "generate_video", "finalize_candidate"), events("rollback", a["rollback_candidate_ids"]))
    both = F.concat(F.coalesce(main, none), F.coalesce(rolls, none))
    each = calls.where("status = 'complete'").select("case_id", "seq", F.posexplode(both).alias("place", "e"))
    return each.select("case_id", "seq", "place", "e.*")


def inside(path: Column, root: Column | str) -> Column:
    """Whether a normal path lies under a root."""
    base = F.regexp_replace(root if isinstance(root, Column) else F.lit(root), r"/+$", "")
    return F.startswith(path, F.concat(base, F.lit("/"))) & ~path.rlike(r"(^|/)\.\.(/|$)")


def output_ok(path: Column, root: str) -> Column:
    return inside(path, root) & F.lower(path).endswith(".mp4")


def composed_prompt(original: Column, refinement: Column, headers: tuple[str, str, str]) -> Column:
    """Original prompt and refinement under their headers, the precedence rule last."""
    first, second, rule = headers
    return F.concat(F.lit(f"{first}\n"), original, F.lit(f"\n\n{second}\n"), refinement, F.lit(f"\n\n{rule}"))


def trimmed_audio(samples: Column, rate: int, fps: int = 24, frames: int = 240) -> Column:
    """A channel's samples without the first frame's, as long as the video."""
    return F.slice(samples, round(rate / fps) + 1, round(frames / fps * rate))


def trimmed_frames(frames: Column, requested: int = 241) -> Column:
    """Delivered frames: all but the conditioning frame; null where too few came."""
    return F.when(F.size(frames) >= requested, F.slice(frames, 2, requested - 1))
