"""Replay of logged agent runs: budgets, candidate states, ranking and rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgauge.operators.tools import CONSERVATIVE_MOTION
from textgauge.operators.validation import media_ok

# Limits of a run, and what a turn and each tool cost.
LIMITS = {"actions": 20, "api_calls": 30, "videos": 3}
COSTS = {
    "central_turn": (0, 1, 0),
    "generate_keyframes": (1, 1, 0),
    "inspect_keyframes": (1, 1, 0),
    "edit_keyframe": (1, 1, 0),
    "generate_video": (1, 1, 1),
    "inspect_video": (1, 1, 0),
    "extract_frames": (1, 0, 0),
    "compare_candidates": (1, 1, 0),
    "finalize_candidate": (1, 0, 0),
}


def charged(calls: DataFrame, costs: dict[str, tuple[int, int, int]] = COSTS, limits: dict[str, int] = LIMITS, key: str = "case_id", order: str = "seq") -> DataFrame:
    """Running budget use of each call, and the limit it would break, if any.

    Limits are asked in the order actions, API calls, videos.  Failed calls are
    charged too.  Unknown tools cost nothing.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    table = F.create_map(*[F.lit(x) if i == 0 else F.array(*map(F.lit, x)) for kv in costs.items() for i, x in enumerate(kv)])
    cost = F.coalesce(table[F.col("tool_name")], F.array(F.lit(0), F.lit(0), F.lit(0)))
    out = calls.withColumn("__c", cost)
    for k, name in enumerate(limits):
        out = out.withColumn(f"used_{name}", F.sum(F.col("__c")[k]).over(w))
    broken = F.lit(None).cast("string")
    for k, name in reversed(list(enumerate(limits))):
        broken = F.when((F.col(f"used_{name}") > limits[name]) & (F.col("__c")[k] > 0), F.lit(name)).otherwise(broken)
    return out.withColumn("exceeds", broken).drop("__c")


def first_violation(calls: DataFrame, key: str = "case_id", order: str = "seq", **how) -> DataFrame:
    """The first call of each run that its budget does not allow."""
    out = charged(calls, key=key, order=order, **how).where("exceeds IS NOT NULL")
    return out.groupBy(key).agg(F.min(F.struct(order, "tool_name", "exceeds")).alias("v")).select(key, f"v.{order}", "v.tool_name", "v.exceeds")


#: Why a run is rescued.
EXHAUSTED = {"actions": "action budget exhausted", "api_calls": "API-call budget exhausted", "videos": "video-generation budget exhausted"}
NO_CALL = "Central agent returned no tool call"


def replayed(calls: DataFrame, costs: dict[str, tuple[int, int, int]] = COSTS, limits: dict[str, int] = LIMITS, key: str = "case_id", order: str = "seq") -> DataFrame:
    """Logged runs replayed to their last state: a row for each run.

    Calls (``tool_name``, ``status``) are charged in order until a budget refuses
    one, which is neither charged nor executed, or a finalisation is complete.
    Returns calls executed, use and remainder of each budget, ``completed`` and
    ``rescue_reason``: the refusal, or that a turn ended the log without a call;
    null for runs that are complete or can be resumed.
    """
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    done = (F.col("tool_name") == "finalize_candidate") & (F.col("status") == "complete")
    rows = charged(calls, costs, limits, key, order)
    # what stands after a refusal or a completion was never run
    ended = F.coalesce(F.count_if(F.col("exceeds").isNotNull() | done).over(earlier), F.lit(0))
    rows = rows.withColumn("__before", ended).where("__before = 0")
    ran = F.col("exceeds").isNull()
    uses = [F.coalesce(F.max(F.when(ran, F.col(f"used_{n}"))), F.lit(0)).alias(f"used_{n}") for n in limits]
    out = rows.groupBy(key).agg(
        F.count_if(ran & (F.col("tool_name") != "central_turn")).alias("calls"),
        *uses,
        F.max(ran & done).alias("completed"),
        F.max_by("exceeds", order).alias("__refusal"),
        F.max_by("tool_name", order).alias("__last"),
    )
    told = F.create_map(*[F.lit(x) for kv in EXHAUSTED.items() for x in kv])
    reason = F.when(F.col("__refusal").isNotNull(), told[F.col("__refusal")]).when(~F.col("completed") & (F.col("__last") == "central_turn"), F.lit(NO_CALL))
    left = {f"remaining_{n}": remaining(F.col(f"used_{n}"), limits[n]) for n in limits}
    return out.withColumns({**left, "rescue_reason": reason}).drop("__refusal", "__last")


def remaining(used, limit: int):
    return F.greatest(F.lit(0), F.lit(limit) - used)


def recovered(calls: DataFrame) -> DataFrame:
    """Calls that were running when a run was cut off have failed."""
    return calls.withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))


def orphans(candidates: DataFrame) -> DataFrame:
    """Candidates whose parent does not exist in their case."""
    ids = candidates.select("case_id", F.col("candidate_id").alias("parent_id"))
    return candidates.where("parent_id IS NOT NULL").join(ids, ["case_id", "parent_id"], "left_anti")


def next_ids(candidates: DataFrame, key: str = "case_id") -> DataFrame:
    """The next id of each kind (img-0001, vid-0001 where there is none yet); ids of another
    form count for nothing."""
    highest = lambda p: F.coalesce(F.max(F.regexp_extract("candidate_id", rf"^{p}-(\d+)$", 1).try_cast("bigint")), F.lit(0))
    return candidates.groupBy(key).agg(*[F.format_string(f"{p}-%04d", highest(p) + 1).alias(f"next_{k}") for k, p in (("image", "img"), ("video", "vid"))])


def latest_preference(calls: DataFrame, eligible: DataFrame, key: str = "case_id", order: str = "seq") -> DataFrame:
    """The newest completed comparison's preferred eligible candidate, or the first
    eligible one of its ranking, or else that of an older comparison."""
    listed = calls.where("status = 'complete'").select(key, order, F.posexplode(F.concat(F.array("preferred_candidate_id"), F.coalesce("ranking", F.array().cast("array<string>")))).alias("pos", "candidate_id"))
    fit = listed.join(eligible.select(key, "candidate_id"), [key, "candidate_id"], "left_semi")
    best = fit.groupBy(key).agg(F.min(F.struct((-F.col(order)).alias("o"), "pos", "candidate_id")).alias("b"))
    return best.select(key, F.col("b.candidate_id").alias("candidate_id"))


def severity_scores(candidates: DataFrame, observations: DataFrame, keys: tuple[str, str] = ("case_id", "candidate_id")) -> DataFrame:
    """Mean, worst and number of a candidate's severities; unobserved ranks last."""
    own = observations.groupBy(*keys).agg(F.avg("severity").alias("mean_severity"), F.max("severity").alias("worst"), F.count(F.lit(1)).alias("observations"))
    return candidates.join(own, list(keys), "left").withColumns({"mean_severity": F.coalesce("mean_severity", F.lit(10.0)), "worst": F.coalesce("worst", F.lit(3)), "observations": F.coalesce("observations", F.lit(0))})


def least_severe(scored: DataFrame, key: str = "case_id") -> DataFrame:
    """By mean, worst, most observations, then id."""
    order = F.struct("mean_severity", "worst", (-F.col("observations")).alias("fewer"), "candidate_id")
    return scored.groupBy(key).agg(F.min(order).alias("b")).select(key, F.col("b.candidate_id").alias("candidate_id"))


def rescue(candidates: DataFrame, observations: DataFrame, calls: DataFrame, media: DataFrame | None = None, kind: str = "video") -> DataFrame:
    """The candidate a run falls back on: active, sound, preferred or least severe."""
    fit = candidates.where((F.col("kind") == kind) & (F.col("status") == "active"))
    if media is not None:
        sound = media.where(media_ok(F.col("frames"), F.col("rate"), F.col("duration"))).select("case_id", "candidate_id")
        fit = fit.join(sound, ["case_id", "candidate_id"], "left_semi")
    liked = latest_preference(calls, fit).withColumnRenamed("candidate_id", "preferred")
    mild = least_severe(severity_scores(fit, observations)).withColumnRenamed("candidate_id", "mildest")
    return mild.join(liked, "case_id", "left").select("case_id", F.coalesce("preferred", "mildest").alias("candidate_id"), F.when(F.col("preferred").isNotNull(), "preference").otherwise("severity").alias("chosen_by"))


def rescue_plans(candidates: DataFrame, observations: DataFrame, calls: DataFrame, media: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """How each run is rescued: ``start`` is video, image or prompt (what there is to
    begin with), ``candidate_id`` the one chosen, and ``rolled_back`` the other
    active videos.  A run that starts from an image or the prompt makes its video first.

    ``runs`` has the ``case_id`` of every run to rescue, those without any candidate too;
    by default the runs are those that candidates and calls name."""
    runs = candidates.select("case_id").union(calls.select("case_id")).distinct() if runs is None else runs.select("case_id").distinct()
    best = {k: rescue(candidates, observations, calls, media if k == "video" else None, k).select("case_id", F.col("candidate_id").alias(k)) for k in ("video", "image")}
    out = runs.join(best["video"], "case_id", "left").join(best["image"], "case_id", "left")
    start = F.when(F.col("video").isNotNull(), "video").when(F.col("image").isNotNull(), "image").otherwise("prompt")
    active = candidates.where("kind = 'video' AND status = 'active'").groupBy("case_id").agg(F.sort_array(F.collect_list("candidate_id")).alias("active"))
    out = out.select("case_id", start.alias("start"), F.coalesce("video", "image").alias("candidate_id"), "video").join(active, "case_id", "left")
    others = F.filter(F.coalesce("active", F.array().cast("array<string>")), lambda c: ~c.eqNullSafe(F.col("video")))
    return out.select("case_id", "start", "candidate_id", others.alias("rolled_back"))


# What a rescue's calls say.
RESCUE_DIAGNOSIS, RESCUE_FINAL_DIAGNOSIS = "Guaranteed-delivery rescue: ", "Deterministic guaranteed-delivery finalization: "
RESCUE_NEGATIVE = "blurred text, distorted letters, illegible print"
RESCUE_RATIONALE = (
    "Agentic exploration could not terminate within its guardrail. Selected the best valid active historical video using explicit comparison preference when available, otherwise the lowest "
    "observed-severity score."
)


def rescue_calls(plans: DataFrame, runs: DataFrame) -> DataFrame:
    """The calls that carry plans out: case_id, step, tool_name, arguments (JSON).

    ``runs`` has case_id, ``prompt_en`` and ``rescue_reason``.  A run without any candidate
    makes a key frame and then a video, one with an image its video; both take the ids
    that the calls before them return, which are null here.  Every run is finalised,
    and its other active videos are rolled back with that."""
    p = plans.join(runs.select("case_id", "prompt_en", "rescue_reason"), "case_id")
    why = F.coalesce("rescue_reason", F.lit(""))
    none, no = F.array().cast("array<string>"), F.lit(None).cast("string")
    from_video, from_image = F.col("start") == "video", F.col("start") == "image"

    def call(step: int, tool: str, wanted: Column, **arguments: Column) -> Column:
        told = F.to_json(F.struct(*[v.alias(k) for k, v in arguments.items()]), {"ignoreNullFields": "false"})
        return F.when(wanted, F.struct(F.lit(step).alias("step"), F.lit(tool).alias("tool_name"), told.alias("arguments")))

    begun = F.concat(F.lit(RESCUE_DIAGNOSIS), why)
    key_frame = call(0, "generate_keyframes", ~from_video & ~from_image, diagnosis=begun, generation_prompt=F.col("prompt_en"), negative_prompt=F.lit(RESCUE_NEGATIVE), count=F.lit(1), vary=none, parent_id=no, rollback_candidate_ids=none)
    video = call(1, "generate_video", ~from_video, diagnosis=begun, keyframe_id=F.when(from_image, F.col("candidate_id")), motion_refinement=F.lit(CONSERVATIVE_MOTION), parent_video_id=no, rollback_candidate_ids=none)
    final = call(2, "finalize_candidate", F.lit(True), diagnosis=F.concat(F.lit(RESCUE_FINAL_DIAGNOSIS), why), candidate_id=F.when(from_video, F.col("candidate_id")), rationale=F.lit(RESCUE_RATIONALE), rollback_candidate_ids=F.col("rolled_back"))
    return p.select("case_id", F.inline(F.array_compact(F.array(key_frame, video, final))))


def rescued(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Candidates with their ``status`` after the rescue of their runs: the chosen video
    is finalized, every other active one rolled back; all else stays."""
    chosen = plans.select("case_id", F.when(F.col("start") == "video", F.col("candidate_id")).alias("__final"), F.lit(True).alias("__planned"))
    own = (F.col("kind") == "video") & (F.col("status") == "active") & F.col("__planned")
    status = F.when(F.col("candidate_id") == F.col("__final"), "finalized").when(own, "rolled_back").otherwise(F.col("status"))
    return candidates.join(chosen, "case_id", "left").withColumn("status", status).select(*candidates.columns)


def recent(observations, n: int = 8):
    """The last ``n`` of an array."""
    return F.slice(observations, F.greatest(F.lit(1), F.size(observations) - (n - 1)), F.lit(n))


def contexts(workflow: DataFrame, candidates: DataFrame) -> DataFrame:
    """Compact JSON context of each run: candidates in order with recent observations."""
    one = F.struct("seq", "candidate_id", "kind", "status", "parent_id", recent(F.col("observations")).alias("observations"))
    listed = candidates.groupBy("case_id").agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    return workflow.join(listed, "case_id", "left").select("case_id", F.to_json(F.struct("case_id", "prompt_en", "candidates")).alias("context"))


def results(workflow: DataFrame, states: DataFrame) -> DataFrame:
    """Final selection of each run."""
    done = states.where("state = 'finalized'").groupBy("case_id").agg(F.min("candidate_id").alias("final_candidate_id"))
    return workflow.join(done, "case_id", "left").withColumn("completed", F.col("final_candidate_id").isNotNull())
