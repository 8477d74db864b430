"""Validation as columns: an array of fault codes for each row, empty when sound."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.functions.text import token_sizes

# Fixed values.
SCENES = ("AD", "SCI", "UI", "CULT", "LIFE")
DIMENSIONS = ("Entity Presence", "Spatial Relationship", "Temporal Consistency", "Motion Adherence", "Scene Attributes")
ITEM_IDS = tuple(f"C{k:02d}" for k in range(1, 21))
SEVERITIES = {"none": 0, "info": 0, "low": 1, "minor": 1, "medium": 2, "moderate": 2, "high": 3, "major": 3, "critical": 3}
_SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"


def faults(*checks: tuple[Column, str]) -> Column:
    """Codes of the checks that are true (null counts as false)."""
    return F.filter(F.array(*[F.when(wrong, F.lit(code)) for wrong, code in checks]), lambda c: c.isNotNull())


def require_none(df: DataFrame, what: str) -> None:
    """Raise unless ``df`` is empty; shows a few rows of what is wrong."""
    found = df.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def blank(text: Column) -> Column:
    return text.isNull() | (F.regexp_replace(text, _SPACE_CLASS, "") == "")


def case_id_ok(case_id: Column) -> Column:
    """A scene, a dash and four digits, and nothing after them."""
    return F.coalesce(case_id.rlike(rf"^(?:{'|'.join(SCENES)})-\p{{Nd}}{{4}}\z"), F.lit(False))


def profile_name_ok(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*\z"), F.lit(False))


def safe_name(name: Column) -> Column:
    """A path-safe form; null where nothing usable is left."""
    clean = F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_")
    return F.when(~clean.isin("", ".", ".."), clean)


def case_faults(cases: DataFrame, scored: bool = True) -> DataFrame:
    """``errors`` for rows (id, prompt_en, required_text): ids, prompts and targets.

    ``scored`` also asks that every target text has a token; that needs the
    tokenizer and is the only part that leaves the JVM."""
    r = F.col("required_text")
    ids = F.transform(r, lambda t: t["id"])
    checks = [
        (~case_id_ok(F.col("id")), "case_id"),
        (blank(F.col("prompt_en")), "prompt_blank"),
        (r.isNull() | (F.size(r) < 1), "no_targets"),
        (F.exists(r, lambda t: ~F.coalesce(t["id"].rlike(r"^T\p{Nd}{2,}\z"), F.lit(False))), "target_id"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "target_id_repeated"),
        (F.exists(r, lambda t: blank(t["carrier"]) | blank(t["language"]) | blank(t["verbatim"])), "target_field_blank"),
    ]
    out = cases
    if scored:
        out = out.withColumn("__n", token_sizes(F.transform(r, lambda t: t["verbatim"])))
        checks.append((F.exists("__n", lambda n: n == 0), "no_scored_token"))
    counted = out.withColumn("errors", faults(*checks)).drop("__n")
    twice = cases.groupBy("id").agg(F.count(F.lit(1)).alias("__k")).where("__k > 1").select("id", F.lit(True).alias("__twice"))
    joined = counted.join(twice, "id", "left")
    return joined.withColumn("errors", F.when(F.col("__twice"), F.array_append("errors", F.lit("case_id_repeated"))).otherwise(F.col("errors"))).drop("__twice")


def checklist_faults(checklists: DataFrame) -> DataFrame:
    """``errors`` for rows (id, checklist): twenty items in order, known dimensions, questions."""
    items = F.col("checklist")
    return checklists.withColumn(
        "errors",
        faults(
            (items.isNull() | ~F.transform(items, lambda i: i["id"]).eqNullSafe(F.array(*map(F.lit, ITEM_IDS))), "item_ids"),
            (F.exists(items, lambda i: ~F.coalesce(i["dimension"].isin(*DIMENSIONS), F.lit(False))), "dimension"),
            (F.exists(items, lambda i: blank(i["question_en"])), "question_blank"),
        ),
    )


def severity(value: Column) -> Column:
    """A label or number as 0..3; null where it is neither."""
    label = F.lower(F.trim(value.cast("string")))
    named = reduce(lambda c, kv: c.when(label == kv[0], F.lit(kv[1])), SEVERITIES.items(), F.when(F.lit(False), F.lit(None).cast("int")))
    number = value.cast("string").try_cast("int")
    return F.coalesce(named, F.when(number.between(0, 3), number))


def evidence(value: Column) -> Column:
    """Evidence locations from JSON: null gives none, a string itself, an array its
    items as text, an object its keys; null too where it is none of these."""
    own = F.trim(value)
    items = F.from_json(value, "array<string>")
    text = F.from_json(F.concat(F.lit('{"x":'), value, F.lit("}")), "x string")["x"]
    none = F.array().cast("array<string>")
    return (
        F.when(value.isNull() | (own == "null"), none)
        .when(F.startswith(own, F.lit('"')), F.array(text))
        .when(F.startswith(own, F.lit("[")), F.transform(items, lambda i: F.coalesce(i, F.lit("None"))))
        .when(F.startswith(own, F.lit("{")), F.json_object_keys(value))
    )


def token_usage(response: Column) -> Column:
    """Token counts of a service's JSON response: those of its ``usage`` that are there."""
    usage = F.from_json(response, "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")["usage"]
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    every = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[usage[n] for n in names]))
    return F.when(usage.isNull(), F.create_map().cast("map<string,bigint>")).otherwise(F.map_filter(every, lambda _, n: n.isNotNull()))


def clamped_severity(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(value, F.lit(0))))


def positions_ok(seconds: Column) -> Column:
    """One to twelve positions from 0 to 10 seconds."""
    return F.size(seconds).between(1, 12) & F.forall(seconds, lambda s: s.between(0, 10))


def media_ok(frames: Column, rate: Column, duration: Column, want_frames: int = 240, want_rate: float = 24.0) -> Column:
    return (frames == want_frames) & (F.abs(rate - want_rate) <= 0.01) & (F.abs(duration - want_frames / want_rate) <= 0.05)


def frame_rate(fraction: Column) -> Column:
    """A rate such as 24000/1001."""
    top, bottom = F.split_part(fraction, F.lit("/"), F.lit(1)), F.split_part(fraction, F.lit("/"), F.lit(2))
    return F.try_divide(top.try_cast("double"), F.coalesce(bottom.try_cast("double"), F.lit(1.0)))


#: Fixed value: most bytes of a service request's body.
REQUEST_BYTES = 1_000_000


def request_ok(seed: Column, requested: Column, delivered: Column, fps: Column, prompt: Column, body_bytes: Column | None = None) -> Column:
    """Whether a service accepts a request: its fixed fields, a motion prompt, and, where
    it is given, a body of 1 to ``REQUEST_BYTES`` bytes."""
    ok = (seed == 42) & (requested == 241) & (delivered == 240) & (fps == 24) & ~blank(prompt)
    return ok if body_bytes is None else ok & F.coalesce(body_bytes.between(1, REQUEST_BYTES), F.lit(False))
