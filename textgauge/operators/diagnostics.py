"""Diagnostics of a response: repetition by field, limits, and the older online score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.functions.answers import TEXT_LIMIT
from textgauge.functions.text import legacy_values, repetition_details, repetition_warnings
from textgauge.operators import scoring


def exhausted(finish_reason: Column, used: Column, most: Column | int) -> Column:
    """Whether a response ended because its tokens ran out."""
    return F.coalesce((finish_reason == "length") & (used >= most), F.lit(False))


def response_diagnostics(read: DataFrame, raw: str = "raw", most: int = 2048) -> DataFrame:
    """One row for each response: limits, number of suspicious fields, and for a
    response that was not parsed the warnings of its raw text."""
    fields = F.flatten(F.transform("answer", lambda a: F.array(a["text"], a["readability_note"])))
    warned = F.size(F.filter(F.transform(fields, repetition_warnings), lambda w: F.size(w) > 0))
    return read.select(
        *[c for c in ("profile", "case_id", "attempt") if c in read.columns],
        F.col("parsed").alias("raw_json_parseable"),
        exhausted(F.col("finish_reason"), F.col("output_token_count"), most).alias("max_tokens_exhausted"),
        F.when(F.col("parsed"), warned).otherwise(F.lit(0)).alias("parsed_field_warning_count"),
        F.when(~F.col("parsed"), repetition_warnings(F.col(raw))).alias("unparsed_warnings"),
        F.when(~F.col("parsed"), repetition_details(F.col(raw))).alias("unparsed_details"),
        F.exists("answer", lambda a: F.length(a["text"]) == TEXT_LIMIT).alias("reached_text_character_limit"),
    )


def legacy_scores(pairs: DataFrame, keys: tuple[str, ...] = ("profile", "case_id")) -> DataFrame:
    """The older online score: the older tokens, the hypothesis cut to the reference's length."""
    tokened = pairs.withColumns({"reference": legacy_values("reference"), "hypothesis": legacy_values(F.coalesce("hypothesis", F.lit("")))})
    return scoring.score_cases(scoring.score_pairs(tokened, 0, tokenized=True), keys)


#: Least and most characters that a status leaves to the text and to the note (None: any number).
BOUNDS = {
    "carrier_not_found": {"text": (0, 0), "readability_note": (0, 0)},
    "text_unreadable": {"text": (0, 0), "readability_note": (1, None)},
    "transcribed": {"text": (1, TEXT_LIMIT), "readability_note": (0, None)},
}


def _closed(properties: dict) -> dict:
    """An object with exactly these properties."""
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def _sized(low: int, high: int | None) -> dict:
    return {"type": "string", "minLength": low, **({} if high is None else {"maxLength": high})}


def answer_schema(ids: list[str]) -> dict:
    """A JSON schema of a transcription answer, for audits: every id has one of the
    forms that ``BOUNDS`` allows."""
    forms = [_closed({"status": {"type": "string", "enum": [status]}} | {name: _sized(*size) for name, size in sizes.items()}) for status, sizes in BOUNDS.items()]
    return _closed(dict.fromkeys(ids, {"oneOf": forms}))


def validation_summary(cases: DataFrame, checklists: DataFrame) -> DataFrame:
    """Cases, items and text blocks that a run would have."""
    c = cases.select(F.lit(1).alias("cases"), F.size("required_text").alias("text_blocks"), F.lit(0).alias("checklist_items"))
    k = checklists.select(F.lit(0).alias("cases"), F.lit(0).alias("text_blocks"), F.size("checklist").alias("checklist_items"))
    return c.unionByName(k).agg(*[F.sum(n).alias(n) for n in c.columns])


def worker_status(assigned: DataFrame) -> DataFrame:
    """Counts of a batch worker's cases by state: assigned has case_id and state."""
    n = lambda s: F.count_if(F.col("state") == s)
    return assigned.groupBy("worker").agg(F.count(F.lit(1)).alias("assigned"), n("completed").alias("completed"), n("failed").alias("failed"), F.max(F.when(F.col("state") == "running", F.col("case_id"))).alias("current"))
