"""Whole evaluations as one plan each: responses to reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textgauge.functions.answers import checklist, transcription
from textgauge.functions.text import first_tokens, repetition_warnings, token_values
from textgauge.operators.attempts import MAX_ATTEMPTS, selected_attempts
from textgauge.operators.scoring import N_SETTINGS, SCORED_CHECKLIST, SCORED_WER, balanced_wer, dimension_scores, scene, score_cases, score_pairs, score_prefixes, status_report, video_score
from textgauge.sources.layout import spread_rows
from textgauge.sources.sinks import checkpointed


def read_transcriptions(responses: DataFrame, targets: DataFrame) -> DataFrame:
    """Responses with what was read of them; targets give each case its ids in order."""
    ids = targets.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text_id"))), lambda t: t["text_id"]).alias("ids"))
    read = spread_rows(responses).join(ids, "case_id").withColumn("r", transcription("raw", "ids", "finish_reason"))
    return read.select("profile", "case_id", "attempt", "finish_reason", "output_token_count", "r.*").withColumn("passed", F.col("parsed") & (F.size("errors") == 0))


def read_checklists(responses: DataFrame) -> DataFrame:
    read = responses.withColumn("r", checklist("raw"))
    return read.select("profile", "case_id", "attempt", "finish_reason", "output_token_count", "r.*").withColumn("passed", F.size("errors") == 0)


def field_warnings(read: DataFrame) -> DataFrame:
    """Repetition warnings of parsed texts and notes, a row for each suspicious field."""
    fields = read.where("parsed").select("profile", "case_id", "attempt", F.explode("answer").alias("a"))
    fields = fields.select("profile", "case_id", "attempt", F.col("a.id").alias("text_id"), F.explode(F.create_map(F.lit("text"), F.col("a.text"), F.lit("readability_note"), F.col("a.readability_note"))).alias("field", "value"))
    return fields.withColumn("warnings", repetition_warnings(F.col("value"))).where("size(warnings) > 0").drop("value")


def said_tokens(read: DataFrame, references: DataFrame, more: int) -> DataFrame:
    """Read responses as a row for each answer: profile, case_id, attempt, parsed, passed,
    place, text_id, hypothesis (null place for a response without any).

    ``hypothesis`` has ``more`` tokens than the reference at most; what was not
    transcribed has none.  References give each case its sizes, so they alone are grouped."""
    sizes = references.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("text_id", F.size("reference").alias("n")))).alias("sizes"))
    keys = ["profile", "case_id", "attempt", "parsed", "passed"]
    each = read.join(sizes, "case_id").select(*keys, "sizes", F.posexplode_outer("answer").alias("place", "a"))
    text = F.when(F.col("a.status") == "transcribed", F.col("a.text")).otherwise(F.lit(""))
    most = F.coalesce(F.col("sizes")[F.col("a.id")], F.lit(0)) + F.lit(more)
    return each.select(*keys, "place", F.col("a.id").alias("text_id"), first_tokens(text, most).alias("hypothesis"))


def score_settings(tokened: DataFrame, keys: list[str], settings: tuple[int, ...] = N_SETTINGS, counts: bool = False) -> DataFrame:
    """Case scores for every N from pairs of token arrays: each pair is multiplied
    after it was tokenized, so Python reads a text once for all N."""
    if not counts:
        return score_cases(score_prefixes(tokened, settings), [*keys, "n"])
    each = tokened.withColumn("n", F.explode(F.array(*map(F.lit, settings))))
    return score_cases(score_pairs(each, F.col("n"), tokenized=True), [*keys, "n"])


def wer_report(jobs: DataFrame, responses: DataFrame, targets: DataFrame, settings: tuple[int, ...] = N_SETTINGS, counts: bool = False, most: int = MAX_ATTEMPTS) -> dict[str, DataFrame]:
    """Transcription report: case scores for every N, roll-ups, statuses and unscored jobs.
    A job has ``most`` attempts.

    Responses are read once.  Of a transcribed text only the tokens that a score can
    count, and one more, are taken; these are written to the session's checkpoint
    folder, as the status and the scores both need them, so no text is written or moved.
    Without ``counts`` the scores hold distances only, which the JVM works out alone."""
    references = checkpointed(targets.select("case_id", "text_id", token_values("verbatim").alias("reference")))
    said = checkpointed(said_tokens(read_transcriptions(responses, targets), references, max(settings) + 1))
    status = selected_attempts(said.where("place IS NULL OR place = 0"), most=most)
    chosen = status.where(F.col("status").isin(*SCORED_WER)).select("profile", "case_id", F.col("selected_attempt").alias("attempt"))
    tokened = said.join(chosen, ["profile", "case_id", "attempt"]).join(references, ["case_id", "text_id"]).select("profile", "case_id", "text_id", "reference", "hypothesis")
    cases = score_settings(tokened, ["profile", "case_id"], settings, counts)
    cases = cases.withColumn("scene", scene(F.col("case_id")))
    counts, unscored = status_report(jobs.join(status, ["profile", "case_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending"))), SCORED_WER)
    return {"cases": cases, "summary": balanced_wer(cases, [("n",), ("n", "profile"), ("n", "scene")]), "status_counts": counts, "unscored": unscored}


def checklist_report(jobs: DataFrame, responses: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """Checklist report: items, pooled scores, dimensions, statuses and unscored jobs."""
    read = checkpointed(read_checklists(responses))
    status = selected_attempts(read, lenient=False)
    chosen = status.where(F.col("status").isin(*SCORED_CHECKLIST)).select("profile", "case_id", F.col("selected_attempt").alias("attempt"))
    items = read.join(chosen, ["profile", "case_id", "attempt"]).select("profile", "case_id", F.explode("decisions").alias("d"))
    items = items.select("profile", "case_id", F.col("d.id").alias("item_id"), "d.answer").join(questions.select("case_id", "item_id", "dimension"), ["case_id", "item_id"])
    items = items.withColumn("scene", scene(F.col("case_id")))
    counts, unscored = status_report(jobs.join(status, ["profile", "case_id"], "left").withColumn("status", F.coalesce("status", F.lit("pending"))), SCORED_CHECKLIST)
    return {"items": items, "summary": video_score(items), "dimensions": dimension_scores(items), "dimensions_by_profile": dimension_scores(items, ["profile"]), "status_counts": counts, "unscored": unscored}
