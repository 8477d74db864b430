"""SQL names of the engine's own functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udf, udtf

from textgauge.functions.alignment import COUNTS, edit_counts_of
from textgauge.functions.answers import read_transcription
from textgauge.functions.tokenizer import legacy_tokens, tokenize


class _AnswerRows:
    """``SELECT * FROM explode_answer(raw, ids)``: a row for each target of a response."""

    def eval(self, raw: str, ids: list):
        for place, (i, status, text, note) in enumerate(read_transcription(raw, list(ids or []), None)["answer"] or []):
            yield place, i, status, text, note


def register(spark: SparkSession) -> list[str]:
    """Register text_tokens, text_token_kinds, legacy_text_tokens, edit_counts and explode_answer."""
    struct = "struct<" + COUNTS.replace(" int", ":int") + ">"
    spark.udf.register("text_tokens", udf(lambda t: [x.value for x in tokenize(t)], "array<string>", useArrow=True))
    spark.udf.register("text_token_kinds", udf(lambda t: [x.kind for x in tokenize(t)], "array<string>", useArrow=True))
    spark.udf.register("legacy_text_tokens", udf(legacy_tokens, "array<string>", useArrow=True))
    spark.udf.register("edit_counts", arrow_udf(edit_counts_of, struct))
    spark.udtf.register("explode_answer", udtf(_AnswerRows, returnType="place int, text_id string, status string, text string, readability_note string"))
    return ["text_tokens", "text_token_kinds", "legacy_text_tokens", "edit_counts", "explode_answer"]
