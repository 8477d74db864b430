"""Scores and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.functions.alignment import bounded, capped, coded_pair, edit_counts_udf, token_distance
from textgauge.functions.text import token_values
from textgauge.operators.validation import DIMENSIONS

N_SETTINGS = (1, 5, 10)
SCORED_WER = ("pass", "pass_after_max_attempts")
SCORED_CHECKLIST = ("pass",)


def score_pairs(pairs: DataFrame, extra: int | Column, counts: bool = True, tokenized: bool = False) -> DataFrame:
    """Score (reference, hypothesis) texts with the hypothesis cut to R + ``extra`` tokens.

    With ``counts`` False only the distance is worked out, on the JVM alone.
    ``tokenized`` says that both are token arrays already; ``extra`` may be a column.
    """
    out = pairs
    if not tokenized:
        out = out.withColumns({"reference_tokens": token_values("reference"), "hypothesis_tokens": token_values(F.coalesce("hypothesis", F.lit("")))})
    else:
        out = out.withColumns({"reference_tokens": F.col("reference"), "hypothesis_tokens": F.col("hypothesis")})
    r, h = F.col("reference_tokens"), F.col("hypothesis_tokens")
    out = out.withColumn("capped_tokens", capped(r, h, extra))
    if counts:
        out = out.withColumn("e", edit_counts_udf("reference_tokens", "capped_tokens")).select("*", "e.*").drop("e")
    else:
        out = token_distance(out, "reference_tokens", "capped_tokens")
    return _rates(out)


def score_prefixes(pairs: DataFrame, settings: Sequence[int]) -> DataFrame:
    """Score token arrays (reference, hypothesis) for every cap R + n of ``settings``,
    a row for each in ``n``.

    A pair is coded once, for the widest cap; the others compare a shorter part of
    the same string."""
    r, n = F.size("reference"), F.col("n")
    out = pairs.withColumns({"reference_tokens": F.col("reference"), "hypothesis_tokens": F.col("hypothesis"), "capped_tokens": capped(F.col("reference"), F.col("hypothesis"), max(settings))})
    out = coded_pair(out, "reference_tokens", "capped_tokens", ("__r", "__h")).withColumn("n", F.explode(F.array(*map(F.lit, settings))))
    out = out.withColumns({"distance": F.levenshtein("__r", F.substring("__h", F.lit(1), r + n)), "capped_tokens": capped(F.col("reference"), F.col("hypothesis"), n)})
    return _rates(out.drop("__r", "__h"))


def _rates(out: DataFrame) -> DataFrame:
    n = F.size("reference_tokens")
    return out.withColumns(
        {
            "reference_token_count": n,
            "truncated_token_count": F.greatest(F.lit(0), F.size("hypothesis_tokens") - F.size("capped_tokens")),
            "raw_wer": F.try_divide(F.col("distance").cast("double"), n.cast("double")),
            "wer": bounded(F.col("distance"), n),
        }
    )


def score_cases(scored: DataFrame, keys: Sequence[str] = ("profile", "case_id")) -> DataFrame:
    """Sums over a case's targets; the rate is bounded after summing."""
    have = [c for c in ("substitutions", "deletions", "insertions") if c in scored.columns]
    sums = [F.sum(c).alias(c) for c in ("distance", "reference_token_count", *have)]
    out = scored.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("text_count"), F.count_if(F.col("truncated_token_count") > 0).alias("truncated_text_count"), F.count_if(F.col("distance") == 0).alias("exact_text_count"))
    d, n = F.col("distance"), F.col("reference_token_count")
    return out.withColumns({"raw_wer": F.try_divide(d.cast("double"), n.cast("double")), "wer": bounded(d, n)})


def scene(case_id: Column) -> Column:
    return F.split_part(case_id, F.lit("-"), F.lit(1))


def grouped(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """Grouping sets with the set's name in ``level`` (overall for the empty one)."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names]).agg(F.grouping_id().alias("__g"), *aggregates)
    level = F.lit(None).cast("string")
    for s in sets:
        bits = sum(1 << (len(names) - 1 - k) for k, c in enumerate(names) if c not in s)
        level = F.when(F.col("__g") == bits, F.lit("_".join(["by", *s]) if s else "overall")).otherwise(level)
    return out.withColumn("level", level).drop("__g")


def balanced_wer(cases: DataFrame, sets: Sequence[Sequence[str]] = ((), ("profile",), ("scene",))) -> DataFrame:
    """Mean of the cases' bounded rates, for all, each profile and each scene."""
    return grouped(cases, sets, F.count(F.lit(1)).alias("scored_videos"), F.avg("wer").alias("case_balanced_wer"))


def corpus_wer(cases: DataFrame, sets: Sequence[Sequence[str]] = ((), ("profile",), ("scene",))) -> DataFrame:
    """Distances over reference tokens of all cases together."""
    return grouped(cases, sets, F.sum("distance").alias("distance"), F.sum("reference_token_count").alias("reference_token_count")).withColumn("corpus_wer", F.try_divide(F.col("distance").cast("double"), F.col("reference_token_count").cast("double")))


def checklist_cases(items: DataFrame, keys: Sequence[str] = ("profile", "case_id")) -> DataFrame:
    """Yes and no counts and yes rate of each case; items have ``answer``."""
    out = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("checklist_count"), F.count_if(F.col("answer") == "yes").alias("yes_count"))
    return out.withColumns({"no_count": F.col("checklist_count") - F.col("yes_count"), "yes_rate": F.try_divide(F.col("yes_count").cast("double"), F.col("checklist_count").cast("double"))})


def video_score(items: DataFrame, sets: Sequence[Sequence[str]] = ((), ("profile",), ("scene",))) -> DataFrame:
    """Pooled yes rate over all items, for all, each profile and each scene."""
    out = grouped(items, sets, F.count_if(F.col("answer") == "yes").alias("yes_count"), F.count(F.lit(1)).alias("item_count"))
    return out.withColumn("yes_rate", F.try_divide(F.col("yes_count").cast("double"), F.col("item_count").cast("double")))


def dimension_scores(items: DataFrame, keys: Sequence[str] = (), dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Pooled yes rate and number of applicable videos for every dimension; one
    without items has a null rate.  Videos are (profile, case_id)."""
    spark = items.sparkSession
    own = items.groupBy(*keys, "dimension").agg(
        F.count_if(F.col("answer") == "yes").alias("yes_count"), F.count(F.lit(1)).alias("item_count"), F.count_distinct("profile", "case_id").alias("applicable_videos")
    )
    named = F.explode(F.array(*map(F.lit, dimensions))).alias("dimension")
    every = items.select(*keys).distinct().select(*keys, named) if keys else spark.range(1).select(named)
    out = every.join(own, [*keys, "dimension"], "left").fillna(0, ["yes_count", "item_count", "applicable_videos"])
    return out.withColumn("yes_rate", F.try_divide(F.col("yes_count").cast("double"), F.col("item_count").cast("double")))


def status_report(jobs: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Counts by status with expected and scored totals, and the unscored jobs."""
    done = F.col("status").isin(*allowed)
    counts = jobs.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(done).alias("scored"))
    return counts, jobs.where(~done).select("profile", "case_id", "status")


def run_progress(status: DataFrame, expected: int) -> DataFrame:
    """One row: strict passes, passes after the last attempt, invalid, complete or partial."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    out = status.agg(
        F.count(F.lit(1)).alias("attempted_case_count"),
        n("pass").alias("strict_pass_count"),
        n("pass_after_max_attempts").alias("accepted_after_max_count"),
        n(*SCORED_WER).alias("scored_case_count"),
        n("invalid").alias("invalid_case_count"),
    )
    return out.withColumns({"expected_case_count": F.lit(expected), "unscored_case_count": F.lit(expected) - F.col("scored_case_count"), "execution_status": F.when(F.col("attempted_case_count") == expected, "complete").otherwise("partial")})


def reason_histogram(attempts: DataFrame) -> DataFrame:
    return attempts.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("attempts"))
