"""Text functions of the evaluation, as columns."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textgauge.functions.arrow import arrow_function, list_function, text_function
from textgauge.functions.runs import longest_runs

TOKENS = "array<struct<value:string,kind:string>>"
#: White space as Python reads it: Java's class and the separators that it lacks.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


@list_function(TOKENS, {"value": pa.string(), "kind": pa.string()})
def tokens(text):
    from textgauge.functions.tokenizer import tokenize

    return tokenize(text)


@list_function("array<string>", pa.string())
def token_values(text):
    from textgauge.functions.tokenizer import tokenize

    return [t.value for t in tokenize(text)]


@text_function("array<string>", pa.list_(pa.string()))
def _first_tokens(text, most):
    from textgauge.functions.tokenizer import tokenize

    return [t.value for t in tokenize(text, most)]


def first_tokens(text, most) -> Column:
    """The first ``most`` token values of each text (a column or a number); reading stops there."""
    return _first_tokens(text, most if isinstance(most, Column) else F.lit(most))


@arrow_function("array<int>")
def token_sizes(texts):
    from textgauge.functions.tokenizer import tokenize

    return None if texts is None else [len(tokenize(t)) for t in texts]


@list_function("array<string>", pa.string())
def legacy_values(text):
    from textgauge.functions.tokenizer import legacy_tokens

    return legacy_tokens(text)


@arrow_function("string")
def normalized(text):
    return None if text is None else " ".join(unicodedata.normalize("NFC", text).split())


def tokenization_record(text: Column) -> Column:
    """Version, input, normal form, tokens and kinds of a text."""
    t = tokens(text)
    return F.struct(F.lit(tokenizer_version()).alias("tokenizer_version"), text.alias("input"), normalized(text).alias("normalized"), F.transform(t, lambda x: x["value"]).alias("tokens"), F.transform(t, lambda x: x["kind"]).alias("token_kinds"))


def tokenizer_version() -> str:
    from textgauge.functions.tokenizer import VERSION

    return VERSION


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of ``part``, which is not empty."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores: the form that SQL engines share."""
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


# ------------------------------------------------------------------ repetition

CHARACTER_RUN, UNIT_MOST, UNIT_REPEATS, UNIT_COVERS, SPACE_RUN = 64, 16, 16, 128, 64
#: Longest transcription that the protocol allows.
TEXT_LIMIT = 640


def same_character_run(text: Column) -> Column:
    return text.rlike(rf"(?s)(.)\1{{{CHARACTER_RUN - 1},}}")


def repeated_unit_run(text: Column) -> Column:
    """A unit of 2 to 16 characters, 16 times or more, over 128 characters or more.

    One scan finds texts with any unit that often; only those are asked for each
    unit's own number of repeats."""
    hit = F.lit(False)
    for unit in range(2, UNIT_MOST + 1):
        times = max(UNIT_REPEATS, -(-UNIT_COVERS // unit))
        hit = hit | text.rlike(rf"(?s)(.{{{unit}}})\1{{{times - 1},}}")
    return F.when(text.isNull(), F.lit(None)).when(text.rlike(rf"(?s)(.{{2,{UNIT_MOST}}}?)\1{{{UNIT_REPEATS - 1},}}"), hit).otherwise(F.lit(False))


def white_space_run(text: Column) -> Column:
    return text.rlike(rf"{SPACE}{{{SPACE_RUN},}}")


def repetition_warnings(text: Column) -> Column:
    """Reasons to suspect a repetition loop, in their fixed order."""
    reasons = F.array(
        F.when(same_character_run(text), F.lit("same_character_run_ge_64")),
        F.when(repeated_unit_run(text), F.lit("substring_2_to_16_repeated_ge_16_covering_ge_128")),
        F.when(white_space_run(text), F.lit("whitespace_run_ge_64")),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


_RUN = "struct<unit:string,unit_length:int,repeat_count:int,covered_length:int,start:int,end:int>"


def repetition_details(text) -> Column:
    """Where the longest runs are; the columns above say whether there are any."""
    run = pa.struct([("unit", pa.string()), *[(n, pa.int32()) for n in ("unit_length", "repeat_count", "covered_length", "start", "end")]])
    names = [f.name for f in run]

    def on_batch(texts: pa.Array) -> pa.Array:
        own = texts.to_pylist()
        found = longest_runs(own)
        columns = [pa.array([dict(zip(names, x[k], strict=True)) if x[k] else None for x in found], run) for k in (0, 1)]
        size = [len(t or "") for t in own]
        parts = [pa.array(size, pa.int32()), *columns, pa.array([n == TEXT_LIMIT for n in size], pa.bool_())]
        return pa.StructArray.from_arrays(parts, ["length", "longest_character_run", "longest_repeated_substring_run", "reached_text_character_limit"], mask=pa.array([t is None for t in own], pa.bool_()))

    return F.arrow_udf(on_batch, returnType=f"struct<length:int,longest_character_run:{_RUN},longest_repeated_substring_run:{_RUN},reached_text_character_limit:boolean>")(text)


# ------------------------------------------------------------------ hashes and prompts


def canonical_json(value) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of columns joined by newlines; null is the empty string."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def stripped(text: Column) -> Column:
    """Without white space at both ends, as ``SPACE`` reads it."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def refinement(original: Column, told: Column) -> Column:
    """(text, fault) of a refinement without a copy of the original prompt in front.

    Only where the copy is there are the separators after it cut off as well.
    Faults: blank_prompt, blank_refinement, adds_nothing; the text is null then.
    Null counts as blank.
    """
    prompt, own = stripped(F.coalesce(original, F.lit(""))), stripped(F.coalesce(told, F.lit("")))
    copied = F.startswith(own, prompt)
    rest = F.when(copied, F.regexp_replace(F.substr(own, F.length(prompt) + 1), r"^[ \t\r\n:\-]+", "")).otherwise(own)
    fault = F.when(prompt == "", "blank_prompt").when(own == "", "blank_refinement").when(rest == "", "adds_nothing")
    return F.struct(F.when(fault.isNull(), rest).alias("text"), fault.alias("fault"))


def strip_repeated_prompt(original: Column, told: Column) -> Column:
    """The text of ``refinement``; null where it has a fault."""
    return refinement(original, told)["text"]


def aligned_frames(requested: Column, internal: int = 0) -> Column:
    """The least frame count from ``requested`` on that is 5 modulo 17."""
    n = F.greatest(requested, F.lit(internal))
    return n + F.pmod(F.lit(5) - n, F.lit(17))


# ------------------------------------------------------------------ answer blocks

#: The rule of the Python reader: ``SPACE`` for white space, and case as Unicode folds it.
_BLOCK = rf"(?isu)<answer>{SPACE}*(.*?){SPACE}*</answer>"


def answer_block(raw: Column) -> Column:
    """The first complete answer block and what stands around it, on the JVM."""
    count = F.regexp_count(raw, F.lit(_BLOCK))
    start = F.regexp_instr(raw, F.lit(_BLOCK))
    size = F.length(F.regexp_substr(raw, F.lit(_BLOCK)))
    before = F.when(count == 0, raw).otherwise(F.substring(raw, F.lit(1), start - 1))
    after = F.when(count > 0, F.substring(raw, start + size, F.length(raw))).otherwise(F.lit(""))
    some = lambda t: F.regexp_replace(t, SPACE, "") != ""
    return F.struct(
        count.cast("int").alias("block_count"),
        F.when(count > 0, F.regexp_extract(raw, _BLOCK, 1)).alias("content"),
        some(before).alias("text_before"),
        some(after).alias("text_after"),
        F.greatest(F.lit(0), count - 1).cast("int").alias("additional_blocks"),
    )
