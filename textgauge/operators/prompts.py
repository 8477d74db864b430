"""Masked prompts, the split of targets, leak checks and request texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from textgauge.functions import protocol
from textgauge.functions.text import occurrences
from textgauge.operators.leaks import occurrences_in, text_key
from textgauge.sources.layout import spread_rows
from textgauge.sources.sinks import checkpointed


def mask(cases: DataFrame) -> DataFrame:
    """Add ``masked_prompt``, ``public_targets``, ``private_targets`` and ``mask_errors``.

    Targets are replaced in their order by ``[TARGET id]``.  A text must occur
    once in the prompt and once in what earlier replacements left of it, and none
    may remain.
    """
    state = F.aggregate(
        "required_text",
        F.struct(F.col("prompt_en").alias("text"), F.array().cast("array<string>").alias("bad")),
        lambda s, t: F.struct(
            F.replace(s["text"], t["verbatim"], F.concat(F.lit("[TARGET "), t["id"], F.lit("]"))).alias("text"),
            F.when(
                (occurrences(F.col("prompt_en"), t["verbatim"]) != 1) | (occurrences(s["text"], t["verbatim"]) != 1),
                F.array_append(s["bad"], F.concat(t["id"], F.lit(":occurrences"))),
            )
            .otherwise(s["bad"])
            .alias("bad"),
        ),
    )
    left = F.filter("required_text", lambda t: F.contains(F.col("__s.text"), t["verbatim"]))
    return cases.withColumn("__s", state).select(
        *cases.columns,
        F.col("__s.text").alias("masked_prompt"),
        F.transform("required_text", lambda t: F.struct(t["id"].alias("id"), t["carrier"].alias("carrier"), t["language"].alias("language"))).alias("public_targets"),
        F.transform("required_text", lambda t: F.struct(t["id"].alias("id"), t["verbatim"].alias("verbatim"))).alias("private_targets"),
        F.concat(F.col("__s.bad"), F.transform(left, lambda t: F.concat(t["id"], F.lit(":remains")))).alias("mask_errors"),
    )


def leaks(request: Column, private: Column) -> Column:
    """Whether a request shows any reference text."""
    return F.exists(private, lambda t: F.contains(request, t["verbatim"]))


#: Characters of targets up to which one automaton looks for all of them.
AUTOMATON_CHARS = 1 << 20


def leaked_cases(documents: DataFrame, cases: DataFrame, most: int = AUTOMATON_CHARS) -> DataFrame:
    """How many cases each document shows a private target of: doc_id, n_cases.

    Targets of up to ``most`` characters in all are looked for in one pass over a text
    by an Aho-Corasick automaton that every worker holds.  More are found by their
    rarest grams (``leaks``), which no worker holds whole.  Counts are exact and the same
    either way.  A null text or target shows nothing, an empty target is in
    every text.  Rows that repeat are counted alike.
    """
    wanted = cases.select("id", F.explode("private_targets").alias("t")).select("id", F.col("t.verbatim").alias("verbatim")).where("verbatim IS NOT NULL").distinct()
    wanted = checkpointed(wanted)
    size = wanted.agg(F.sum(F.length("verbatim") + 16)).first()[0] or 0
    if size > most:
        return _leaked_by_grams(documents, wanted)
    sent = documents.sparkSession.sparkContext.broadcast([(r.id, r.verbatim) for r in wanted.collect()])
    docs = spread_rows(documents.select("doc_id", "text"))
    return docs.select("doc_id", F.coalesce(_case_counter(sent)(F.col("text")), F.lit(0)).alias("n_cases"))


def _leaked_by_grams(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``leaked_cases`` for targets of any number."""
    everywhere = checkpointed(wanted.where("verbatim = ''").select("id").distinct())
    texts = checkpointed(wanted.where("verbatim <> ''").select("verbatim").distinct().withColumn("target", F.monotonically_increasing_id()))
    found = occurrences_in(documents, texts)
    rest = wanted.join(texts, "verbatim").select("id", "target").join(everywhere, "id", "left_anti")
    key = ["doc_id", "h1", "h2"]
    counts = found.join(rest, "target").select(*key, "id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    rows = documents.select("doc_id", *text_key("text"), F.col("text").isNotNull().alias("there"))
    theirs = counts.select(*[F.col(c).alias(f"_{c}") for c in key], "n")
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    n = F.lit(everywhere.count()) + F.coalesce("n", F.lit(0))
    return rows.join(theirs, same, "left").select("doc_id", F.when(F.col("there"), n).otherwise(F.lit(0)).cast("bigint").alias("n_cases"))


def _case_counter(sent):
    def count(batches):
        import ahocorasick

        of: dict[str, set] = {}
        for name, target in sent.value:
            of.setdefault(target, set()).add(name)
        everywhere = of.pop("", set())
        find = ahocorasick.Automaton()
        for target, names in of.items():
            find.add_word(target, names)
        find.make_automaton()
        for texts in batches:
            found = []
            for t in texts.to_pylist():
                if t is None:
                    found.append(None)
                    continue
                names = set(everywhere)
                for _, more in find.iter(t) if len(find) else ():
                    names |= more
                found.append(len(names))
            yield pa.array(found, pa.int64())

    return F.arrow_udf(count, returnType="bigint", functionType=ArrowUDFType.SCALAR_ITER)


def explode_targets(cases: DataFrame) -> DataFrame:
    """targets(case_id, pos, text_id, carrier, language, verbatim)."""
    return cases.select(F.col("id").alias("case_id"), F.posexplode("required_text").alias("pos", "t")).select("case_id", "pos", F.col("t.id").alias("text_id"), "t.carrier", "t.language", "t.verbatim")


def explode_questions(checklists: DataFrame) -> DataFrame:
    """questions(case_id, pos, item_id, dimension, question_en)."""
    return checklists.select(F.col("id").alias("case_id"), F.posexplode("checklist").alias("pos", "i")).select("case_id", "pos", F.col("i.id").alias("item_id"), "i.dimension", "i.question_en")


def _json_string(text: Column) -> Column:
    """A JSON string literal with characters as they are."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def targets_json(public: Column) -> Column:
    """The public targets as JSON, two spaces of indent."""
    line = lambda k, v: F.concat(F.lit(f'    "{k}": '), _json_string(v))
    one = lambda t: F.concat(F.lit("  {\n"), F.concat_ws(",\n", line("id", t["id"]), line("carrier", t["carrier"]), line("language", t["language"])), F.lit("\n  }"))
    return F.concat(F.lit("[\n"), F.array_join(F.transform(public, one), ",\n"), F.lit("\n]"))


def _with_feedback(body: Column, feedback: Column | None) -> Column:
    if feedback is None:
        return body
    return F.concat(body, F.when(F.coalesce(feedback, F.lit("")) != "", F.concat(F.lit(f"\n\n{protocol.FEEDBACK}\n\n"), feedback)).otherwise(F.lit("")))


def transcription_request(masked: Column, public: Column, example: str = protocol.TRANSCRIPTION_EXAMPLE, feedback: Column | None = None) -> Column:
    """The user message of a transcription attempt; feedback of the last one ends it.
    The system message is ``protocol.TRANSCRIPTION_SYSTEM``."""
    ending = f"\n\n{protocol.EXAMPLE}\n\n{example}\n\n{protocol.TRANSCRIPTION_CLOSING}"
    return _with_feedback(F.concat(F.lit(f"{protocol.SCENE}\n\n"), masked, F.lit(f"\n\n{protocol.CARRIERS}\n\n"), targets_json(public), F.lit(ending)), feedback)


def request_leaks(masked: DataFrame, example: str = protocol.TRANSCRIPTION_EXAMPLE) -> DataFrame:
    """Cases of ``mask`` whose own request shows a private target, in the system message or
    the user message: id, leaked (ids of targets).  Such a case must not be sent."""
    user = transcription_request(F.col("masked_prompt"), F.col("public_targets"), example)
    shown = lambda t: F.contains(F.lit(protocol.TRANSCRIPTION_SYSTEM), t["verbatim"]) | F.contains(F.col("__user"), t["verbatim"])
    out = masked.withColumn("__user", user).withColumn("leaked", F.transform(F.filter("private_targets", shown), lambda t: t["id"]))
    return out.where("size(leaked) > 0").select("id", "leaked")


def example_answers(count: Column) -> Column:
    """An example block whose answers alternate, yes first."""
    item = lambda k: F.concat(F.lit('{"id":"C'), F.lpad(k.cast("string"), 2, "0"), F.lit('","answer":"'), F.when(k % 2 == 1, F.lit("yes")).otherwise(F.lit("no")), F.lit('"}'))
    return F.concat(F.lit("<answer>["), F.array_join(F.transform(F.sequence(F.lit(1), count), item), ","), F.lit("]</answer>"))


def checklist_request(items: Column, feedback: Column | None = None) -> Column:
    """The user message of a checklist attempt; the system message is ``protocol.CHECKLIST_SYSTEM``."""
    lines = F.array_join(F.transform(items, lambda i: F.concat(i["id"], F.lit(": "), i["question_en"])), "\n")
    body = F.concat(F.lit(f"{protocol.CHECKLIST}\n\n"), lines, F.lit(f"\n\n{protocol.EXAMPLE}\n\n"), example_answers(F.size(items)), F.lit(f"\n\n{protocol.CHECKLIST_CLOSING}"))
    return _with_feedback(body, feedback)
