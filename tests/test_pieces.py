"""Python turns a batch of texts to objects piece by piece, whatever the batch's size."""

import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textgauge.functions import answers, text
from textgauge.functions.arrow import PIECE, list_function, pieces, text_function
from textgauge.functions.tokenizer import tokenize

LONG = "word " * (PIECE // 5 + 1)
TEXTS = [None, "", "one, two", LONG, "é" * (PIECE // 2), "x", None, "5 km/h", ""]


def test_pieces_keep_rows_and_order():
    texts, more = pa.array(TEXTS, pa.string()), pa.array(range(len(TEXTS)))
    for skip in (0, 1, 4):  # a slice has an offset of its own
        got = list(pieces(texts.slice(skip), more.slice(skip)))
        assert [t for p, _ in got for t in p.to_pylist()] == TEXTS[skip:]
        assert [n for _, m in got for n in m.to_pylist()] == list(range(skip, len(TEXTS)))
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= PIECE for p, _ in got)
    assert len(list(pieces(texts))) > 2
    assert list(pieces(texts.slice(0, 0))) == []


def test_tokens_of_a_batch_of_pieces(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").coalesce(1)
    got = df.select("id", text.token_values("t").alias("v"), text.tokens("t").alias("k"), text.legacy_values("t").alias("l")).orderBy("id").collect()
    assert [len(r.v) for r in got] == [0, 0, 2, PIECE // 5 + 1, 1, 1, 0, 2, 0]
    assert [[x.value for x in r.k] for r in got] == [r.v for r in got]
    assert got[7].k[0] == ("5", "number") and [len(r.l) for r in got[:3]] == [0, 0, 3]


@pytest.mark.parametrize("columns", [1, 2])
def test_a_large_batch_holds_no_more_than_a_piece(spark, columns):
    """Each list ends with the memory that the worker holds then."""

    @list_function("array<string>", pa.string())
    def probe(t):
        import tracemalloc

        if not tracemalloc.is_tracing():
            tracemalloc.start()
        return [f"{t[:4]} {k} {'.' * 40}" for k in range(200)] + [str(tracemalloc.get_traced_memory()[0])]

    # one batch of 12 MB; its lists have 80 MB
    df = spark.range(3000, numPartitions=1).select(*[F.repeat(F.lpad(F.col("id").cast("string"), 4, "0"), 1000).alias(f"t{k}") for k in range(columns)])
    for held in zip(*df.select(*[F.element_at(probe(f"t{k}"), -1).cast("long") for k in range(columns)]).collect(), strict=True):
        assert max(held) - min(held) < 24 << 20


def test_rows_of_a_large_batch_hold_no_more_than_a_piece(spark):
    @text_function("string", pa.string())
    def probe(t, n):
        import tracemalloc

        if not tracemalloc.is_tracing():
            tracemalloc.start()
        return f"{tracemalloc.get_traced_memory()[0]:012d}" + t * n

    df = spark.range(3000, numPartitions=1).select(F.repeat(F.lpad(F.col("id").cast("string"), 4, "0"), 1000).alias("t"), F.lit(5).alias("n"))
    held = [int(r[0]) for r in df.select(F.substring(probe("t", "n"), 1, 12)).collect()]
    assert max(held) - min(held) < 24 << 20


def test_responses_are_read_by_pieces_of_a_batch(spark):
    """Long, broken and missing responses of one batch give what each gives alone."""
    one = lambda status, t: "<answer>" + json.dumps({"T01": {"status": status, "text": t, "readability_note": ""}}) + "</answer>"
    items = [{"id": i, "answer": "yes"} for i in answers.ITEM_IDS]
    raws = [one("transcribed", "open é"), None, one("transcribed", LONG), "", "<answer>" + "ab" * PIECE, one("seen", ""), "<answer>[1]</answer>", one("transcribed", "x" * PIECE), f"<answer>{json.dumps(items)}</answer>", "<answer>{}</answer> after"]
    rows = [(k, r, None if k == 9 else ["T01"], "length" if k % 2 else None, k) for k, r in enumerate(raws)]
    df = spark.createDataFrame(rows, "id int, raw string, ids array<string>, finish_reason string, most int").coalesce(1)
    read = df.select("id", answers.transcription("raw", "ids", "finish_reason").alias("t"), answers.checklist("raw").alias("c"), text.first_tokens("raw", F.col("most")).alias("w"), text.first_tokens("raw", 2).alias("v"))
    assert set(re.findall(r"ArrowEvalPython .*, (\d+)", read._jdf.queryExecution().executedPlan().toString())) == {"251"}  # of iterators of batches
    for r, (_, raw, ids, finish, most) in zip(read.orderBy("id").collect(), rows, strict=True):
        t, c = answers.read_transcription(raw, ids or [], finish), answers.read_checklist(raw)
        assert r.t.asDict() == t | {"answer": r.t.answer} and [*map(tuple, r.t.answer or [])] == (t["answer"] or [])
        assert r.c.asDict() == c | {"decisions": r.c.decisions} and [*map(tuple, r.c.decisions or [])] == (c["decisions"] or [])
        assert (r.t.answer is None, r.c.decisions is None) == (t["answer"] is None, c["decisions"] is None)
        assert r.w == [x.value for x in tokenize(raw, most)] and r.v == [x.value for x in tokenize(raw, 2)]
