import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textgauge.functions import alignment
from textgauge.functions.alignment import capped, edit_counts, edit_counts_udf, token_distance
from textgauge.operators import scoring

WORDS = st.lists(st.sampled_from("abcd"), max_size=9)


def table(reference, hypothesis):
    """All cells as (distance, gaps, substitutions, deletions, insertions)."""
    best = {(0, 0): (0, 0, 0, 0, 0)}
    step = lambda c, s, x, n: (c[0] + 1, c[1] + x + n, c[2] + s, c[3] + x, c[4] + n)
    for i in range(len(reference) + 1):
        for j in range(len(hypothesis) + 1):
            if i and j and reference[i - 1] == hypothesis[j - 1]:
                best[i, j] = best[i - 1, j - 1]
            elif i or j:
                options = []
                if i and j:
                    options.append(step(best[i - 1, j - 1], 1, 0, 0))
                if i:
                    options.append(step(best[i - 1, j], 0, 1, 0))
                if j:
                    options.append(step(best[i, j - 1], 0, 0, 1))
                best[i, j] = min(options)
    d, _, s, x, n = best[len(reference), len(hypothesis)]
    return d, s, x, n


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_counts(r, h):
    d, s, x, n = edit_counts(r, h)
    assert (d, s, x, n) == table(r, h)
    assert d == s + x + n and x - n == len(r) - len(h)
    assert abs(len(r) - len(h)) <= d <= max(len(r), len(h))


@pytest.mark.parametrize("cells", [1 << 20, 64])
def test_whole_batches(monkeypatch, cells):
    """Pairs of all sizes aligned together, in bands that have to be widened."""
    monkeypatch.setattr(alignment, "CELLS", cells)
    rng = random.Random(cells)
    pairs = [(rng.choices("abcdefg"[: rng.randint(1, 7)], k=rng.randint(0, 60)), rng.choices("abcdefg", k=rng.randint(0, 60))) for _ in range(250)]
    pairs += [(r, r[: len(r) // 2] + rng.choices("xyz", k=rng.randint(0, 5)) + r[len(r) // 2 :]) for r, _ in pairs[:100]]
    pairs += [(None, ["a"]), (["a"], None), ([], []), (["a", None], [None, "a"]), ([None], ["None"])]
    got = alignment.edit_counts_of(*(pa.array([p[k] for p in pairs], pa.list_(pa.string())) for k in (0, 1))).to_pylist()
    assert [g and tuple(g.values()) for g in got] == [None if r is None or h is None else table(r, h) for r, h in pairs]


def test_long_pairs():
    rng = random.Random(3)
    r = rng.choices(range(2000), k=5000)
    h = [x if rng.random() < 0.9 else -1 for x in r[40:]] + rng.choices(range(2000), k=30)
    d, s, x, n = alignment.edit_counts_of(pa.array([r]), pa.array([h]))[0].as_py().values()
    assert d == s + x + n and x - n == 10 and 500 < d < 700
    assert alignment.edit_counts_of(pa.array([r]), pa.array([[-2] * 4000]))[0].as_py() == {"distance": 5000, "substitutions": 4000, "deletions": 1000, "insertions": 0}


def test_columns(spark):
    rows = [(1, ["a", "b", "c"], ["a", "x", "c"]), (2, [], ["a"]), (3, ["é"] * 3, []), (4, None, ["a"]), (5, ["a", "a", "b"], ["b", "a", "a", "c"])]
    df = spark.createDataFrame(rows, "id int, r array<string>, h array<string>")
    got = {x.id: x for x in token_distance(df.withColumn("e", edit_counts_udf("r", "h")), "r", "h", "d").collect()}
    assert tuple(got[1].e) == (1, 1, 0, 0) and tuple(got[2].e) == (1, 0, 0, 1) and tuple(got[3].e) == (3, 0, 3, 0)
    assert got[4].e is None and got[4].d is None
    assert all(got[i].d == got[i].e.distance for i in (1, 2, 3, 5))


@pytest.mark.parametrize(
    "reference,hypothesis,n,want",
    [
        ("a b c", "a b c", 5, (0, 0, 0, 0, 3, 0.0)),
        ("a b c", "", 5, (3, 0, 3, 0, 3, 1.0)),
        ("a b c", "a x c", 5, (1, 1, 0, 0, 3, 1 / 3)),
        ("a b", "a b" + " z" * 10, 1, (1, 0, 0, 1, 2, 0.5)),
        ("a b", "a b" + " z" * 10, 5, (5, 0, 0, 5, 2, 1.0)),
        ("a b", None, 5, (2, 0, 2, 0, 2, 1.0)),
    ],
)
def test_scored_pairs(spark, reference, hypothesis, n, want):
    df = spark.createDataFrame([("p", "AD-0001", reference, hypothesis)], "profile string, case_id string, reference string, hypothesis string")
    r = scoring.score_pairs(df, n).first()
    assert (r.distance, r.substitutions, r.deletions, r.insertions, r.reference_token_count, r.wer) == want
    assert scoring.score_pairs(df, n, counts=False).first().distance == want[0]


def test_case_rates_are_bounded_after_the_sum(spark):
    df = spark.createDataFrame([("p", "c", "a b c", "a b c"), ("p", "c", "a b c", None), ("q", "c", "a", "z z z z z z"), ("q", "d", "...", "a")], "profile string, case_id string, reference string, hypothesis string")
    got = {(r.profile, r.case_id): r for r in scoring.score_cases(scoring.score_pairs(df, 5)).collect()}
    assert got["p", "c"].wer == 0.5 and got["p", "c"].text_count == 2 and got["p", "c"].exact_text_count == 1
    assert got["q", "c"].raw_wer == 6.0 and got["q", "c"].wer == 1.0
    assert got["q", "d"].wer is None


def test_extra_tokens_argument():
    for bad in (True, -1, 1.5):
        with pytest.raises(ValueError):
            capped(None, None, bad)
