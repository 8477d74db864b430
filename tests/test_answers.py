import json
import random
import re

import pytest

from textgauge.functions.answers import ITEM_IDS, read_checklist, read_transcription
from textgauge.functions import runs
from textgauge.functions.runs import longest_character_run, longest_runs, longest_unit_run

IDS = ["T01", "T02"]


def answer(**over):
    one = {"status": "transcribed", "text": "A", "readability_note": ""}
    return {i: {**one, **over.get(i, {})} for i in IDS}


def wrap(value):
    return f"<answer>{json.dumps(value)}</answer>"


@pytest.mark.parametrize(
    "raw,finish,reason",
    [
        (wrap(answer()), "stop", None),
        ("so: " + wrap(answer()) + " done", "stop", None),
        (wrap(answer()) + wrap([]), "stop", None),
        (wrap(answer()).replace("answer>", "ANSWER>"), "stop", None),
        ("nothing", "stop", "other"),
        ("<answer>{", "length", "unclosed_answer_repetition"),
        ("<answer>{", "stop", "other"),
        ("<answer>" + "ab" * 70, "stop", "unclosed_answer_repetition"),
        ("<answer>{bad</answer>", "stop", "other"),
        (wrap([1]), "stop", "other"),
        (wrap(dict(reversed(answer().items()))), "stop", "field_conflict"),
        (wrap({"T01": answer()["T01"]}), "stop", "field_conflict"),
        (wrap(answer(T01={"more": 1})), "stop", "field_conflict"),
        (wrap(answer(T01={"status": "seen"})), "stop", "field_conflict"),
        (wrap(answer(T01={"status": ["x"]})), "stop", "field_conflict"),
        (wrap(answer(T01={"text": "a" * 641, "status": "seen"})), "stop", "transcription_too_long"),
        (wrap(answer(T01={"text": "a" * 640})), "stop", None),
        (wrap(answer(T01={"text": "x <UNK>"})), "stop", "field_conflict"),
        (wrap(answer(T01={"text": " "})), "stop", "field_conflict"),
        (wrap(answer(T01={"text": None})), "stop", "field_conflict"),
        (wrap(answer(T01={"status": "text_unreadable", "text": "x", "readability_note": "n"})), "stop", "field_conflict"),
        (wrap(answer(T01={"status": "text_unreadable", "text": ""})), "stop", "field_conflict"),
        (wrap(answer(T01={"status": "text_unreadable", "text": "", "readability_note": "dim"})), "stop", None),
        (wrap(answer(T01={"status": "carrier_not_found", "text": "", "readability_note": "n"})), "stop", "field_conflict"),
        (None, "stop", "other"),
    ],
)
def test_transcription_reasons(raw, finish, reason):
    r = read_transcription(raw, IDS, finish)
    assert r["reason"] == reason and bool(r["errors"]) == (reason is not None)


def test_first_block_and_surroundings():
    r = read_transcription("x " + wrap(answer()) + wrap(answer()), IDS, None)
    assert (r["block_count"], r["text_before"], r["text_after"]) == (2, True, True)
    # a stray opening tag in front spoils the block
    assert read_transcription("<answer> " + wrap(answer()), IDS, None)["reason"] == "other"


def test_lenient_answers():
    r = read_transcription(wrap({"T01": {"status": "??", "text": "seen"}, "T02": 5}), IDS, None)
    assert r["answer"] == [("T01", "transcribed", "seen", ""), ("T02", "text_unreadable", "", "")]
    r = read_transcription(wrap(answer(T01={"status": "carrier_not_found", "text": ""})), IDS, None)
    assert r["answer"][0][1] == "carrier_not_found"
    # of repeated keys the last value counts
    assert read_transcription('<answer>{"T01": 1, "T02": {"status":"transcribed","text":"b","readability_note":""}, "T01": {"status":"transcribed","text":"a","readability_note":""}}</answer>', IDS, None)["answer"][0][2] == "a"


def items(**over):
    return [{"id": i, "answer": "yes", **over.get(i, {})} for i in ITEM_IDS]


@pytest.mark.parametrize(
    "raw,reason,repaired",
    [
        (wrap(items(C01={"answer": " YES "})), None, False),
        (wrap(items())[:-10] + "</answer>", None, True),
        (wrap(items(C10={"id": "C010"})), None, False),
        (wrap(items(C10={"id": "C011"})), "other", False),
        (wrap(items(C09={"id": "C009"})), "other", False),
        (wrap(items()[:19]), "other", False),
        (wrap([*items(), {"id": "C21", "answer": "no"}]), "other", False),
        (wrap(items(C03={"x": 1})), "other", False),
        (wrap([*items()[:5], 7, *items()[6:]]), "other", False),
        (wrap(items(C04={"answer": "maybe"})), "invalid_answer_label", False),
        (wrap(items(C04={"answer": True})), "invalid_answer_label", False),
        ("<answer>[", "incomplete_answer_block", False),
        ("<answer>[{]</answer>", "invalid_json", False),
        ("<answer>[{</answer>", "invalid_json", False),
        (wrap({"a": 1}), "other", False),
    ],
)
def test_checklist_reasons(raw, reason, repaired):
    r = read_checklist(raw)
    assert (r["reason"], r["repaired"]) == (reason, repaired)
    assert (r["decisions"] is None) == (reason is not None)


def test_runs():
    assert longest_character_run("abbbccc")[:4] == ("b", 1, 3, 3) and longest_character_run("") is None
    assert longest_unit_run("x" + "ab" * 64)[:4] == ("ab", 2, 64, 128)
    assert longest_unit_run("ab" * 63) is None
    assert longest_unit_run("y" * 200)[:3] == ("yy", 2, 100)
    assert longest_unit_run("-" + "abcdefghi" * 16 + "-")[4:] == (1, 145)


def slow_unit_run(text, most=16, repeats=16, covers=128):
    """Every start and unit, counted out."""
    best = None
    for u in range(2, most + 1):
        for a in range(len(text) - u + 1):
            n = 1
            while text[a + n * u : a + (n + 1) * u] == text[a : a + u]:
                n += 1
            if n >= repeats and n * u >= covers and (best is None or (n * u, -u, -a) > best[0]):
                best = (n * u, -u, -a), (text[a : a + u], u, n, n * u, a, a + n * u)
    return best and best[1]


@pytest.mark.parametrize("piece", [1 << 20, 50])
def test_runs_of_a_batch(monkeypatch, piece):
    monkeypatch.setattr(runs, "PIECE", piece)
    rng = random.Random(piece)
    texts = [None, "", "a", "\U0001f600" * 20, "ab" * 10]
    for _ in range(80):
        unit = "".join(rng.choice("abé\U0001f600 ") for _ in range(rng.randint(1, 17)))
        texts.append("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) + unit * rng.randint(0, 30) + unit[: rng.randint(0, 3)] + rng.choice(["", "aaaab", unit * 20]))
    got = longest_runs(texts, covers=20, repeats=5)
    assert [g[1] for g in got] == [slow_unit_run(t or "", covers=20, repeats=5) for t in texts]
    for t, (c, _) in zip(texts, got, strict=True):
        best = max(re.finditer(r"(.)\1*", t or "", re.DOTALL), key=lambda m: len(m[0]), default=None)
        assert c == (best and (best[1], 1, len(best[0]), len(best[0]), *best.span()))
