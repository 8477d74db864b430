"""Cases that the tables of the queries do not hold."""

import json
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textgauge.functions import answers, text, tokenizer
from textgauge.functions.alignment import edit_counts, token_distance
from textgauge.operators import attempts, candidates, leaks, partitioning, prompts, scoring, tools, validation, workflow
from textgauge.sources import sinks
from textgauge.sources.layout import spread_rows


def plain_distance(r, h):
    row = list(range(len(h) + 1))
    for i, x in enumerate(r, 1):
        row, old = [i], row
        for j, y in enumerate(h, 1):
            row.append(old[j - 1] if x == y else 1 + min(old[j - 1], old[j], row[-1]))
    return row[-1]


def test_distance_of_many_different_tokens(spark):
    many = [f"w{k}" for k in range(45000)]
    rows = [(1, many, many[:10] + many[12:]), (2, many[:3], [f"x{k}" for k in range(50000)]), (3, ["a"], None), (4, [], [])]
    df = spark.createDataFrame(rows, "id int, r array<string>, h array<string>")
    assert {x.id: x.distance for x in token_distance(df, "r", "h").collect()} == {1: 2, 2: 50000, 3: None, 4: 0}


def test_distances_of_all_caps(spark):
    rows = [(k, list("abcab" * (k % 3))[: k % 7], list("bacz" * 6)[: k % 25]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, reference array<string>, hypothesis array<string>")
    for x in scoring.score_prefixes(df, (0, 2, 9)).collect():
        _, r, h = rows[x.id]
        cut = h[: len(r) + x.n]
        assert x.distance == plain_distance(r, cut) == edit_counts(r, cut)[0]
        assert x.truncated_token_count == len(h) - len(cut) and x.reference_token_count == len(r)


SPACES = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0   　"


def test_answer_blocks_are_read_alike(spark):
    raws = [f"{a}<answer>{b}x y{c}</answer>{d}" for a in ("", *SPACES) for b in ("", "　\x1c") for c in ("", "\x85\n") for d in ("", "\xa0", "t")]
    raws += ["<ANSWER>a</Answer>", "<anſwer>a</answer><answer></answer>", "<answer>​</answer>", "<answer>x", "", "</answer><answer>b</answer>"]
    df = spark.createDataFrame(list(enumerate(raws)), "id int, raw string")
    for x in df.select("id", text.answer_block(F.col("raw")).alias("b")).select("id", "b.*").collect():
        want = answers.blocks(raws[x.id])
        assert {k: x[k] for k in want} == want, raws[x.id]


def plain_refinement(original, told):
    original, told = (original or "").strip(), (told or "").strip()
    if not original or not told:
        return None, "blank_refinement" if original else "blank_prompt"
    if told.startswith(original):
        told = told[len(original) :].lstrip(" \t\r\n:-")
    return (told, None) if told else (None, "adds_nothing")


def test_refinements(spark):
    pieces = ["", "shop", "\tshop", "shop　", "- pan left", "shop: - pan", "shopping", "shop\x1c", "\xa0", None, "shop - ", ": shop x\x85"]
    rows = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in pieces for b in pieces)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    for x in df.select("id", text.refinement(F.col("a"), F.col("b")).alias("r")).select("id", "r.*").collect():
        assert (x.text, x.fault) == plain_refinement(*rows[x.id][1:]), rows[x.id]


def test_evidence_and_usage(spark):
    rows = [(1, None, []), (2, "null", []), (3, '"at [1]"', ["at [1]"]), (4, '["a", 2, 1.5, null]', ["a", "2", "1.5", "None"]), (5, "7", None), (6, '{"k": 1}', ["k"])]
    got = spark.createDataFrame(rows, "id int, v string, w array<string>").select("id", validation.evidence(F.col("v")).alias("e"), "w").collect()
    assert all(r.e == r.w for r in got), got
    u = spark.createDataFrame([('{"usage":{"prompt_tokens":3,"total_tokens":9}}',), ("{}",), (None,)], "j string").select(validation.token_usage(F.col("j")).alias("u")).collect()
    assert [r.u for r in u] == [{"prompt_tokens": 3, "total_tokens": 9}, {}, {}]


def test_reports_are_single_files(spark, tmp_path):
    path = tmp_path / "r" / "metrics.json"
    for value in ({"a": "é"}, {"a": [1, None]}):
        sinks.write_json(spark, value, str(path))
        assert json.loads(path.read_text(encoding="utf-8")) == value
    assert path.read_text(encoding="utf-8").endswith("}\n") and [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["metrics.json"]
    sinks.write_metrics(spark, {"wer": {"x": 1}, "checklist": {"y": 2}}, str(tmp_path))
    assert json.loads((tmp_path / "metrics.json").read_text()) == {"wer": {"x": 1}, "checklist": {"y": 2}}
    assert json.loads((tmp_path / "wer" / "reports" / "metrics.json").read_text()) == {"x": 1}
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.write_json_report(df, f"{tmp_path}/one.json")
    sinks.write_text(df, "k", f"{tmp_path}/one.txt")
    assert json.loads((tmp_path / "one.json").read_text()) == {"k": "a", "v": 1} and (tmp_path / "one.txt").read_text() == "a\n"


def test_streaks_by_null_keys(spark):
    rows = [("a", 1, "length"), ("a", 2, "stop"), ("a", 3, "length"), ("a", 4, "length"), (None, 1, "length"), (None, 2, None), ("b", 5, "length")]
    df = spark.createDataFrame(rows, "k string, attempt int, finish_reason string")
    assert {r.k: r.streak for r in attempts.truncation_streaks(df, ["k"]).collect()} == {"a": 2, None: 0, "b": 1}


@pytest.mark.parametrize("n,shards", [(1, 7), (5, 7), (7, 7), (23, 6), (100, 3)])
def test_contiguous_shards(spark, n, shards):
    got = partitioning.contiguous_shards(spark.range(n), shards, "id").collect()
    assert all(r.shard == max(i for i in range(shards) if n * i // shards <= r.pos) for r in got)


def test_replay(spark):
    log = [("a", "central_turn", "complete"), ("a", "finalize_candidate", "complete"), ("a", "central_turn", "complete"), ("b", "central_turn", "complete"), ("c", "central_turn", "complete"), ("c", "generate_video", "running")]
    log += [("d", "extract_frames", "failed")] * 25 + [("e", "generate_video", "complete")] * 5 + [("f", "central_turn", "complete")] * 31
    df = spark.createDataFrame([(k, i, t, s) for i, (k, t, s) in enumerate(log)], "case_id string, seq int, tool_name string, status string")
    got = {r.case_id: r for r in workflow.replayed(df).collect()}
    assert (got["a"].completed, got["a"].rescue_reason, got["a"].calls, got["a"].remaining_api_calls) == (True, None, 1, 29)
    assert got["b"].rescue_reason == workflow.NO_CALL and got["c"].rescue_reason is None
    assert (got["d"].calls, got["d"].used_actions, got["d"].remaining_actions, got["d"].rescue_reason) == (20, 20, 0, workflow.EXHAUSTED["actions"])
    assert (got["e"].used_videos, got["e"].rescue_reason) == (3, workflow.EXHAUSTED["videos"])
    assert (got["f"].used_api_calls, got["f"].rescue_reason) == (30, workflow.EXHAUSTED["api_calls"])


def test_rescue_chain(spark):
    c = spark.createDataFrame([("a", "vid-1", "video", "active"), ("a", "vid-2", "video", "active"), ("a", "vid-3", "video", "rejected"), ("a", "img-1", "image", "active"), ("b", "img-1", "image", "active"), ("b", "vid-1", "video", "rolled_back"), ("c", "img-1", "image", "rejected")], "case_id string, candidate_id string, kind string, status string")
    seen = spark.createDataFrame([("a", "vid-1", 3), ("a", "vid-2", 1)], "case_id string, candidate_id string, severity int")
    calls = spark.createDataFrame([], "case_id string, seq int, status string, preferred_candidate_id string, ranking array<string>")
    plans = workflow.rescue_plans(c, seen, calls)
    assert sorted(map(tuple, plans.collect())) == [("a", "video", "vid-2", ["vid-1"]), ("b", "image", "img-1", []), ("c", "prompt", None, [])]
    after = {(r.case_id, r.candidate_id): r.status for r in workflow.rescued(c, plans).collect()}
    assert after["a", "vid-2"] == "finalized" and after["a", "vid-1"] == "rolled_back" and after["a", "vid-3"] == "rejected"
    assert after["a", "img-1"] == after["b", "img-1"] == "active" and after["c", "img-1"] == "rejected"


def test_leaks(spark):
    cases = spark.createDataFrame([(str(k), [(f"T{k}", v)]) for k, v in enumerate(["ab", "bc", "", None, "abc", "é", "ab"])], "id string, private_targets array<struct<id:string,verbatim:string>>")
    docs = spark.createDataFrame([(1, "xabcx"), (2, None), (3, "é"), (4, "")], "doc_id int, text string")
    want = {1: 5, 2: 0, 3: 2, 4: 1}
    assert {r.doc_id: r.n_cases for r in prompts.leaked_cases(docs, cases).collect()} == want
    assert {r.doc_id: r.n_cases for r in prompts.leaked_cases(docs, cases, most=0).collect()} == want
    assert {r.doc_id: r.n_cases for r in prompts.leaked_cases(docs, cases.where("id = '5'"), most=0).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert prompts.leaked_cases(docs.limit(0), cases, most=0).collect() == []
    assert {r.n_cases for r in prompts.leaked_cases(docs, cases.limit(0), most=0).collect()} == {0}


def test_leaks_of_many_targets_by_grams(spark):
    """A target in a third of all texts, targets that share all grams but few, and ones of every width."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abé漢 ") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts = ["".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(150)]
    texts = [t + "a hot passage of many words" if k % 3 == 0 else t for k, t in enumerate(texts)] + [None, "", "x" * 50_000 + "needle in it"]
    targets = ["a hot passage of many words", "hot passage of m", "needle in it", "needle in is", "x" * 40, "é", "漢a", "a", "ab", "abé"] + [t[i : i + n] for t in texts[:40] if t for i, n in [(rng.randrange(len(t)), rng.randint(1, 30))]]
    targets += ["".join(rng.choices(words, k=4)) + "zz" for _ in range(300)]
    cases = spark.createDataFrame([(f"c{k % 200}", [("T", t)]) for k, t in enumerate(targets)], "id string, private_targets array<struct<id:string,verbatim:string>>")
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(1, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = sorted((str(i), len({f"c{k % 200}" for k, v in enumerate(targets) if t is not None and v in t})) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_cases) for r in prompts.leaked_cases(docs, cases, most=0).collect()) == want
    distinct = spark.createDataFrame([(k, t) for k, t in enumerate(sorted(set(targets)))], "target long, verbatim string")
    for salted in (1, 10_000):
        got = Counter((r.doc_id, r.target) for r in leaks.occurrences_in(docs, distinct, salted).collect())
        assert set(got) == {(i, k) for i, t in rows if t is not None for k, v in enumerate(sorted(set(targets))) if v in t}


def test_spread_rows(spark):
    assert spread_rows(spark.range(100)).rdd.getNumPartitions() > 1
    assert sorted(r.id for r in spread_rows(spark.range(100)).collect()) == list(range(100))


# ------------------------------------------------------------------ what signs are judged by


def test_bars_and_groups():
    around = tokenizer._Context("a |b| c| d |e |f|g (x | y] | z) [|q|")
    bars = [i for i, c in enumerate(around.text) if c == "|"]
    pair = lambda i, j: j > i + 1 and around.text[i + 1] != " " and around.text[j - 1] != " "
    assert around.paired_bars == {x for i, j in zip(bars, bars[1:], strict=False) if pair(i, j) for x in (i, j)}
    t = around.text
    grouped = {i for i in bars if any(t.rfind(o, 0, i) > t.rfind(c, 0, i) and t.find(c, i) > 0 for o, c in ("()", "[]", "{}"))}
    assert around.grouped_bars == grouped


@settings(max_examples=200, deadline=None)
@given(st.text("a1 |(){}[]/=.;é", max_size=24))
def test_neighbours(line):
    line = tokenizer.normalize(line)
    around = tokenizer._Context(line)
    for at in range(len(line)):
        before, after = line[:at].rstrip(" "), line[at + 1 :].lstrip(" ")
        for told, c, more, brackets in ((around.left(at), before[-1:], before[-2:-1], ")]}"), (around.right(at), after[:1], after[1:2], "([{")):
            want = "number" if c.isdigit() else ("word" if more.isalpha() else "variable") if c.isalpha() else "group" if c and c in brackets else ""
            assert told == want
        signed = any("=" in part for part in [line[max(line.rfind(x, 0, at) for x in ".;") + 1 : min([k for k in range(at, len(line)) if line[k] in ".;"], default=len(line))]]) if not any(line[i] == "." and line[i - 1 : i].isdigit() and line[i + 1 : i + 2].isdigit() for i in range(len(line))) else None
        if line[at] == "/" and signed is not None:
            assert around.slash(at) == (before[-1:] in tuple(")]}") or line[at + 1 : at + 2] in tuple("([{") or signed)


def test_event_faults(spark):
    log = [("add", "video"), ("finalize", "video"), ("add", "video"), ("reject", "video"), ("finalize", "video"), ("rollback", "video")]
    df = spark.createDataFrame([("a", "v", i, e, k) for i, (e, k) in enumerate(log)] + [("a", "i", 9, "add", "image"), ("a", "i", 10, "finalize", "image"), ("a", "w", 3, "observe", "video")], "case_id string, candidate_id string, seq int, event string, kind string")
    got = {(r.candidate_id, r.seq): r.fault for r in candidates.event_faults(df).collect()}
    assert [got["v", i] for i in range(6)] == [None, None, "exists", None, "gone", None]
    assert got["i", 10] == "not_a_video" and got["w", 3] == "unknown"


LOG = "case_id string, seq int, event string, candidate_id string, kind string, parent_id string"


def test_fold_of_a_run(spark):
    """Finalised again, rolled back after, refused, and added twice."""
    log = [
        ("a", 1, "add", "img-1", "image", None), ("a", 2, "add", "vid-1", "video", "img-1"), ("a", 3, "add", "vid-2", "video", "img-9"), ("a", 4, "add", "vid-2", "video", "vid-1"), ("a", 5, "finalize", "vid-1", None, None),
        ("a", 6, "add", "vid-1", "video", None), ("a", 7, "finalize", "vid-2", None, None), ("a", 8, "observe", "vid-2", None, None), ("a", 9, "rollback", "vid-2", None, None), ("a", 10, "finalize", "vid-2", None, None), ("a", 11, "finalize", "img-1", None, None),
        ("b", 1, "add", "v", "video", ""), ("b", 2, "reject", "v", None, None), ("b", 3, "rollback", "v", None, None), ("b", 4, "finalize", "w", None, None), ("b", 5, "prefer", "w", None, None), ("c", 1, "observe", "x", None, None), (None, 1, "add", "n", "video", None),
    ]
    events = spark.createDataFrame(log, LOG)
    assert {(r.case_id, r.candidate_id): (r.state, r.observations) for r in candidates.candidate_states(events).collect()} == {("a", "img-1"): ("active", 0), ("a", "vid-1"): ("active", 0), ("a", "vid-2"): ("rolled_back", 1), ("b", "v"): ("rolled_back", 0), (None, "n"): ("active", 0)}
    faults = {(r.case_id, r.seq): r.fault for r in candidates.event_faults(events).collect()}
    assert {k: v for k, v in faults.items() if v} == {("a", 3): "unknown_parent", ("a", 6): "exists", ("a", 10): "gone", ("a", 11): "not_a_video", ("b", 4): "unknown", ("c", 1): "unknown"} and len(faults) == len(log)
    # a selection that was rolled back stays the run's selection
    assert {r.case_id: (r.final_candidate_id, r.completed, r.refused) for r in candidates.selections(events).collect()} == {"a": ("vid-2", True, 4), "b": (None, False, 1), "c": (None, False, 1), None: (None, False, 0)}
    assert candidates.folded(events.limit(0)).collect() == []


def test_fold_at_random(spark):
    """Against a plain replay of each run, over batches of three rows."""
    rng = random.Random(6)
    log = [(f"r{rng.randrange(5)}", k, rng.choice(["add", "add", "observe", "finalize", "reject", "rollback", "look"]), f"c{rng.randrange(6)}", rng.choice(["video", "video", "image"]), rng.choice([None, None, f"c{rng.randrange(6)}"])) for k in range(400)]
    status: dict = {}
    for case, _, event, name, kind, parent in log:
        own = status.setdefault(case, {})
        if event == "add" and name not in own and (parent is None or parent in own):
            own[name] = [kind, "active"]
        elif name in own and event in ("reject", "rollback"):
            own[name][1] = {"reject": "rejected", "rollback": "rolled_back"}[event]
        elif name in own and event == "finalize" and own[name] in (["video", "active"], ["video", "finalized"]):
            for other in own.values():
                if other[1] == "finalized":
                    other[1] = "active"
            own[name][1] = "finalized"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.case_id, r.candidate_id): [r.kind, r.state] for r in candidates.candidate_states(spark.createDataFrame(log, LOG)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(case, name): v for case, own in status.items() for name, v in own.items()}


def test_rescue_of_runs_without_candidates(spark):
    c = spark.createDataFrame([("a", "img-1", "image", "active"), ("b", "vid-1", "video", "active"), ("b", "vid-2", "video", "active")], "case_id string, candidate_id string, kind string, status string")
    seen = spark.createDataFrame([("b", "vid-1", 3)], "case_id string, candidate_id string, severity int")
    calls = spark.createDataFrame([("d", 1, "failed", None, None)], "case_id string, seq int, status string, preferred_candidate_id string, ranking array<string>")
    runs = spark.createDataFrame([(k, f"prompt {k}", "why") for k in "abc"], "case_id string, prompt_en string, rescue_reason string")
    plans = workflow.rescue_plans(c, seen, calls, runs=runs)
    assert sorted(map(tuple, plans.collect())) == [("a", "image", "img-1", []), ("b", "video", "vid-1", ["vid-2"]), ("c", "prompt", None, [])]
    assert {r.case_id for r in workflow.rescue_plans(c, seen, calls).collect()} == {"a", "b", "d"}
    told = {(r.case_id, r.tool_name): json.loads(r.arguments) for r in workflow.rescue_calls(plans, runs).collect()}
    assert sorted(told) == [("a", "finalize_candidate"), ("a", "generate_video"), ("b", "finalize_candidate"), ("c", "finalize_candidate"), ("c", "generate_keyframes"), ("c", "generate_video")]
    assert told["c", "generate_keyframes"] == {"diagnosis": "Guaranteed-delivery rescue: why", "generation_prompt": "prompt c", "negative_prompt": workflow.RESCUE_NEGATIVE, "count": 1, "vary": [], "parent_id": None, "rollback_candidate_ids": []}
    assert told["a", "generate_video"]["keyframe_id"] == "img-1" and told["b", "finalize_candidate"]["rollback_candidate_ids"] == ["vid-2"]
    # calls that a rescue makes pass the checks of any call, once ids are filled in
    both = workflow.rescue_calls(plans, runs).withColumn("arguments", F.replace("arguments", F.lit(":null"), F.lit(':"x"')))
    assert {r.tool_name: r.errors for r in tools.argument_faults(both).collect()} == {"generate_keyframes": [], "generate_video": [], "finalize_candidate": []}


def test_next_ids_by_prefix(spark):
    c = spark.createDataFrame([("a", "img-0007"), ("a", "ximg-0099"), ("a", "vid-2"), ("b", "other-3")], "case_id string, candidate_id string")
    assert {r.case_id: r[1:] for r in workflow.next_ids(c).collect()} == {"a": ("img-0008", "vid-0003"), "b": ("img-0001", "vid-0001")}


def test_effects_of_rollbacks(spark):
    df = spark.createDataFrame([("a", 1, "generate_video", '{"keyframe_id":"k","rollback_candidate_ids":["x","y"]}', '{"candidate_ids":["vid-1"]}', "complete"), ("a", 2, "extract_frames", '{"candidate_id":"x"}', "{}", "complete")], "case_id string, seq int, tool_name string, arguments string, result string, status string")
    assert [(r.place, r.event, r.candidate_id, r.parent_id) for r in tools.call_effects(df).orderBy("place").collect()] == [(0, "add", "vid-1", "k"), (1, "rollback", "x", None), (2, "rollback", "y", None)]
