import json

import pytest
from pyspark.sql import functions as F

from textgauge.functions.registry import register
from textgauge.operators import diagnostics, tools, validation
from textgauge.plans.runs import summarize_run
from textgauge.sources import config


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def test_wer_run(spark, tmp_path):
    jobs = [("p", "AD-0001"), ("p", "UI-0002"), ("q", "AD-0001")]
    write(tmp_path / "run_manifest.json", {"job_identities": [{"profile": p, "case_id": c} for p, c in jobs]})
    item = lambda r, h: {"text_id": "T01", "reference": r, "hypothesis": h}
    write(tmp_path / "p/AD-0001/case_status.json", {"status": "pass"})
    write(tmp_path / "p/AD-0001/score.json", {"items": [item("a b", "a b"), item("c d", "")]})
    write(tmp_path / "p/UI-0002/case_status.json", {"status": "pass_after_max_attempts"})
    write(tmp_path / "p/UI-0002/score.json", {"items": [item("a b", "a b z z z z z z z z")]})
    r = summarize_run(spark, str(tmp_path), "wer")
    assert r["status_counts"] == {"pass": 1, "pass_after_max_attempts": 1, "pending": 1} and not r["all_scored"]
    assert r["unscored_cases"] == [{"profile": "q", "case_id": "AD-0001", "status": "pending"}]
    assert r["overall"]["case_balanced_wer"] == {"R+1": 0.5, "R+5": 0.75, "R+10": 0.75} and r["overall"]["scored_videos"] == 2
    assert r["by_scene"]["UI"]["case_balanced_wer"]["R+1"] == 0.5 and set(r["by_profile"]) == {"p"}
    with pytest.raises(ValueError):
        summarize_run(spark, str(tmp_path), "wer", ids=["AD-0001"])


def test_checklist_run(spark, tmp_path):
    write(tmp_path / "run_manifest.json", {"job_identities": [{"profile": "p", "case_id": "AD-0001"}]})
    write(tmp_path / "p/AD-0001/case_status.json", {"status": "pass"})
    items = [{"id": i, "answer": "yes" if k < 15 else "no", "dimension": validation.DIMENSIONS[k % 4]} for k, i in enumerate(validation.ITEM_IDS)]
    write(tmp_path / "p/AD-0001/result.json", {"profile": "p", "case_id": "AD-0001", "items": items})
    r = summarize_run(spark, str(tmp_path), "checklist", ids=["AD-0001"])
    assert r["all_scored"] and r["overall"]["yes_rate"] == 0.75 and r["overall"]["scored_videos"] == 1
    assert r["by_profile"]["p"]["dimensions"]["Scene Attributes"]["yes_rate"] is None
    assert r["overall"]["dimensions"]["Entity Presence"]["item_count"] == 5
    write(tmp_path / "p/AD-0001/result.json", {"profile": "p", "case_id": "AD-0001", "items": items[:19]})
    with pytest.raises(ValueError):
        summarize_run(spark, str(tmp_path), "checklist")
    write(tmp_path / "p/AD-0001/result.json", {"profile": "z", "case_id": "AD-0001", "items": items})
    with pytest.raises(ValueError):
        summarize_run(spark, str(tmp_path), "checklist")


def test_tools(spark):
    rows = [
        ("generate_keyframes", {"diagnosis": "d", "generation_prompt": "g", "vary": ["mood"], "count": 5}, ["count", "vary"]),
        ("inspect_keyframes", {"diagnosis": "d", "candidate_ids": []}, ["candidate_ids"]),
        ("extract_frames", {"diagnosis": "d", "candidate_id": "v", "positions_seconds": [0, 11]}, ["positions_seconds"]),
        ("extract_frames", {"diagnosis": "d", "candidate_id": "v", "positions_seconds": [0, 10]}, []),
        ("edit_keyframe", {"diagnosis": "", "candidate_id": "v", "edit_instruction": "e", "x": 1}, ["unknown_field", "diagnosis"]),
        ("finalize_candidate", {"diagnosis": "d", "candidate_id": "v", "rationale": "r", "rollback_candidate_ids": ["w", "w"]}, ["rollback_repeated"]),
        ("dance", {"diagnosis": "d"}, ["tool"]),
        ("inspect_video", None, ["not_an_object", "diagnosis", "candidate_id"]),
    ]
    calls = spark.createDataFrame([("a", k, n, None if v is None else json.dumps(v)) for k, (n, v, _) in enumerate(rows)], "case_id string, seq int, tool_name string, arguments string")
    assert [r.errors for r in tools.argument_faults(calls).orderBy("seq").collect()] == [e for *_, e in rows]
    assert [r.candidate_id for r in tools.unknown_rollbacks(calls, spark.createDataFrame([("a", "v")], "case_id string, candidate_id string")).collect()] == ["w", "w"]
    seen = json.dumps({"observations": [{"category": "text", "summary": "s", "severity": "high", "evidence_locations": ["x"]}]})
    log = spark.createDataFrame([("a", 1, "inspect_keyframes", '{"candidate_ids":["i1","i2"]}', "complete", seen), ("a", 2, "compare_candidates", '{"candidate_ids":["i1","i2"]}', "complete", seen), ("a", 3, "inspect_video", '{"candidate_id":"v"}', "failed", seen)], "case_id string, seq int, tool_name string, arguments string, status string, result string")
    assert sorted((r.candidate_id, r.severity) for r in tools.attached_observations(log).collect()) == [("i1", "high"), ("i2", "high")]
    r = spark.range(1).select(
        tools.trimmed_audio(F.sequence(F.lit(0), F.lit(99)), 24, 24, 3).alias("a"), F.size(tools.trimmed_frames(F.sequence(F.lit(0), F.lit(240)))).alias("f"), tools.trimmed_frames(F.array(F.lit(1))).alias("g"), tools.composed_prompt(F.lit("p"), F.lit("r"), ("A", "B", "C")).alias("p")
    ).first()
    assert r.a == [1, 2, 3] and r.f == 240 and r.g is None and r.p == "A\np\n\nB\nr\n\nC"


def test_sql_functions(spark):
    assert "explode_answer" in register(spark)
    assert spark.sql("SELECT text_tokens('a = b') t, edit_counts(array('a'), array('b', 'a')) e, legacy_text_tokens('a=b') l").first()[:] == (["a", "=", "b"], (1, 0, 0, 1), ["a", "=", "b"])
    raw = '<answer>{"T02":{"status":"transcribed","text":"x","readability_note":""}}</answer>'
    got = spark.sql(f"SELECT * FROM explode_answer('{raw}', array('T01', 'T02'))").collect()
    assert [(r.text_id, r.status, r.text) for r in got] == [("T01", "text_unreadable", ""), ("T02", "transcribed", "x")]


def test_config(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿apiKey,k\nopenAiCompatible,http://x/\n,y\n", encoding="utf-8")
    s = config.service_from_env("CHAT", {"CHAT_CREDENTIAL_FILE": f"{tmp_path}/c.csv"})
    assert (s.base_url, s.key) == ("http://x", "k") and "k'" not in repr(s)
    with pytest.raises(ValueError):
        config.service_from_env("CHAT", {})
    assert config.runs_root("/a", {"RUNS_ROOT": "b"}).as_posix() == "/a/b"
    assert config.model_profiles(spark).count() == 10


def test_audit_schema_and_counts(spark):
    s = diagnostics.answer_schema(["T01"])
    assert s["required"] == ["T01"] and len(s["properties"]["T01"]["oneOf"]) == 3
    w = spark.createDataFrame([(0, "a", "completed"), (0, "b", "running"), (1, "c", "failed")], "worker int, case_id string, state string")
    assert sorted(map(tuple, diagnostics.worker_status(w).collect())) == [(0, 2, 1, 0, "b"), (1, 1, 0, 1, None)]


def test_validation_summary(spark):
    c = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"])], "id string, required_text array<string>")
    k = spark.createDataFrame([("a", ["q"] * 20), ("b", ["q"] * 20)], "id string, checklist array<string>")
    assert tuple(diagnostics.validation_summary(c, k).first()) == (2, 3, 40)
