import json

import pytest
from pyspark.sql import functions as F

from textgauge.functions import text
from textgauge.operators import attempts, candidates, matching, partitioning, prompts, validation, workflow
from textgauge.plans import reports
from textgauge.sources import readers, sinks

TARGET = {"id": "T01", "carrier": "sign", "language": "en", "verbatim": "OPEN"}


def cases(spark, *rows):
    schema = "id string, prompt_en string, required_text array<struct<id:string,carrier:string,language:string,verbatim:string>>"
    return spark.createDataFrame([(i, p, None if t is None else [tuple(x.values()) for x in t]) for i, p, t in rows], schema)


def test_case_faults(spark):
    good = {**TARGET}
    rows = [
        ("AD-0001", "an OPEN sign", [good]),
        ("AD-0001\n", "x", [good]),
        ("ART-0001", "x", [good]),
        ("SCI-0001", " \u001c", [good]),
        ("SCI-0002", "x", []),
        ("SCI-0003", "x", [good, good]),
        ("SCI-0004", "x", [{**good, "id": "T1"}]),
        ("SCI-0005", "x", [{**good, "carrier": " "}]),
        ("SCI-0006", "x", [{**good, "verbatim": "..."}]),
        ("UI-0001", "x", [good]),
        ("UI-0001", "x", [good]),
        (None, None, None),
    ]
    got = [(r.id, r.errors) for r in validation.case_faults(cases(spark, *rows)).collect()]
    find = lambda i: [e for x, e in got if x == i]
    assert find("AD-0001") == [[]] and find("AD-0001\n") == find("ART-0001") == [["case_id"]]
    assert find("SCI-0001") == [["prompt_blank"]] and find("SCI-0002") == [["no_targets"]]
    assert find("SCI-0003") == [["target_id_repeated"]] and find("SCI-0004") == [["target_id"]]
    assert find("SCI-0005") == [["target_field_blank"]] and find("SCI-0006") == [["no_scored_token"]]
    assert find("UI-0001") == [["case_id_repeated"]] * 2 and find(None) == [["case_id", "prompt_blank", "no_targets"]]


def test_checklist_faults(spark):
    ok = [(i, "Entity Presence", "q?") for i in validation.ITEM_IDS]
    rows = [("a", ok), ("b", ok[:19]), ("c", ok[::-1]), ("d", [("C01", "Mood", " "), *ok[1:]]), ("e", None)]
    df = spark.createDataFrame(rows, "id string, checklist array<struct<id:string,dimension:string,question_en:string>>")
    got = {r.id: r.errors for r in validation.checklist_faults(df).collect()}
    assert got == {"a": [], "b": ["item_ids"], "c": ["item_ids"], "d": ["dimension", "question_blank"], "e": ["item_ids"]}


def test_masking_and_requests(spark):
    other = {**TARGET, "id": "T02", "verbatim": "24 h"}
    rows = [
        ("AD-0001", 'An OPEN sign, "24 h" below', [TARGET, other]),
        ("AD-0002", "OPEN and OPEN", [TARGET]),
        ("AD-0003", "shut", [TARGET]),
        ("AD-0004", "OPENING at 9", [TARGET, {**other, "verbatim": "OPENING"}]),
    ]
    m = {r.id: r for r in prompts.mask(cases(spark, *rows)).collect()}
    assert m["AD-0001"].masked_prompt == 'An [TARGET T01] sign, "[TARGET T02]" below' and m["AD-0001"].mask_errors == []
    assert m["AD-0002"].mask_errors == m["AD-0003"].mask_errors == ["T01:occurrences"]
    assert m["AD-0004"].mask_errors == ["T02:occurrences"]
    df = prompts.mask(cases(spark, *rows[:1]))
    sent = df.select(prompts.transcription_request(F.col("masked_prompt"), F.col("public_targets"), "EX", F.lit("Try again.")).alias("r"), "private_targets")
    r = sent.withColumn("leak", prompts.leaks(F.col("r"), F.col("private_targets"))).first()
    public = [{"id": "T01", "carrier": "sign", "language": "en"}, {"id": "T02", "carrier": "sign", "language": "en"}]
    assert json.dumps(public, ensure_ascii=False, indent=2) in r.r and r.r.endswith("PREVIOUS ATTEMPT FEEDBACK\n\nTry again.") and not r.leak
    q = spark.createDataFrame([([("C01", "d", "Is it?"), ("C02", "d", "And?")],)], "c array<struct<id:string,dimension:string,question_en:string>>")
    body = q.select(prompts.checklist_request(F.col("c")).alias("r")).first().r
    assert 'C01: Is it?\nC02: And?\n' in body and '<answer>[{"id":"C01","answer":"yes"},{"id":"C02","answer":"no"}]</answer>' in body


def test_selection_errors(spark):
    c = spark.createDataFrame([("a",), ("b",)], "case_id string")
    v = spark.createDataFrame([("a", "x")], "case_id string, path string")
    chosen, missing = matching.select_videos(v, c)
    assert [r.case_id for r in chosen.collect()] == ["a"] and [r.case_id for r in missing.collect()] == ["b"]
    for videos, requested in ((v.union(v), None), (v.union(spark.createDataFrame([("z", "x")], v.schema)), None), (v, spark.createDataFrame([("q",)], c.schema)), (v, c), (v.limit(0), None)):
        with pytest.raises(ValueError):
            matching.select_videos(videos, c, requested)
    jobs = v.withColumn("profile", F.lit("p"))
    assert matching.build_jobs(jobs, c, ["p:a"], 1).count() == 1
    for names, n in ((["pa"], 0), (["p:b"], 0), (None, 2)):
        with pytest.raises(ValueError):
            matching.build_jobs(jobs, c, names, n)
    assert spark.createDataFrame([([1, 2], ["x", "y"])], "a array<int>, b array<string>").select(matching.zip_exact("a", "b").alias("z")).first().z[1].b == "y"
    with pytest.raises(Exception, match="not true"):
        spark.createDataFrame([([1], ["x", "y"])], "a array<int>, b array<string>").select(matching.zip_exact("a", "b")).collect()


def test_attempts(spark):
    rows = [("p", "a", 1, False, True), ("p", "a", 2, True, True), ("p", "b", 1, False, True), ("p", "c", 1, False, True), ("p", "c", 2, False, False), ("p", "c", 3, False, True), ("p", "d", 3, False, False), ("p", "d", 1, False, True), ("p", "d", 2, False, True)]
    df = spark.createDataFrame(rows, "profile string, case_id string, attempt int, passed boolean, parsed boolean")
    got = {r.case_id: (r.status, r.selected_attempt) for r in attempts.selected_attempts(df).collect()}
    assert got == {"a": ("pass", 2), "b": ("retrying", None), "c": ("pass_after_max_attempts", 3), "d": ("invalid", None)}
    strict = {r.case_id: r.status for r in attempts.selected_attempts(df, lenient=False).collect()}
    assert strict["c"] == "invalid"
    log = spark.createDataFrame([("p", "a", k, f) for k, f in enumerate(["length", "stop", "length", "length"])] + [("p", "b", 0, None), ("p", "c", 0, "length")], "profile string, case_id string, attempt int, finish_reason string")
    assert {r.case_id: r.streak for r in attempts.truncation_streaks(log).collect()} == {"a": 2, "b": 0, "c": 1}
    for recorded, current, has in ((None, "x", True), ("y", "x", False)):
        with pytest.raises(ValueError):
            attempts.resume_guard(recorded, current, has)
    attempts.resume_guard("x", "x", True)


def test_workflow(spark):
    names = ["central_turn"] * 31
    calls = spark.createDataFrame([("a", k, n) for k, n in enumerate(names)] + [("b", k, "generate_video") for k in range(5)] + [("c", k, "extract_frames") for k in range(22)], "case_id string, seq int, tool_name string")
    got = {r.case_id: (r.seq, r.exceeds) for r in workflow.first_violation(calls).collect()}
    assert got == {"a": (30, "api_calls"), "b": (3, "videos"), "c": (20, "actions")}
    events = spark.createDataFrame([("a", 1, "v1", "add"), ("a", 2, "v2", "add"), ("a", 3, "v1", "finalize"), ("a", 4, "v2", "finalize"), ("a", 5, "v3", "add"), ("a", 6, "v3", "rollback")], "case_id string, seq int, candidate_id string, event string")
    assert {r.candidate_id: r.state for r in candidates.candidate_states(events).collect()} == {"v1": "active", "v2": "finalized", "v3": "rolled_back"}
    cand = spark.createDataFrame([("a", "vid-0001", "video", "active", None), ("a", "vid-0002", "video", "active", "img-0009"), ("b", "vid-0001", "video", "active", None), ("b", "vid-0002", "video", "active", None)], "case_id string, candidate_id string, kind string, status string, parent_id string")
    assert [r.candidate_id for r in workflow.orphans(cand).collect()] == ["vid-0002"]
    obs = spark.createDataFrame([("b", "vid-0001", 3), ("b", "vid-0001", 3), ("a", "vid-0001", 0)], "case_id string, candidate_id string, severity int")
    cmp = spark.createDataFrame([("a", 1, "complete", "vid-0001", ["vid-0002"]), ("a", 9, "complete", "vid-0077", ["vid-0078", "vid-0002"]), ("a", 10, "failed", "vid-0001", [])], "case_id string, seq int, status string, preferred_candidate_id string, ranking array<string>")
    got = {r.case_id: (r.candidate_id, r.chosen_by) for r in workflow.rescue(cand, obs, cmp).collect()}
    # an inspected bad video beats one that nobody looked at
    assert got == {"a": ("vid-0002", "preference"), "b": ("vid-0001", "severity")}
    media = spark.createDataFrame([("a", "vid-0001", 240, 24.0, 10.0), ("a", "vid-0002", 239, 24.0, 10.0)], "case_id string, candidate_id string, frames int, rate double, duration double")
    assert [(r.case_id, r.candidate_id) for r in workflow.rescue(cand, obs, cmp, media).collect()] == [("a", "vid-0001")]
    assert workflow.next_ids(cand).where("case_id = 'a'").first()[1:] == ("img-0001", "vid-0003")
    assert spark.range(1).select(workflow.recent(F.array(*map(F.lit, range(3)))).alias("x"), workflow.recent(F.array(*map(F.lit, range(12)))).alias("y")).first() == ([0, 1, 2], list(range(4, 12)))


@pytest.mark.parametrize("n,shards", [(0, 3), (1, 3), (10, 3), (7, 7), (5, 8), (101, 4)])
def test_contiguous_shards(spark, n, shards):
    got = {r.id: (r.pos, r.shard) for r in partitioning.contiguous_shards(spark.range(n), shards, "id").collect()}
    want = {i: (i, next(k for k in range(shards) if n * k // shards <= i < n * (k + 1) // shards)) for i in range(n)}
    assert got == want


def test_text_functions(spark):
    rows = [("a" * 64,), ("ab" * 64,), ("x" + " \t" * 32,), ("plain",), (None,), ("\n" * 70,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(text.repetition_warnings(F.col("t"))).collect()]
    assert got[:4] == [["same_character_run_ge_64"], ["substring_2_to_16_repeated_ge_16_covering_ge_128"], ["whitespace_run_ge_64"], []]
    assert got[5] == ["same_character_run_ge_64", "whitespace_run_ge_64"]
    d = df.select(text.repetition_details("t").alias("d")).collect()
    assert d[1].d.longest_repeated_substring_run.unit == "ab" and d[4].d is None
    two = spark.createDataFrame([("go on", "go on: - fast"), ("go", "slow"), ("go", " go")], "p string, r string")
    assert [r[0] for r in two.select(text.strip_repeated_prompt(F.col("p"), F.col("r"))).collect()] == ["fast", "slow", None]
    assert [r[0] for r in spark.range(1, 40).select(text.aligned_frames(F.col("id"))).collect()][:6] == [5, 5, 5, 5, 5, 22]
    b = spark.createDataFrame([("a <answer> x </answer><answer>y</answer>",), ("<answer>z",)], "t string").select(text.answer_block(F.col("t")).alias("b")).collect()
    assert tuple(b[0].b) == (2, "x", True, True, 1) and tuple(b[1].b) == (0, None, True, False, 0)
    assert text.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert [r[0] for r in spark.createDataFrame([("high",), (" Info ",), ("2",), ("4",), ("?",), (None,)], "s string").select(validation.severity(F.col("s"))).collect()] == [3, 0, 2, None, None, None]
    assert [r[0] for r in spark.createDataFrame([("a/b c",), ("..",), ("",)], "s string").select(validation.safe_name(F.col("s"))).collect()] == ["a_b_c", None, None]


def test_readers_and_sinks(spark, tmp_path):
    case = {"id": "AD-0001", "prompt_en": "an OPEN sign", "required_text": [TARGET]}
    (tmp_path / "prompts.json").write_text(json.dumps({"cases": [case]}))
    assert readers.read_cases(spark, f"{tmp_path}/prompts.json").first().id == "AD-0001"
    (tmp_path / "bad.json").write_text(json.dumps({"cases": [{**case, "id": "X"}]}))
    with pytest.raises(ValueError):
        readers.read_cases(spark, f"{tmp_path}/bad.json")
    items = [{"id": i, "dimension": "Entity Presence", "question_en": "q"} for i in validation.ITEM_IDS]
    (tmp_path / "checklists.json").write_text(json.dumps({"cases": [{"id": "AD-0001", "checklist": items}]}))
    assert len(readers.read_checklists(spark, f"{tmp_path}/checklists.json").first().checklist) == 20
    suite = {"suite": "s", "case_count": 1, "checklist_count_per_case": 20, "cases": [{"case_id": "AD-0001", "family": "f", "checklist": [{"id": i, "category": "Entity Presence", "question_en": "q", "expected_answer": "yes"} for i in validation.ITEM_IDS]}]}
    (tmp_path / "suite.json").write_text(json.dumps(suite))
    assert readers.read_suite(spark, f"{tmp_path}/suite.json").first().checklist[3].dimension == "Entity Presence"
    (tmp_path / "suite2.json").write_text(json.dumps({**suite, "case_count": 2}))
    with pytest.raises(ValueError):
        readers.read_suite(spark, f"{tmp_path}/suite2.json")
    (tmp_path / "p.csv").write_text('﻿global_id,id,prompt_en\n,AD-0002,"two, ""q"""\nAD-0001,zz,one\n', encoding="utf-8")
    (tmp_path / "p.jsonl").write_text('{"id": "AD-0003", "prompt_en": "three"}\n\n')
    csv = readers.read_prompts(spark, f"{tmp_path}/p.csv")
    assert [r.case_id for r in readers.case_ids(csv).orderBy("ordinal").collect()] == ["AD-0002", "AD-0001"]
    assert readers.prompt_of(csv, "AD-0002") == 'two, "q"' and readers.prompt_of(readers.read_prompts(spark, f"{tmp_path}/p.jsonl"), "AD-0003") == "three"
    with pytest.raises(KeyError):
        readers.prompt_of(csv, "nope")
    (tmp_path / "v").mkdir()
    for n in ("AD-0001.mp4", "AD-0002.MP4", "x.txt"):
        (tmp_path / "v" / n).write_bytes(b"0")
    assert sorted(r.case_id for r in readers.read_videos(spark, f"{tmp_path}/v").collect()) == ["AD-0001", "AD-0002"]
    (tmp_path / "w" / "AD-0001").mkdir(parents=True)
    (tmp_path / "w" / "AD-0001" / "seed42.mp4").write_bytes(b"0")
    assert readers.read_videos(spark, f"{tmp_path}/w", "p").first()[:2] == ("p", "AD-0001")
    run = tmp_path / "run" / "p" / "AD-0001"
    (run / "round_2").mkdir(parents=True)
    (run / "case_status.json").write_text('{"status": "pass", "selected_round": 2}')
    (run / "result.json").write_text(json.dumps({"profile": "p", "case_id": "AD-0001", "items": [{"id": "C01", "answer": "yes"}]}))
    (run / "score.json").write_text(json.dumps({"items": [{"text_id": "T01", "reference": "a", "hypothesis": "b"}]}))
    (run / "round_2" / "response.json").write_text('{"raw": "x", "finish_reason": "length", "output_token_count": 3}')
    root = f"{tmp_path}/run"
    assert tuple(readers.read_statuses(spark, root).first()) == ("p", "AD-0001", "pass", 2)
    assert readers.read_checklist_results(spark, root).first().items[0].answer == "yes"
    assert readers.read_scores(spark, root).first().items[0].hypothesis == "b"
    assert tuple(readers.read_attempt_log(spark, f"{root}/p").first())[:2] == ("AD-0001", 2)
    assert partitioning.run_identity(readers.read_inventory(spark, f"{tmp_path}/v")).first().files == 3
    probe = spark.createDataFrame([('{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":4,"height":3,"nb_frames":"240","avg_frame_rate":"24000/1001"}],"format":{"duration":"10.01"}}',)], "j string")
    r = probe.select(readers.parse_probe(F.col("j")).alias("p")).first().p
    assert (r.width, r.frames, round(r.rate, 3), r.duration) == (4, 240, 23.976, 10.01)
    df = spark.createDataFrame([("a", "h1", "x")], "case_id string, sha256 string, path string")
    sinks.write_audit(df, f"{tmp_path}/audit", "case_id")
    sinks.append_events(df, f"{tmp_path}/events")
    sinks.append_events(df, f"{tmp_path}/events")
    assert spark.read.parquet(f"{tmp_path}/events").count() == 2
    sinks.write_json_report(df, f"{tmp_path}/report")
    sinks.write_text(df, "path", f"{tmp_path}/text")
    assert sinks.to_publish(df, df).count() == 0 and sinks.to_publish(df, df.limit(0)).count() == 1
    with pytest.raises(ValueError):
        sinks.to_publish(df, df.withColumn("sha256", F.lit("other")))
    assert [r.fault for r in partitioning.changed_artifacts(df, df.withColumn("sha256", F.lit("q"))).collect()] == ["changed"]


def test_wer_report(spark):
    targets = spark.createDataFrame([("AD-0001", 0, "T01", "open now"), ("AD-0001", 1, "T02", "24 h"), ("UI-0002", 0, "T01", "save")], "case_id string, pos int, text_id string, verbatim string")
    ok = {"T01": {"status": "transcribed", "text": "open now", "readability_note": ""}, "T02": {"status": "carrier_not_found", "text": "", "readability_note": ""}}
    rows = [("p", "AD-0001", 1, "no", "stop", 1), ("p", "AD-0001", 2, f"<answer>{json.dumps(ok)}</answer>", "stop", 1), ("p", "UI-0002", 1, "<answer>{}</answer>", "stop", 1)]
    responses = spark.createDataFrame(rows, "profile string, case_id string, attempt int, raw string, finish_reason string, output_token_count int")
    jobs = spark.createDataFrame([("p", "AD-0001"), ("p", "UI-0002"), ("p", "UI-0003")], "profile string, case_id string")
    out = reports.wer_report(jobs, responses, targets)
    summary = {(r.n, r.level, r.profile or r.scene): r.case_balanced_wer for r in out["summary"].collect()}
    assert summary[5, "by_n_profile", "p"] == 0.5 and summary[1, "by_n_scene", "AD"] == 0.5 and summary[10, "by_n", None] == 0.5
    assert {r.status: (r.jobs, r.scored) for r in out["status_counts"].collect()} == {"pass": (1, 1), "retrying": (1, 0), "pending": (1, 0)}
    assert {r.case_id: r.status for r in out["unscored"].collect()} == {"UI-0002": "retrying", "UI-0003": "pending"}


def test_checklist_report(spark):
    raw = "<answer>" + json.dumps([{"id": i, "answer": "yes" if k % 4 else "no"} for k, i in enumerate(validation.ITEM_IDS)]) + "</answer>"
    responses = spark.createDataFrame([("p", "AD-0001", 1, raw, "stop", 1)], "profile string, case_id string, attempt int, raw string, finish_reason string, output_token_count int")
    questions = spark.createDataFrame([("AD-0001", k, i, validation.DIMENSIONS[k % 4], "q") for k, i in enumerate(validation.ITEM_IDS)], "case_id string, pos int, item_id string, dimension string, question_en string")
    out = reports.checklist_report(responses.select("profile", "case_id"), responses, questions)
    dims = {r.dimension: (r.yes_count, r.item_count, r.yes_rate) for r in out["dimensions"].collect()}
    assert dims["Entity Presence"] == (0, 5, 0.0) and dims["Scene Attributes"] == (0, 0, None)
    assert out["summary"].where("level = 'overall'").first().yes_rate == 0.75


def test_field_warnings(spark):
    targets = spark.createDataFrame([("AD-0001", 0, "T01", "x")], "case_id string, pos int, text_id string, verbatim string")
    raw = "<answer>" + json.dumps({"T01": {"status": "transcribed", "text": "ab" * 70, "readability_note": ""}}) + "</answer>"
    responses = spark.createDataFrame([("p", "AD-0001", 1, raw, "stop", 1)], "profile string, case_id string, attempt int, raw string, finish_reason string, output_token_count int")
    r = reports.field_warnings(reports.read_transcriptions(responses, targets)).collect()
    assert [(x.text_id, x.field) for x in r] == [("T01", "text")]
