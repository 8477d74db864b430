import hashlib
import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from textgauge.operators import prompts, rollups, validation, worker
from textgauge.functions import protocol
from textgauge.plans.evaluate import chosen_videos, evaluate
from textgauge.sources import files, media, readers


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return (struct.pack(">I4sQ", 1, kind, len(body) + 16) if wide else struct.pack(">I4s", len(body) + 8, kind)) + body


def full(kind, form, *values, version=0, flags=0, wide=False):
    return box(kind, struct.pack(">I", version << 24 | flags), struct.pack(form, *values), wide=wide)


def track(number, handler, scale, table, version=0, samples=None, wide=False):
    long = "Q" if version else "I"
    tkhd = full(b"tkhd", f">{long}{long}I", 0, 0, number, version=version)
    mdhd = full(b"mdhd", f">{long}{long}I{long}", 0, 0, scale, 0, version=version)
    entry = struct.pack(">I4s6xH2xH12xHH", 86, b"avc1", 1, 0, 1344, 768) + bytes(50)
    stsd = box(b"stsd", struct.pack(">II", 0, 1), entry)
    stts = full(b"stts", f">I{2 * len(table)}I", len(table), *[x for pair in table for x in pair])
    stsz = full(b"stsz", ">II", 4, samples if samples is not None else sum(n for n, _ in table))
    stbl = box(b"stbl", stsd, stts, stsz, wide=wide)
    return box(b"trak", tkhd, box(b"mdia", mdhd, full(b"hdlr", ">I4s", 0, handler), box(b"minf", stbl)))


def movie(*tracks, extra=b"", wide=False):
    return box(b"ftyp", b"isom") + box(b"moov", *tracks, extra, wide=wide)


def facts(data):
    seen = []

    def read(at, n):
        seen.append(n)
        return data[at : at + n]

    got = media.probe(read, len(data))
    return got, seen


def test_sample_tables():
    video = track(1, b"vide", 12288, [(239, 512), (1, 512)])
    whole = movie(track(2, b"soun", 48000, [(5, 1024)]), video) + box(b"mdat", bytes(1000))
    got, _ = facts(whole)
    assert got == {"width": 1344, "height": 768, "frames": 240, "rate": 24.0, "duration": 10.0, "fault": None}
    # 64-bit sizes and version 1 headers, the movie after the media, and a box to the end
    late = box(b"mdat", bytes(500), wide=True) + box(b"moov", track(1, b"vide", 24000, [(100, 1001)], version=1, wide=True), wide=True) + struct.pack(">I4s", 0, b"free") + bytes(9)
    got, _ = facts(late)
    assert (got["frames"], round(got["rate"], 3), got["fault"]) == (100, 23.976, None)
    many = track(1, b"vide", 1000, [(1, 40 + k % 2) for k in range(9000)])
    got, reads = facts(movie(many))
    assert got["frames"] == 9000 and got["duration"] == 364.5 and max(reads) <= 8 * 4096


def test_media_is_not_read():
    """A file whose media are a hole of 5 GB: nothing of them is asked for."""
    head = box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", (5 << 30) + 16)
    tail = box(b"moov", track(1, b"vide", 24, [(240, 1)]))
    asked = []

    def read(at, n):
        asked.append((at, n))
        if at < len(head):
            return head[at : at + n]
        return tail[at - len(head) - (5 << 30) :][:n] if at >= len(head) + (5 << 30) else bytes(n)

    assert media.probe(read, len(head) + (5 << 30) + len(tail))["frames"] == 240
    assert all(at < len(head) or at >= len(head) + (5 << 30) for at, _ in asked)


def fragment(number, count, each=None, durations=None):
    tfhd = full(b"tfhd", ">I", number) if each is None else full(b"tfhd", ">II", number, each, flags=8)
    if durations:
        trun = full(b"trun", f">II{2 * count}I", count, 0, *[x for d in durations for x in (d, 9)], flags=0x1 | 0x100 | 0x200)
    else:
        trun = full(b"trun", ">I", count)
    return box(b"moof", full(b"mfhd", ">I", 1), box(b"traf", tfhd, trun)) + box(b"mdat", bytes(20))


def test_fragments():
    start = movie(track(7, b"vide", 1200, [], samples=0), extra=box(b"mvex", full(b"trex", ">IIIII", 7, 1, 50, 0, 0)))
    got, _ = facts(start + fragment(7, 100) + fragment(7, 100, each=50) + fragment(8, 30) + fragment(7, 40, durations=[50] * 40))
    assert (got["frames"], got["rate"], got["duration"]) == (240, 24.0, 10.0)


@pytest.mark.parametrize("cut", [3, 20, 60, 120, 200])
def test_truncated(cut):
    whole = movie(track(1, b"vide", 24, [(240, 1)]))
    assert facts(whole[:cut])[0]["fault"] == "truncated"
    assert facts(whole + box(b"mdat", bytes(99))[:-1])[0]["fault"] == "truncated"


def test_data_source(spark, tmp_path):
    good = movie(track(1, b"vide", 24, [(240, 1)])) + box(b"mdat", bytes(9))
    for name, data in {"a.mp4": good, "b.MP4": movie(track(1, b"vide", 24, [(239, 1)])), "c.mp4": good[:-1], "d.mp4": b"", "e.mp4": movie(track(1, b"soun", 24, [(1, 1)])), "f.mp4": box(b"ftyp", b"x"), "no.txt": good}.items():
        (tmp_path / name).write_bytes(data)
    got = media.read_media(spark, str(tmp_path), tasks=3)
    rows = {os.path.basename(r.path): r for r in got.withColumn("ok", F.coalesce(validation.media_ok(F.col("frames"), F.col("rate"), F.col("duration")), F.lit(False))).collect()}
    assert {k: (r.ok, r.fault) for k, r in rows.items()} == {"a.mp4": (True, None), "b.MP4": (False, None), "c.mp4": (False, "truncated"), "d.mp4": (False, "empty"), "e.mp4": (False, "no_video"), "f.mp4": (False, "no_movie")}
    assert rows["a.mp4"].length == len(good) and media.read_media(spark, f"{tmp_path}/a.mp4").count() == 1


def test_hashes_of_large_files(spark, tmp_path):
    """A sparse file of over 2 GB, which no value of a row could hold."""
    size = (2 << 30) + 12345
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "small.bin").write_bytes(b"small")
    want = hashlib.sha256()
    for _ in range(size >> 24):
        want.update(bytes(1 << 24))
    want.update(bytes(size & ((1 << 24) - 1)))
    got = {r.name: (r.size, r.hash) for r in readers.read_inventory(spark, str(tmp_path)).collect()}
    assert got == {"large.bin": (size, want.hexdigest()), "small.bin": (5, hashlib.sha256(b"small").hexdigest())}
    os.remove(tmp_path / "large.bin")


def test_links_out_of_the_folder(spark, tmp_path):
    root, other = tmp_path / "videos", tmp_path / "other"
    (root / "in").mkdir(parents=True)
    other.mkdir()
    for p in (root / "AD-0001.mp4", root / "in" / "x.mp4", other / "y.mp4"):
        p.write_bytes(b"0")
    os.symlink(root / "in" / "x.mp4", root / "AD-0002.mp4")
    found = readers.read_videos(spark, str(root))
    assert sorted(r.case_id for r in readers.videos_inside(found, str(root)).collect()) == ["AD-0001", "AD-0002"]
    real = {os.path.basename(r.path): r.real for r in files.resolved(found).collect()}
    assert real["AD-0002.mp4"] == os.path.realpath(root / "in" / "x.mp4")
    os.symlink(other / "y.mp4", root / "AD-0003.mp4")
    with pytest.raises(ValueError, match="AD-0003"):
        readers.videos_inside(readers.read_videos(spark, str(root)), str(root))
    assert readers.videos_inside(readers.read_videos(spark, f"{root}/AD-0003.mp4"), f"{root}/AD-0003.mp4").count() == 1
    # a folder that is a link, ".." on the way, and a root that is a link itself
    os.symlink(other, root / "link")
    os.symlink(root, tmp_path / "alias")
    paths = [f"{root}/link/y.mp4", f"{root}/in/../AD-0001.mp4", f"{root}/in/../../other/y.mp4", f"{root}/in/x.mp4", f"{tmp_path}/alias/AD-0001.mp4", f"{root}x/z.mp4"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    for base in (root, tmp_path / "alias"):
        assert {r.path for r in files.outside(df, str(base)).collect()} == {paths[0], paths[2], paths[5]}


def test_publication(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    rows = []
    for k, name in enumerate(["AD-0001", "UI 7/x", "é"]):
        (src / f"{k}.mp4").write_bytes(name.encode() * 1000)
        rows.append((name, f"{src}/{k}.mp4", 1000, hashlib.sha256(name.encode() * 1000).hexdigest()))
    df = spark.createDataFrame(rows, "case_id string, path string, length long, sha256 string")
    assert {r.outcome for r in files.publish(df, str(out)).collect()} == {"published"}
    assert sorted(os.listdir(out)) == sorted(["AD-0001.mp4", "UI_7_x.mp4", "é.mp4"])
    # run again, as after a lost task, with a part that such a task left behind
    (out / ".AD-0001.mp4.0123.partial").write_bytes(b"half")
    os.remove(out / "é.mp4")
    assert sorted(r.outcome for r in files.publish(df, str(out)).collect()) == ["present", "present", "published"]
    assert not [n for n in os.listdir(out) if n.startswith(".") and n.endswith("partial")]
    (out / "AD-0001.mp4").write_bytes(b"other")
    with pytest.raises(ValueError, match="conflict"):
        files.publish(df, str(out))
    assert (out / "AD-0001.mp4").read_bytes() == b"other"
    assert files.publish_one(rows[1][1], "0" * 64, f"{out}/new.mp4") == "changed" and not (out / "new.mp4").exists()
    with pytest.raises(ValueError, match="one name"):
        files.publish(df.union(spark.createDataFrame([("UI_7_x", rows[1][1], 1, rows[1][3])], df.schema)), str(out))
    with pytest.raises(ValueError, match="unsafe"):
        files.publish(spark.createDataFrame([("..", rows[0][1], 1, "")], df.schema), str(out))


JOB = "profile string, case_id long, family string, status string, selected_attempt int, reasons array<string>, items array<string>, repaired boolean"


def test_rollup_of_batches(spark, tmp_path):
    rows = [(f"p{k % 2}", k, "AD" if k % 3 else "UI", "pass" if k % 4 else "invalid", 1 + k % 2, ["json_error", None][: k % 3], None if k % 4 == 0 else ["yes"] * (k % 5) + ["no"] * 3, k % 7 == 1) for k in range(40)]
    jobs = spark.createDataFrame(rows, JOB)
    whole = rollups.progress(rollups.partials(jobs), 41)
    roll = rollups.RollUp(spark, f"{tmp_path}/roll")
    for n, rest in enumerate((0, 1, 2)):
        roll.add(jobs.where(F.col("case_id") % 3 == rest), n)
    roll.add(jobs.where("case_id % 3 = 1"), 1)  # again, after a failure
    assert rollups.progress(roll.counters(), 41) == whole
    done = [r for r in rows if r[6] is not None]
    yes = sum(r[6].count("yes") for r in done)
    assert whole["execution_status"] == "partial" and whole["attempted_case_count"] == 40 and whole["valid_case_count"] == 30 and whole["yes_count"] == yes
    assert whole["repaired_json_case_count"] == sum(r[7] for r in done) and whole["case_status_counts"] == {"invalid": 10, "pass": 30}
    assert whole["by_profile"]["p1"]["case_count"] == sum(r[0] == "p1" for r in done) and whole["by_family"]["UI"]["yes_rate"] == sum(r[6].count("yes") for r in done if r[2] == "UI") / sum(len(r[6]) for r in done if r[2] == "UI")
    assert whole["retry_reason_counts"] == {"json_error": sum(r[5][:1] == ["json_error"] for r in rows)}
    # a batch reads itself alone: the ones before it are gone, and it goes on
    (tmp_path / "roll" / "batch=0").rename(tmp_path / "elsewhere")
    roll.add(jobs.where("case_id = 0"), 3)
    assert rollups.progress(roll.counters(), 41)["attempted_case_count"] == 40 - 14 + 1
    assert rollups.progress(rollups.partials(jobs.limit(0)), 0)["yes_rate"] is None


def test_rollup_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("p", k, "AD", "pass", 1, [], ["yes", "no"], False)], JOB).write.mode("append").parquet(f"{tmp_path}/in")
    roll = rollups.RollUp(spark, f"{tmp_path}/roll")
    for _ in range(2):  # the second query goes on after the first one's checkpoint
        q = roll.add_stream(spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert rollups.progress(roll.counters(), 3)["yes_count"] == 3 and len(os.listdir(tmp_path / "roll")) >= 3


def test_worker_states(spark):
    jobs = spark.createDataFrame([(k, "w", i) for i, k in enumerate("abcdef")], "case_id string, worker string, pos int")
    log = [("a", 1, 1, False, None), ("a", 2, 0, True, None), ("a", 3, 9, False, None), ("b", 1, 2, False, None), ("b", 2, 0, True, "frames"), ("b", 3, None, False, None), ("c", 1, 7, False, None), ("d", 1, 7, False, None), ("x", 1, 0, True, None), ("e", 4, 0, True, None), ("b", 3, None, False, None)]
    attempts = spark.createDataFrame([(*r, 100) for r in log], "case_id string, attempt int, exit_code int, delivered boolean, fault string, at long").withColumn("finished_at", F.timestamp_seconds("at"))
    states = worker.job_states(jobs, attempts, spark.createDataFrame([("d",), ("d",)], "case_id string"))
    got = {r.case_id: (r.state, r.attempts, r.failure, r.due) for r in states.withColumn("due", F.unix_seconds("due_at")).collect()}
    assert got == {"a": ("complete", 2, None, None), "b": ("failed", 3, "attempt 3 exited ?", None), "c": ("waiting", 1, "attempt 1 exited 7", 110), "d": ("skipped", 0, None, None), "e": ("pending", 0, None, None), "f": ("pending", 0, None, None)}
    assert tuple(worker.worker_report(states).first()) == ("w", 6, "a", "f", 2, 1, 3, "running_with_failures")


def test_requests_show_no_target(spark):
    cases = spark.createDataFrame([("AD-0001", "a sign says OPEN", [("T01", "sign", "en", "OPEN")]), ("AD-0002", "a board says RULES", [("T01", "board", "en", "RULES")]), ("AD-0003", "it says carrier 7", [("T01", "carrier 7", "en", "carrier 7")])], "id string, prompt_en string, required_text array<struct<id:string,carrier:string,language:string,verbatim:string>>")
    # a target that the system message holds, and one that its own carrier shows
    assert {r.id: r.leaked for r in prompts.request_leaks(prompts.mask(cases)).collect()} == {"AD-0002": ["T01"], "AD-0003": ["T01"]}
    sent = prompts.mask(cases).select(prompts.transcription_request(F.col("masked_prompt"), F.col("public_targets"), feedback=F.lit("why")).alias("r")).first().r
    assert sent.startswith("SCENE DESCRIPTION\n\na sign says [TARGET T01]\n\nTARGET CARRIERS\n\n[\n  {") and sent.endswith("PREVIOUS ATTEMPT FEEDBACK\n\nwhy") and protocol.TRANSCRIPTION_EXAMPLE in sent


def test_request_size(spark):
    ok = lambda n: validation.request_ok(F.lit(42), F.lit(241), F.lit(240), F.lit(24), F.lit("go"), n).alias("ok")
    assert [r.ok for r in spark.createDataFrame([(0,), (1,), (1_000_000,), (1_000_001,), (None,)], "n long").select(ok(F.col("n"))).collect()] == [False, True, True, False, False]


def test_one_report_for_a_folder(spark, tmp_path):
    target = {"id": "T01", "carrier": "sign", "language": "en", "verbatim": "OPEN"}
    items = [{"id": i, "dimension": "Entity Presence", "question_en": "q"} for i in validation.ITEM_IDS]
    ids = ["AD-0001", "UI-0002", "SCI-0003"]
    write = lambda path, value: (path.parent.mkdir(parents=True, exist_ok=True), path.write_text(json.dumps(value)))
    write(tmp_path / "prompts.json", {"cases": [{"id": i, "prompt_en": "an OPEN sign", "required_text": [target]} for i in ids]})
    write(tmp_path / "lists.json", {"cases": [{"id": i, "checklist": items} for i in ids]})
    (tmp_path / "v").mkdir()
    for i in ids[:2]:
        (tmp_path / "v" / f"{i}.mp4").write_bytes(b"0")
        write(tmp_path / "wer" / "p" / i / "case_status.json", {"status": "pass"})
        write(tmp_path / "wer" / "p" / i / "score.json", {"items": [{"text_id": "T01", "reference": "OPEN now", "hypothesis": "OPEN"}]})
        write(tmp_path / "checklist" / "p" / i / "case_status.json", {"status": "pass"})
        write(tmp_path / "checklist" / "p" / i / "result.json", {"profile": "p", "case_id": i, "items": [{"id": x["id"], "dimension": x["dimension"], "answer": "yes"} for x in items]})
    for task in ("wer", "checklist"):
        write(tmp_path / task / "run_manifest.json", {"job_identities": [{"profile": "p", "case_id": i} for i in ids[:2]]})
    runs = {t: f"{tmp_path}/{t}" for t in ("checklist", "wer")}
    where = (f"{tmp_path}/v", f"{tmp_path}/prompts.json", f"{tmp_path}/lists.json")
    chosen, missing = chosen_videos(spark, *where)
    assert chosen.count() == 2 and [r.case_id for r in missing.collect()] == ["SCI-0003"]
    reports = evaluate(spark, *where, runs, f"{tmp_path}/out")
    assert reports["checklist"]["overall"]["yes_rate"] == 1.0 and reports["wer"]["overall"]["case_balanced_wer"]["R+5"] == 0.5
    assert json.loads((tmp_path / "out" / "metrics.json").read_text()) == json.loads(json.dumps(reports))
    (tmp_path / "v" / "SCI-0003.mp4").write_bytes(b"0")
    with pytest.raises(ValueError):  # the runs did not judge it
        evaluate(spark, *where, runs)
