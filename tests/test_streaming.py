import time

from textgauge.streaming import retries
from textgauge.streaming.progress import attempt_counts, finished_jobs

SCHEMA = "profile string, case_id string, attempt int, passed boolean, parsed boolean"


def test_finished_jobs(spark, tmp_path):
    src = f"{tmp_path}/in"
    batches = [[("p", "a", 1, False, True), ("p", "b", 1, True, True)], [("p", "a", 2, False, True), ("p", "c", 1, False, False)], [("p", "a", 3, False, True), ("p", "c", 2, False, False), ("p", "c", 3, False, False), ("p", "b", 2, True, True)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    q = finished_jobs(stream).writeStream.format("memory").queryName("finished").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    got = {r.case_id: (r.status, r.selected_attempt) for r in spark.table("finished").collect()}
    assert got == {"a": ("pass_after_max_attempts", 3), "b": ("pass", 1), "c": ("invalid", None)}


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "other"), ("2024-01-01 00:02:00", "other"), ("2024-01-01 00:07:00", None)]
    spark.createDataFrame(rows, "ts string, reason string").selectExpr("cast(ts as timestamp) ts", "reason").write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema("ts timestamp, reason string").parquet(f"{tmp_path}/ev")
    q = attempt_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck2").start()
    q.awaitTermination(120)
    assert sorted((r.start.minute, r.attempts) for r in spark.table("counts").collect()) == [(0, 2), (5, 1)]


def test_retries_with_timers(spark, tmp_path):
    """Failed attempts come back when they are due; a restart goes on from the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.STORE)
    schema = "case_id string, attempt int, sound boolean"

    def feed(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(until):
        got = retries.retries(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), second=100)
        q = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start()
        try:
            for _ in range(100):
                time.sleep(1)
                seen = {(r.case_id, r.event, r.attempt) for r in spark.read.schema("case_id string, event string, attempt int").parquet(f"{tmp_path}/out").collect()} if (tmp_path / "out" / "_spark_metadata").exists() else set()
                if until <= seen:
                    return seen
        finally:
            q.stop()
        raise AssertionError(seen)

    try:
        feed(("a", 1, False), ("b", 1, True), ("c", 1, False), ("c", 2, False), ("c", 3, False))
        first = run({("a", "waiting", 1), ("a", "due", 2), ("b", "complete", 1), ("c", "failed", 3)})
        assert not {e for e in first if e[0] in "bc" and e[1] == "due"}
        # after a restart: a is done by its second attempt; what ended or was seen is dropped
        feed(("a", 2, True), ("a", 1, False), ("b", 2, False), ("c", 4, True))
        assert run({("a", "complete", 2)}) == first | {("a", "complete", 2)}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
