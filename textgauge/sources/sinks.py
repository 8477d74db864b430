"""Sinks: partitioned tables, single-file reports, publishing and checkpoints."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.operators.validation import require_none


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder that the session names in ``spark.checkpoint.dir``.

    A local master may do without: it then has a temporary one.  On a cluster
    executors could not read it, so there it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return df.checkpoint(eager=True)


def write_audit(df: DataFrame, path: str, *partition: str) -> None:
    """An audit table, partitioned by task and profile or the like."""
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _replace_file(spark: SparkSession, path: str, body: bytes) -> None:
    """Write beside ``path`` and rename over it, on any file system that Spark knows,
    so that readers see the old file or the new one and never a part."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    beside = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    try:
        out = system.create(beside, True)
        try:
            out.write(bytearray(body))
            out.hsync()
        finally:
            out.close()
        over = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        files.rename(beside, target, options)
    finally:
        system.delete(beside, False)


def _report_text(value) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2) + "\n"


def write_json(spark: SparkSession, value, path: str) -> None:
    """A small report as one indented JSON file, replaced as a whole."""
    _replace_file(spark, path, _report_text(value).encode("utf-8"))


def write_json_report(df: DataFrame, path: str) -> None:
    """A report of a few rows, which the driver holds, as one JSON file: an object for
    one row, else a list in the table's order."""
    rows = [json.loads(x) for x in df.toJSON().collect()]
    write_json(df.sparkSession, rows[0] if len(rows) == 1 else rows, path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    """A column of a few rows as the lines of one text file, replaced as a whole."""
    lines = [r[0] for r in df.select(F.col(column).cast("string")).collect()]
    _replace_file(df.sparkSession, path, "".join(f"{x or ''}\n" for x in lines).encode("utf-8"))


def write_metrics(spark: SparkSession, reports: dict[str, dict], root: str) -> None:
    """``<root>/<task>/reports/metrics.json`` for each task, then ``<root>/metrics.json`` with all."""
    for task, report in reports.items():
        write_json(spark, report, f"{root}/{task}/reports/metrics.json")
    write_json(spark, reports, f"{root}/metrics.json")


def to_publish(new: DataFrame, published: DataFrame) -> DataFrame:
    """Deliverables (case_id, sha256, path) that are not published yet; one that is
    published with another hash is an error."""
    both = new.join(published.select("case_id", F.col("sha256").alias("old")), "case_id")
    require_none(both.where("sha256 <> old").select("case_id", "sha256", "old"), "published with another hash")
    return new.join(published.select("case_id"), "case_id", "left_anti")
