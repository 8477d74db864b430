"""Files by ranges and streams: hashes of any size, links, and publication.

Executors open files themselves (``pyarrow.fs``), so a file's bytes never become a
value of a row, and a file is one task's work, the largest first.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgauge.operators.partitioning import positions
from textgauge.operators.validation import require_none, safe_name
from textgauge.sources.sinks import checkpointed

#: Bytes read at once, and the most tasks that files are dealt over.
CHUNK, MOST_TASKS = 4 << 20, 10_000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and its path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sha256_of(path: str) -> tuple[int, str]:
    """Bytes and SHA-256 of a file, read in chunks."""
    system, name = file_system(path)
    digest, size = hashlib.sha256(), 0
    with system.open_input_stream(name) as stream:
        while part := stream.read(CHUNK):
            digest.update(part)
            size += len(part)
    return size, digest.hexdigest()


def one_file_a_task(files: DataFrame) -> DataFrame:
    """Files (path, length, ...) dealt over tasks, the largest first.

    There are as many tasks as files, ``MOST_TASKS`` at most; then each has a large file
    before its small ones."""
    n = files.count()
    tasks = max(1, min(n, MOST_TASKS))
    placed = positions(files.withColumn("__smaller", -F.col("length")), "__smaller", "path").drop("__smaller")
    return placed.withColumn("__slot", F.col("pos") % tasks).repartitionByRange(tasks, "__slot").sortWithinPartitions("pos").drop("pos", "__slot")


def hashed(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files (path, length); ones that can't be read fail the job."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                size, digest = sha256_of(path)
                yield pa.RecordBatch.from_pydict({"path": [path], "size": pa.array([size], pa.int64()), "sha256": [digest]})

    return one_file_a_task(files.select("path", "length")).select("path").mapInArrow(run, "path string, size bigint, sha256 string")


# ------------------------------------------------------------------ links


def _local(path: str) -> str:
    """A path without scheme; one of another file system is left as it is."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def resolved(files: DataFrame) -> DataFrame:
    """Files with ``real``, their path without links and ``..``.

    Every folder is resolved and its links are listed once, by the task that has the
    folder; files are joined to that by folder and name.  File systems without links
    have their own paths."""
    path = F.col("path")
    split = files.withColumns({"__folder": F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "__name": F.regexp_extract(path, r"([^/]*)$", 1)})

    def run(batches):
        for b in batches:
            rows = [r for folder in b.column(0).to_pylist() for r in _links(folder)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["__folder", "__link", "__real"])

    folders = checkpointed(split.select("__folder").distinct().mapInArrow(run, "__folder string, __link string, __real string"))
    base = folders.where("__link IS NULL").select("__folder", F.col("__real").alias("__base"))
    links = folders.where("__link IS NOT NULL").select("__folder", F.col("__link").alias("__name"), "__real")
    out = split.join(base, "__folder", "left").join(links, ["__folder", "__name"], "left")
    # a last part of ".." belongs to the folder before it
    return out.withColumn("real", F.coalesce("__real", F.concat("__base", F.lit("/"), "__name"))).select(*files.columns, "real")


def _links(folder: str) -> Iterator[tuple[str, str | None, str]]:
    if "://" in folder and not folder.startswith("file:"):
        yield folder, None, folder
        return
    own = _local(folder) or "/"
    yield folder, None, os.path.realpath(own)
    yield folder, "..", os.path.realpath(os.path.join(own, ".."))
    yield folder, ".", os.path.realpath(own)
    if os.path.isdir(own):
        with os.scandir(own) as entries:
            for e in entries:
                if e.is_symlink():
                    yield folder, e.name, os.path.realpath(e.path)


def outside(files: DataFrame, root: str) -> DataFrame:
    """Files whose real path does not lie under the real root; other columns stay."""
    real = os.path.realpath(_local(root)) if "://" not in root or root.startswith("file:") else root.rstrip("/")
    base = real.rstrip("/") + "/"
    return resolved(files).where(~F.startswith("real", F.lit(base)))


# ------------------------------------------------------------------ publication


def _put(system: fs.FileSystem, beside: str, target: str) -> bool:
    """Give a written file its name; False where the name is taken.

    A local name is given by a hard link, which never replaces.  Elsewhere the
    name is looked up first, so a writer at the same moment may be replaced by equal or
    other bytes; the hash that is read afterwards tells."""
    if isinstance(system, fs.LocalFileSystem):
        try:
            os.link(beside, target)
        except FileExistsError:
            return False
        return True
    if system.get_file_info(target).type != fs.FileType.NotFound:
        return False
    system.move(beside, target)
    return True


def publish_one(source: str, wanted: str, target: str) -> str:
    """Publish one file: published, present, conflict (another file has the name) or
    changed (the source is not what was announced)."""
    there, at = file_system(target)
    if there.get_file_info(at).type != fs.FileType.NotFound:
        return "present" if sha256_of(target)[1] == wanted else "conflict"
    folder, _, name = at.rpartition("/")
    there.create_dir(folder, recursive=True)
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}.partial"
    here, own = file_system(source)
    digest = hashlib.sha256()
    try:
        with here.open_input_stream(own) as read, there.open_output_stream(beside) as write:
            while part := read.read(CHUNK):
                digest.update(part)
                write.write(part)
        if digest.hexdigest() != wanted:
            return "changed"
        if _put(there, beside, at):
            return "published" if sha256_of(target)[1] == wanted else "conflict"
        return "present" if sha256_of(target)[1] == wanted else "conflict"
    finally:
        if there.get_file_info(beside).type != fs.FileType.NotFound:
            there.delete_file(beside)


def publish(deliverables: DataFrame, root: str, suffix: str = ".mp4") -> DataFrame:
    """Publish files (case_id, path, length, sha256) as ``<root>/<case><suffix>``:
    case_id, target, outcome.

    A file is copied to a hidden name, its hash is compared on the way, and only then it
    takes its name, which is never replaced.  A task that is run again finds what the
    lost one published; hidden parts that a lost one left are deleted at the end.
    Conflicts, changed sources, unsafe ids and two files for one name are errors.
    """
    named = deliverables.withColumn("name", safe_name(F.col("case_id")))
    require_none(named.where("name IS NULL").select("case_id"), "unsafe ids")
    require_none(named.groupBy("name").count().where("count > 1"), "two files for one name")

    def run(batches):
        for b in batches:
            for case, path, digest, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                target = f"{root}/{name}{suffix}"
                yield pa.RecordBatch.from_pydict({"case_id": [case], "target": [target], "outcome": [publish_one(path, digest, target)]})

    dealt = one_file_a_task(named.select("case_id", "path", "length", "sha256", "name")).select("case_id", "path", "sha256", "name")
    done = checkpointed(dealt.mapInArrow(run, "case_id string, target string, outcome string"))
    _sweep(deliverables.sparkSession, root, suffix)
    require_none(done.where("outcome IN ('conflict', 'changed')"), "published with another hash")
    return done


def _sweep(spark: SparkSession, root: str, suffix: str) -> None:
    """Delete hidden parts of tasks that were lost; no task of this publication runs any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for left in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path, f".*{suffix}.*.partial")) or []:
        system.delete(left.getPath(), False)
