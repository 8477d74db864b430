"""Media facts of MP4 files, from their boxes alone: a Python data source ``mp4``.

A file is read by ranges: headers of boxes, and of a movie's tables only what counts
frames and tells times.  Media data are skipped, whatever their size.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textgauge.sources.files import file_system

SCHEMA = "path string, length bigint, width int, height int, frames bigint, rate double, duration double, fault string"
Read = Callable[[int, int], bytes]


class Broken(Exception):
    """What is wrong with a file."""


@dataclass
class Track:
    """What a video track's boxes tell."""

    number: int = 0
    handler: bytes = b""
    scale: int = 0
    width: int | None = None
    height: int | None = None
    frames: int = 0
    ticks: int = 0


@dataclass
class Movie:
    tracks: list[Track] = field(default_factory=list)
    #: Durations of samples that a fragment does not tell, by track.
    defaults: dict[int, int] = field(default_factory=dict)


def boxes(read: Read, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of the boxes in a range."""
    at = start
    while at < end:
        head = read(at, 16)
        if len(head) < 8 or at + 8 > end:
            raise Broken("truncated")
        size, kind = struct.unpack(">I4s", head[:8])
        body = at + 8
        if size == 1:
            if len(head) < 16:
                raise Broken("truncated")
            size, body = struct.unpack(">Q", head[8:16])[0], at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise Broken("truncated")
        yield kind, body, at + size
        at += size


def _numbers(read: Read, at: int, end: int, form: str) -> tuple:
    size = struct.calcsize(form)
    if at + size > end:
        raise Broken("truncated")
    data = read(at, size)
    if len(data) < size:
        raise Broken("truncated")
    return struct.unpack(form, data)


def _times(read: Read, at: int, end: int) -> tuple[int, int]:
    """Frames and ticks of a time-to-sample table, a piece at a time."""
    (count,) = _numbers(read, at + 4, end, ">I")
    if at + 8 + 8 * count > end:
        raise Broken("truncated")
    frames = ticks = 0
    for k in range(0, count, 4096):
        n = min(4096, count - k)
        pairs = _numbers(read, at + 8 + 8 * k, end, f">{2 * n}I")
        frames += sum(pairs[::2])
        ticks += sum(a * b for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    return frames, ticks


def _track(read: Read, start: int, end: int, track: Track) -> Track:
    """Walk a track's boxes, into those that hold the tables."""
    for kind, body, stop in boxes(read, start, end):
        if kind in (b"mdia", b"minf", b"stbl"):
            _track(read, body, stop, track)
        elif kind == b"tkhd":
            (version,) = _numbers(read, body, stop, ">B")
            (track.number,) = _numbers(read, body + (20 if version else 12), stop, ">I")
        elif kind == b"mdhd":
            (version,) = _numbers(read, body, stop, ">B")
            (track.scale,) = _numbers(read, body + (20 if version else 12), stop, ">I")
        elif kind == b"hdlr":
            (track.handler,) = _numbers(read, body + 8, stop, ">4s")
        elif kind == b"stsd" and _numbers(read, body + 4, stop, ">I")[0] and stop - body >= 44:
            track.width, track.height = _numbers(read, body + 40, stop, ">HH")
        elif kind == b"stts":
            frames, track.ticks = _times(read, body, stop)
            track.frames = max(track.frames, frames)
        elif kind == b"stsz":
            (track.frames,) = _numbers(read, body + 8, stop, ">I")
    return track


def _fragment(read: Read, start: int, end: int, movie: Movie) -> None:
    """Add the samples of a fragment's runs to their track."""
    for kind, body, stop in boxes(read, start, end):
        if kind != b"traf":
            continue
        track, each = None, 0
        for inner, at, close in boxes(read, body, stop):
            flags = _numbers(read, at, close, ">I")[0] & 0xFFFFFF
            if inner == b"tfhd":
                (number,) = _numbers(read, at + 4, close, ">I")
                track, each = next((t for t in movie.tracks if t.number == number), None), movie.defaults.get(number, 0)
                skip = at + 8 + 8 * bool(flags & 1) + 4 * bool(flags & 2)
                if flags & 8:
                    (each,) = _numbers(read, skip, close, ">I")
            elif inner == b"trun" and track:
                (count,) = _numbers(read, at + 4, close, ">I")
                first = at + 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4)
                wide = 4 * sum(bool(flags & f) for f in (0x100, 0x200, 0x400, 0x800))
                if first + wide * count > close:
                    raise Broken("truncated")
                track.frames += count
                if flags & 0x100:
                    for k in range(0, count, 4096):
                        n = min(4096, count - k)
                        track.ticks += sum(_numbers(read, first + wide * k, close, f">{n * wide // 4}I")[:: wide // 4])
                else:
                    track.ticks += each * count


def probe(read: Read, size: int) -> dict:
    """Width, height, frames, rate and duration of a file's first video track, or a fault:
    empty, truncated, no_movie, no_video.

    ``read(offset, n)`` returns up to n bytes.  Frames are counted from the sample
    tables and fragments, the rate is frames over duration."""
    out: dict = {"width": None, "height": None, "frames": None, "rate": None, "duration": None, "fault": None}
    if not size:
        return out | {"fault": "empty"}
    movie: Movie | None = None
    try:
        for kind, body, stop in boxes(read, 0, size):
            if kind == b"moov":
                movie = Movie()
                for inner, at, close in boxes(read, body, stop):
                    if inner == b"trak":
                        movie.tracks.append(_track(read, at, close, Track()))
                    elif inner == b"mvex":
                        for last, where, over in boxes(read, at, close):
                            if last == b"trex":
                                number, _, each = _numbers(read, where + 4, over, ">III")
                                movie.defaults[number] = each
            elif kind == b"moof" and movie:
                _fragment(read, body, stop, movie)
    except Broken as e:
        return out | {"fault": str(e)}
    if movie is None:
        return out | {"fault": "no_movie"}
    video = next((t for t in movie.tracks if t.handler == b"vide"), None)
    if video is None:
        return out | {"fault": "no_video"}
    duration = video.ticks / video.scale if video.scale else 0.0
    return out | {"width": video.width, "height": video.height, "frames": video.frames, "rate": video.frames / duration if duration else 0.0, "duration": duration}


def probe_file(path: str, length: int) -> tuple:
    system, name = file_system(path)
    with system.open_input_file(name) as f:

        def read(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        facts = probe(read, length)
    return path, length, *facts.values()


@dataclass
class Files(InputPartition):
    """Paths and lengths that one task probes."""

    files: list[tuple[str, int]]


class Mp4Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path")
        self.tasks = int(options.get("partitions", 64))
        if not self.path:
            raise ValueError("mp4: a path is needed")

    def partitions(self) -> list[Files]:
        """One file, or the .mp4 files directly in a folder, dealt over tasks."""
        system, name = file_system(self.path)
        info = system.get_file_info(name)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.File and i.path.lower().endswith(".mp4")]
        scheme = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""
        listed = sorted((scheme + i.path, i.size) for i in found)
        n = max(1, min(self.tasks, len(listed)))
        return [Files(listed[k::n]) for k in range(n)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length in partition.files:
            yield probe_file(path, length)


class Mp4Source(DataSource):
    """``spark.read.format("mp4").load(folder)``: facts of each file, never its media."""

    @classmethod
    def name(cls) -> str:
        return "mp4"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Mp4Reader(self.options)


def read_media(spark: SparkSession, path: str, tasks: int = 64) -> DataFrame:
    """Media facts of the .mp4 files in a folder, or of one file; a broken file has a
    ``fault`` and null facts, which no media contract accepts."""
    spark.dataSource.register(Mp4Source)
    return spark.read.format("mp4").option("partitions", tasks).load(path)
