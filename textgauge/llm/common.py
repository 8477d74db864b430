"""Helpers shared by the operators: tables, checkpoints and vectorised byte work.

Texts reach Python as Arrow columns and are worked on as one ``uint8`` array
with document offsets, so no loop runs over characters.  Hashes are polynomial
modulo 2**64 over a random byte table, which makes any substring's hash two
lookups away once the prefix hashes are there.
"""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text worked on at once in a Python worker; a longer document is a piece of its own.
PIECE_BYTES = 256 << 10
#: Bytes of text of a bucket, on the mean, and bytes of text whose hashes an owner has.
BUCKET_BYTES, OWNER_BYTES = 16 << 20, 128 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which the cluster sets to suit its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exchange_sizes(spark: SparkSession, text_bytes: int, buckets: int | None, owners: int | None) -> tuple[int, int]:
    """Numbers of document buckets and hash owners for so many bytes of text.

    Both follow the shuffle partitions, so that every core has work, and where
    these are few they follow the bytes, so that a bucket has about ``BUCKET_BYTES``
    of text and an owner the hashes of about ``OWNER_BYTES``: what a Python worker
    holds does not grow with the input.
    """
    n = partitions(spark)
    return buckets or max(4 * n, -(-text_bytes // BUCKET_BYTES)), owners or max(1, n // 2, -(-text_bytes // OWNER_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in ``spark.checkpoint.dir``.

    A local master may do without and has a temporary one; on a cluster a folder of
    one machine is read by no other, so there it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can clash with nothing."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str = "inner", least: int = 1000) -> DataFrame:
    """Join to ``right``, which has a row for each key and in ``count`` how many rows of
    ``left`` it meets; inner or left.

    Keys with more than a quarter of a partition's share are fewer than four for
    each partition, whatever the data's size.  They are broadcast, so that the
    rows of a hot key stay where they are; the rest is joined by shuffle.
    """
    right = materialize(right)
    total = right.agg(F.sum(count)).first()[0] or 0
    limit = max(least, int(total) // (4 * partitions(left.sparkSession)))
    hot = right.where(F.col(count) > limit)
    if hot.isEmpty():
        return left.join(right, on, how)
    few = F.broadcast(hot)
    rest = left.join(few, on, "left_anti").join(right.where(F.col(count) <= limit), on, how)
    return left.join(few, on).unionByName(rest)


def draw_distinct(labelled: DataFrame, label: str, seed: int, most: int, chars: int) -> tuple[dict[str, int], DataFrame]:
    """Rows by label, most frequent first, and a sample (label, text, h) of about ``most``
    different texts of each label, or all where it has no more.

    The draw is by a hash of the text, and its rate follows the different texts of
    a label, which are told by hashes, so a label of many copies keeps its sample.
    Of a text of more bytes than ``chars`` an excerpt of as many characters stands
    for it, from a place that its hash tells, so a label of long texts keeps its too.
    """
    hashed = labelled.select(label, "text", F.xxhash64("text", F.lit(seed)).alias("__x"))
    sizes = materialize(hashed.groupBy(label, "__x").agg(F.count(F.lit(1)).alias("n")).groupBy(label).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")))
    counts = {r[label]: r.n for r in sizes.orderBy(F.desc("n"), label).collect()}
    share = sizes.select(label, F.least(F.lit(1.0), F.lit(float(most)) / F.col("texts")).alias("share"))
    h = F.pmod(F.col("__x"), F.lit(1 << 40))
    drawn = hashed.join(F.broadcast(share), label).where(h < F.col("share") * F.lit(float(1 << 40)))
    start = F.pmod(F.shiftright("__x", 9), F.greatest(F.lit(1), F.length("text") - F.lit(chars - 1))).cast("int") + 1
    excerpt = F.when(F.octet_length("text") > chars, F.substring("text", start, F.lit(chars))).otherwise(F.col("text"))
    return counts, drawn.select(label, excerpt.alias("text"), h.alias("h")).distinct()


# ---------------------------------------------------------------- bytes


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(lower: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z count as a-z."""
    t = mix(np.arange(1, 257, dtype=U64) * U64(0xD1B54A32D192ED03))
    if lower:
        t[65:91] = t[97:123]
    return t


def byte_set(lower: bool = False, **ranges: tuple[int, int]) -> np.ndarray:
    m = np.zeros(256, bool)
    for a, b in ranges.values():
        m[a : b + 1] = True
    if lower:
        m[65:91] = m[97:123]
    return m


_LOW = 1 << 12


def _ladder(base: int, step: int, n: int) -> np.ndarray:
    p = np.full(n, U64(pow(base, step, 1 << 64)), U64)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as products of two short tables."""

    def __init__(self, base: int = int(_BASE)):
        self.bases = base, pow(base, -1, 1 << 64)
        self.low = [_ladder(b, 1, _LOW) for b in self.bases]
        self.high = [_ladder(b, _LOW, 1024) for b in self.bases]

    def reach(self, n: int) -> None:
        if n // _LOW >= len(self.high[0]):
            self.high = [_ladder(b, _LOW, 2 * (n // _LOW + 1)) for b in self.bases]

    def up(self, n: int) -> np.ndarray:
        """Powers 0..n-1 of the base."""
        self.reach(n)
        return (self.high[0][: n // _LOW + 1, None] * self.low[0][None, :]).ravel()[:n]

    def down(self, at: np.ndarray) -> np.ndarray:
        """Powers of the inverse at the given exponents."""
        return self.high[1][at >> 12] * self.low[1][at & (_LOW - 1)]


POWERS = _Powers()
#: Another base, for a second hash that is independent of the first.
POWERS2 = _Powers(0xD6E8FEB86659FD93 | 1)


class PrefixHash:
    """Prefix polynomial hashes of a byte array; ``of`` hashes many substrings at once."""

    def __init__(self, data: np.ndarray, values: np.ndarray, powers: _Powers = POWERS):
        self.powers = powers
        powers.reach(len(data) + 1)
        self.h = np.zeros(len(data) + 1, U64)
        step = 64 * _LOW
        for i in range(0, len(data), step):
            part = data[i : i + step]
            up = powers.up(len(part))
            if i:
                up *= U64(pow(powers.bases[0], i, 1 << 64))
            up *= values[part]
            np.cumsum(up, out=self.h[i + 1 : i + 1 + len(part)])
            self.h[i + 1 : i + 1 + len(part)] += self.h[i]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.h[end] - self.h[start]) * self.powers.down(start)


def release() -> None:
    """Give freed memory back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees by itself
        return


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES):
    """Ranges (i, j) of documents of about ``limit`` bytes; one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Starts and ends of maximal runs of ``inside`` bytes within documents, and
    for each document the index of its first run (one more entry than documents)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = inside[data]
    cut = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    before[cut] = False
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    after[cut[cut > 0] - 1] = False
    start = np.flatnonzero(m & ~before)
    end = np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data, start, end, values) -> np.ndarray:
    h = PrefixHash(data, values).of(start, end)
    return mix(h + (end - start).astype(U64) * U64(0xA24BAED4963EE407))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of the ranges start..start+length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    step[at] = s
    step[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(step)
