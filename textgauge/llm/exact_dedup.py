"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Each partition of the input sorts its fingerprints and sends every owner one
   Golomb-coded range; its documents stay behind in a ledger.
2. An owner compares the ranges of all senders and returns to each a bitmap of
   the fingerprints that occur more than once.
3. Only documents whose bit is set are shuffled with their text, where equal
   bytes, not equal fingerprints, make a group.

Hot texts: a fingerprint travels once per partition, and equal suspect texts are
combined in each partition before the shuffle, so copies of one text never meet
in one task.  The bitmaps say which fingerprints are suspect; a Bloom filter of
these, two bytes for each repeated text however many copies it has, tells the scan
which texts to shuffle.  It has at most ``FILTER_BYTES``, enough for 134 million
repeated texts; with four times as many one text in six passes by chance, and with
ever more the shuffle nears that of all texts.  What passes by chance forms groups
of one and changes nothing, so the bound costs work and never results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, keyed, materialize, mix, partitions
from .exchange import golomb, owner_cuts, pack, ungolomb, unpack

U64 = np.uint64
FILTER_BYTES = 256 << 20
_PROBES = 4


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8").lower()


def _fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big")


def _send(owners: int):
    def run(batches):
        ids, digests = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            digests += [hashlib.sha256(_normal(t)).digest() for t in b.column(1).to_pylist()]
        if not ids:
            return
        sender = TaskContext.get().partitionId()
        every = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        prints = every[:, :8].copy().view(">u8").ravel().astype(U64)
        order = np.argsort(prints, kind="stable")
        distinct, first, counts = np.unique(prints[order], return_index=True, return_counts=True)
        cuts = owner_cuts(distinct, owners)
        ends = np.append(first, len(order))
        for k in range(owners):
            a, z = cuts[k], cuts[k + 1]
            if a == z:
                continue
            rows = order[ends[a] : ends[z]]
            yield pa.RecordBatch.from_pydict(
                {
                    "owner": pa.array([k], pa.int32()),
                    "sender": pa.array([sender], pa.int32()),
                    "blob": pa.array([golomb(distinct[a:z])], pa.binary()),
                    "repeats": pa.array([counts[a:z].astype(np.int32).tobytes()], pa.binary()),
                    "ids": pa.array([[ids[i] for i in rows]], pa.list_(pa.int64())),
                    "places": pa.array([(rows + (sender << 32)).tolist()], pa.list_(pa.int64())),
                    "digests": pa.array([every[rows].tobytes()], pa.binary()),
                }
            )

    return run


_LEDGER = "owner int, sender int, blob binary, repeats binary, ids array<bigint>, places array<bigint>, digests binary"


def _owner(key, blobs):
    senders = blobs.column("sender").to_pylist()
    runs = [ungolomb(b) for b in blobs.column("blob").to_pylist()]
    values, counts = np.unique(np.concatenate(runs), return_counts=True)
    twice = values[counts > 1]
    bits = [pack(np.packbits(np.isin(r, twice, assume_unique=True))) for r in runs]
    return pa.table({"owner": pa.array([key[0].as_py()] * len(bits), pa.int32()), "sender": pa.array(senders, pa.int32()), "bits": pa.array(bits, pa.binary())})


def _verdicts(batches):
    """Ledger rows with their bitmaps, as one row per document."""
    for b in batches:
        for bits, repeats, ids, places, digests in zip(*(b.column(c).to_pylist() for c in ("bits", "repeats", "ids", "places", "digests")), strict=True):
            repeats = np.frombuffer(repeats, np.int32)
            suspect = (np.unpackbits(unpack(bits, np.uint8), count=len(repeats)) > 0) | (repeats > 1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "text_sha256": [digests[i : i + 32].hex() for i in range(0, len(digests), 32)],
                    "suspect": pa.array(np.repeat(suspect, repeats)),
                    "place": pa.array(places, pa.int64()),
                }
            )


def _probes(prints: np.ndarray, bits: int) -> np.ndarray:
    h = mix(prints + U64(0x51ED270B))
    step = mix(h) | U64(1)
    return ((h[:, None] + step[:, None] * np.arange(_PROBES, dtype=U64)[None, :]) % U64(bits)).astype(np.int64)


#: Bits of the filter that one task puts together.
_PART = 1 << 23


def _filter(suspects: DataFrame, most: int) -> np.ndarray:
    """A Bloom filter of the suspects' fingerprints: 16 bits each, never more than ``most`` bytes.

    Positions go to the task that has their part of the filter, so no task holds more
    than a part and the driver only the whole."""
    own = materialize(suspects.select("text_sha256").distinct())
    bits = int(min(most * 8, max(1024, 16 * own.count())) + 7) // 8 * 8

    def positions(batches):
        for b in batches:
            prints = np.array([_fingerprint(bytes.fromhex(x[:16])) for x in b.column(0).to_pylist()], U64)
            p = np.unique(_probes(prints, bits))
            cut = np.searchsorted(p, np.arange(0, bits + _PART, _PART))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "bits": pa.array([(p[cut[k] : cut[k + 1]] - k * _PART).astype(np.uint32).tobytes() for k in some], pa.binary())})

    def put_together(key, t):
        seen = np.zeros(_PART, bool)
        for x in t.column("bits").to_pylist():
            seen[np.frombuffer(x, np.uint32)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(seen).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for row in own.mapInArrow(positions, "part int, bits binary").groupBy("part").applyInArrow(put_together, "part int, bits binary").toLocalIterator():
        at = row.part * (_PART // 8)
        out[at : at + _PART // 8] = np.frombuffer(bytes(row.bits), np.uint8)[: len(out) - at]
    return out


def exact_dedup(docs: DataFrame, owners: int | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Group documents whose texts are equal after lower-casing A-Z only.

    Takes ``doc_id`` (integer) and ``text``; other columns are ignored.  Returns
    one row per input row: doc_id, keep_id, group_size, kept, text_sha256.  The
    largest doc_id of a group is kept, and one row of a group always.  Null text counts
    as empty.  Rows that repeat a doc_id with the same text count each in ``group_size``,
    and one of them is kept, the first of the input's partitions.  A null doc_id is
    smaller than any other and is kept only where its whole group has none.  An empty
    table gives none.
    """
    spark = docs.sparkSession
    owners = owners or partitions(spark)
    docs = keyed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    ledger = materialize(docs.mapInArrow(_send(owners), _LEDGER))
    bitmaps = ledger.select("owner", "sender", "blob").groupBy("owner").applyInArrow(_owner, "owner int, sender int, bits binary")
    rows = materialize(ledger.drop("blob").join(bitmaps, ["owner", "sender"]).mapInArrow(_verdicts, "doc_id bigint, text_sha256 string, suspect boolean, place bigint"))
    suspects = rows.where("suspect")
    bloom = spark.sparkContext.broadcast(_filter(suspects, filter_bytes))

    def claims(batches):
        at = bloom.value
        for b in batches:
            norm = [_normal(t) for t in b.column(1).to_pylist()]
            prints = np.array([_fingerprint(hashlib.sha256(t).digest()) for t in norm], U64)
            p = _probes(prints, len(at) * 8)
            hit = np.flatnonzero(((at[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1))
            if len(hit):
                yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).take(pa.array(hit)), "norm": pa.array([norm[k] for k in hit], pa.binary())})

    texts = docs.mapInArrow(claims, "doc_id bigint, norm binary")
    groups = texts.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    # of rows that repeat the largest doc_id with its text, the first that the ledger has
    first = suspects.groupBy("text_sha256").agg(F.max(F.struct("doc_id", (-F.col("place")).alias("place"))).alias("b")).select("text_sha256", (-F.col("b.place")).alias("keep_place"))
    groups = groups.join(first, "text_sha256")
    kept = F.col("keep_place").isNull() | (F.col("place") == F.col("keep_place"))
    found = join_counted(suspects, groups, ["text_sha256"], "group_size", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        kept.alias("kept"),
        "text_sha256",
    )
    alone = rows.where(~F.col("suspect")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(found)
