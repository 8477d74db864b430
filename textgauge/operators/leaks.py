"""Which of any number of targets occur in which texts.

A target occurs where its rarest gram does.  Grams are 8 bytes of UTF-8 (shorter targets
have grams of 4, 2 or 1), so a gram is a number and equal numbers are equal bytes.

1. A bitmap of the targets' grams lets a scan of the texts count only those, by
   documents that hold them.
2. Every target is filed under its rarest gram; targets with a gram that no document
   holds are done.
3. A second scan sends each place of a filed gram with the bytes around it, as many as
   a target can need, to the targets of that gram, where they are compared.

Nothing grows with the targets but the tables that Spark shuffles: the bitmap has a
fixed size, and where it lets other grams pass, the join drops them.  Places of a gram
that very many documents hold are dealt over several partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textgauge.sources.layout import spread_rows
from textgauge.sources.sinks import checkpointed

#: Bytes of a gram, longest first.
WIDTHS = (8, 4, 2, 1)
#: The bitmap has two to this power of bits, 32 MB, and its parts as many.
BITS, _PART = 28, 20
#: Bytes of text worked on at once; a longer text is a piece of its own.
_PIECE = 1 << 20
U64 = np.uint64


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and where each text starts; null is empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(offsets: np.ndarray):
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _PIECE, "right")) - 1)
        yield i, j
        i = j


def _grams(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of grams inside single texts, and the grams as numbers."""
    n = len(data) - width + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    inside = np.ones(n, bool)
    for back in range(1, width):
        at = offsets[1:] - back
        inside[at[(at >= 0) & (at < n)]] = False
    at = np.flatnonzero(inside)
    every = np.ndarray((n,), f"<u{width}", np.ascontiguousarray(data).tobytes(), strides=(1,))
    return at, every[at].astype(U64)


def _bit(grams: np.ndarray, width: int) -> np.ndarray:
    h = (grams + U64(width)) * U64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)) >> U64(64 - BITS)


def _signed(grams: np.ndarray) -> pa.Array:
    return pa.array(grams.view(np.int64))


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Which bits the grams (width, gram) have: parts are put together by tasks of their own."""

    def bits(batches):
        for b in batches:
            width, gram = b.column(0).to_numpy(), b.column(1).to_numpy().view(U64)
            found = np.unique(np.concatenate([_bit(gram[width == w], w) for w in WIDTHS])).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"part": pa.array((found >> _PART).astype(np.int32)), "bit": pa.array((found & ((1 << _PART) - 1)).astype(np.int32))})

    def together(key, table):
        own = np.zeros(1 << _PART, bool)
        own[table.column("bit").to_numpy()] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros(1 << BITS >> 3, np.uint8)
    each = grams.mapInArrow(bits, "part int, bit int").distinct().groupBy("part").applyInArrow(together, "part int, bits binary")
    for row in each.toLocalIterator():
        size = 1 << _PART >> 3
        out[row.part * size : (row.part + 1) * size] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _passing(bitmap: np.ndarray, data: np.ndarray, offsets: np.ndarray, widths: list[int]):
    """Places and grams of each width that the bitmap lets pass."""
    for w in widths:
        at, gram = _grams(data, offsets, w)
        bit = _bit(gram, w).astype(np.int64)
        hit = (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 > 0
        yield w, at[hit], gram[hit]


def _target_grams(targets: DataFrame) -> DataFrame:
    """Every gram of every target: (target, width, gram, place)."""

    def run(batches):
        for b in batches:
            names = b.column(0)
            data, offsets = _bytes_of(b.column(1))
            size = np.diff(offsets)
            width = np.array([next(w for w in WIDTHS if w <= n) if n else 0 for n in size.tolist()])
            for w in WIDTHS:
                at, gram = _grams(data, offsets, w)
                own = np.searchsorted(offsets, at, "right") - 1
                keep = width[own] == w
                at, gram, own = at[keep], gram[keep], own[keep]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array(np.full(len(at), w), pa.int32()), _signed(gram), pa.array(at - offsets[own], pa.int32())], ["target", "width", "gram", "place"])

    return targets.select("target", "verbatim").mapInArrow(run, "target bigint, width int, gram bigint, place int")


def text_key(text: str) -> tuple[Column, Column]:
    """Two hashes of a text, h1 and h2, that stand for it beside its doc_id."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def occurrences_in(documents: DataFrame, targets: DataFrame, salted: int = 10_000) -> DataFrame:
    """Which targets occur in which texts: distinct (doc_id, h1, h2, target), where h1 and
    h2 are hashes of the text.

    ``targets`` has different non-empty texts ``verbatim`` with a number ``target``.  Places
    of grams that more than ``salted`` documents and a quarter of a partition's share hold
    are dealt out.  Null texts hold nothing.
    """
    spark = documents.sparkSession
    docs = spread_rows(documents.select("doc_id", "text").where("text IS NOT NULL")).select("*", *text_key("text"))
    grams = checkpointed(_target_grams(targets))
    widths = [w for w in WIDTHS if not grams.where(F.col("width") == w).isEmpty()]
    if not widths:
        return docs.select("doc_id", "h1", "h2", F.lit(None).cast("bigint").alias("target")).where("false")
    wanted = spark.sparkContext.broadcast(_bitmap(grams.select("width", "gram")))

    def count(batches):
        for b in batches:
            data, offsets = _bytes_of(b.column(0))
            for i, j in _pieces(offsets):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for w, at, gram in _passing(wanted.value, part, cut, widths):
                    # a document counts a gram once
                    pair = np.unique(np.rec.fromarrays([gram, np.searchsorted(cut, at, "right")], names="g,d"))
                    values, n = np.unique(pair["g"], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), w), pa.int32()), _signed(values), pa.array(n, pa.int64())], ["width", "gram", "n"])

    seen = docs.select("text").mapInArrow(count, "width int, gram bigint, n bigint").groupBy("width", "gram").agg(F.sum("n").alias("n"))
    rarest = grams.join(seen, ["width", "gram"], "left").groupBy("target", "width").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "place")).alias("r"))
    filed = checkpointed(rarest.select("target", "width", "r.*").where("n > 0").join(targets.select("target", F.col("verbatim").cast("binary").alias("v")), "target"))
    reach = filed.agg(F.max("place").alias("before"), F.max(F.octet_length("v") - F.col("place")).alias("after"), F.sum("n").alias("n")).first()
    if reach.n is None:
        return docs.select("doc_id", "h1", "h2", F.lit(None).cast("bigint").alias("target")).where("false")
    chosen = spark.sparkContext.broadcast(_bitmap(filed.select("width", "gram")))
    before, after = int(reach.before), int(reach.after)

    def places(batches):
        for b in batches:
            data, offsets = _bytes_of(b.column(3))
            for i, j in _pieces(offsets):
                part, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                whole = part.tobytes()
                for w, at, gram in _passing(chosen.value, part, cut, widths):
                    own = np.searchsorted(cut, at, "right") - 1
                    found: dict[tuple, int] = {}
                    for p, g, d in zip(at.tolist(), gram.view(np.int64).tolist(), own.tolist(), strict=True):
                        a, z = int(cut[d]), int(cut[d + 1])
                        found[d, g, whole[max(a, p - before) : p], whole[p : min(z, p + after)]] = d
                    rows = pa.array([i + d for d in found.values()], pa.int64())
                    side = [pa.array([k[n] for k in found], t) for n, t in ((1, pa.int64()), (2, pa.binary()), (3, pa.binary()))]
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in range(3)), pa.array(np.full(len(found), w), pa.int32()), *side], ["doc_id", "h1", "h2", "width", "gram", "left", "right"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    hits = docs.select("doc_id", "h1", "h2", "text").mapInArrow(places, f"doc_id {kind}, h1 bigint, h2 bigint, width int, gram bigint, left binary, right binary")
    # grams of more than a quarter of a partition's share are fewer than four for each partition
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(salted, int(reach.n) // (4 * parts))
    hot = F.broadcast(filed.groupBy("width", "gram").agg(F.max("n").alias("n")).where(F.col("n") > most).select("width", "gram", F.ceil(F.col("n") / most).cast("int").alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    dealt = hits.join(hot, ["width", "gram"], "left").withColumn("salt", F.pmod(F.col("h1"), salts).cast("int")).drop("salts")
    copies = filed.join(hot, ["width", "gram"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts", "n")
    # byte positions count from one; a target has its bytes before its gram and from it on
    fits = F.expr("substring(left, octet_length(left) - place + 1, place) = substring(v, 1, place)")
    found = dealt.join(copies, ["width", "gram", "salt"]).where(F.expr("octet_length(left) >= place")).where(fits).where(F.expr("startswith(right, substring(v, place + 1))"))
    return found.select("doc_id", "h1", "h2", "target").distinct()
