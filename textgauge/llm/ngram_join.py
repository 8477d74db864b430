"""N-gram Jaccard self-join by rare-first prefix filtering.

1. Documents with one and the same shingle set become one class; only its
   representative, the smallest doc_id, is joined.
2. Buckets send their distinct shingle hashes with counts, Golomb-coded, to hash
   owners, who return each shingle's document frequency as a level.  Levels are a
   function of the hash, so (level, hash) is one global order, rare first.
3. A document of n shingles that reaches the threshold with another shares one of
   its first n - ceil(t n) + 1 shingles in that order.  Shingles of one document
   are left out of the index, as they can match nothing.
4. Prefixes meet on shared shingles.  Each posting list links its members to the
   member with the fewest rarer shingles; only where members are not yet in one
   component are the other pairs formed.  So copies cost a star, not all pairs,
   and no link that could join two components is skipped.
5. Length and positional filters run in the join, the suffix filter before the
   count of common shingles, and each pair is verified once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.sources.layout import spread_rows

from .common import byte_set, byte_table, exchange_sizes, join_counted, keyed, materialize, mix, pieces, texts, word_hashes, word_runs
from .components import components
from .exchange import MOST_BLOBS, Route, exchange, golomb, pack, route, ungolomb, unpack

U64 = np.uint64
#: Shingles that a posting looks back on to form each pair once.
RECENT = 64
_VALUES = byte_table(lower=True)
_INSIDE = ~byte_set(space=(32, 32), controls=(9, 13))
_STEP = [U64(x | 1) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a document of fewer words
    has its whole sequence as the only shingle, one without words has none."""
    out = []
    for i, j in pieces(offsets):
        part = offsets[i : j + 1]
        own, at = data[part[0] : part[-1]], part - part[0]
        start, end, first = word_runs(own, at, _INSIDE)
        h = word_hashes(own, start, end, _VALUES)
        n = len(h) - width + 1
        whole = np.zeros(max(0, n), U64)
        for k in range(width if n > 0 else 0):
            whole += h[k : n + k] * _STEP[k]
        whole = mix(whole)
        for d in range(j - i):
            a, z = first[d], first[d + 1]
            if z - a >= width:
                s = np.sort(whole[a : z - width + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif z > a:
                out.append(mix(np.array([np.sum(h[a:z] * np.array(_STEP[: z - a])) + U64(z - a)], U64)))
            else:
                out.append(np.zeros(0, U64))
    return out


def _print(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set."""
    a, b = mix(s ^ U64(0x243F6A8885A308D3)), mix(s ^ U64(0x13198A2E03707344))
    return int(a.sum(dtype=U64).view(np.int64)), int(b.sum(dtype=U64).view(np.int64))


def _profile(width: int):
    def run(batches):
        for b in batches:
            data, offsets = texts(b.column(1))
            sets = shingle_sets(data, offsets, width)
            prints = [_print(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([p for p, _ in prints], pa.int64()), pa.array([p for _, p in prints], pa.int64()), pa.array(np.diff(offsets))],
                ["doc_id", "n", "f1", "f2", "size"],
            )

    return run


def _wanted(docs: pa.Table, reps: pa.Table, width: int):
    """Sets of the bucket's representatives, each once."""
    want = {}
    for i, f in zip(reps.column("doc_id").to_pylist(), reps.column("f1").to_pylist(), strict=True):
        want.setdefault(i, set()).add(f)
    ids = docs.column("doc_id").to_pylist()
    some = [k for k, i in enumerate(ids) if i in want]
    some.sort(key=lambda k: ids[k])
    sets = shingle_sets(*texts(docs.column("text").take(pa.array(some, pa.int64()))), width)
    found = []
    for k, s in zip(some, sets, strict=True):
        if len(s) and (f := _print(s)[0]) in want[ids[k]]:
            want[ids[k]].discard(f)
            found.append((ids[k], s))
    return found


def _bucket_keys(found, drop: int):
    every = np.concatenate([s for _, s in found]) >> U64(drop) if found else np.zeros(0, U64)
    return np.unique(every, return_inverse=True, return_counts=True)


_BLOB = "target int, source int, a binary, b binary"


def _blobs(rows):
    c = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table({"target": pa.array(list(c[0]), pa.int32()), "source": pa.array(list(c[1]), pa.int32()), "a": pa.array(list(c[2]), pa.binary()), "b": pa.array(list(c[3]), pa.binary())})


def _count_rows(source: int, parts: dict, keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    # a count beyond 32 bits has the highest level anyway
    short = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)
    return [(target, source, golomb(keys[x:z]), pack(short[x:z])) for target, (x, z) in parts.items()]


def _send_counts(width: int, way: Route, drop: int):
    def run(key, docs, reps):
        keys, _, counts = _bucket_keys(_wanted(docs, reps, width), drop)
        bucket = key[0].as_py()
        return _blobs(_count_rows(bucket, way.parts(bucket, keys << U64(drop)), keys, counts))

    return run


class _Counts:
    """Hashes that blobs hold: distinct ones, ascending, with their summed counts."""

    def __init__(self, rows):
        self.source = rows.column("source").to_pylist()
        runs = [ungolomb(x) for x in rows.column("a").to_pylist()]
        counts = [unpack(x, np.int32) for x in rows.column("b").to_pylist()]
        h, c = np.concatenate(runs), np.concatenate(counts).astype(np.int64)
        self.order = order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
        self.group = np.diff(np.append(start, len(order)))
        self.hashes, self.total = h[order][start], np.add.reduceat(c[order], start)
        self.cuts = np.concatenate([[0], np.cumsum([len(r) for r in runs])])

    def replies(self, own: int, level: np.ndarray) -> pa.Table:
        out = np.empty(len(self.order), np.uint8)
        out[self.order] = np.repeat(level, self.group)
        return _blobs([(s, own, pack(out[self.cuts[i] : self.cuts[i + 1]]), b"") for i, s in enumerate(self.source)])


def _levels(key, rows):
    """Owner: document frequency of every hash as a level, eight to a doubling; 0 where it is one."""
    counts = _Counts(rows)
    return counts.replies(key[0].as_py(), np.minimum(255, np.round(8 * np.log2(counts.total))).astype(np.uint8))


def _merge_counts(way: Route, drop: int):
    def run(key, rows):
        counts, relay = _Counts(rows), key[0].as_py()
        return _blobs(_count_rows(relay, way.relayed(relay, counts.hashes << U64(drop)), counts.hashes, counts.total))

    return run


def _read_levels(replies: pa.Table, parts: dict, n: int) -> np.ndarray:
    level = np.zeros(n, np.uint8)
    for source, a in zip(replies.column("source").to_pylist(), replies.column("a").to_pylist(), strict=True):
        x, z = parts[source]
        level[x:z] = unpack(a, np.uint8)
    return level


def _answer_counts(way: Route, drop: int):
    def run(key, rows, replies):
        if not rows.num_rows:
            return _blobs([])
        counts, relay = _Counts(rows), key[0].as_py()
        parts = way.relayed(relay, counts.hashes << U64(drop))
        return counts.replies(relay, _read_levels(replies, parts, len(counts.hashes)))

    return run


def least_common(n, m, percent: int):
    """Common shingles that sets of sizes n and m need: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def _prefixes(width: int, way: Route, drop: int, percent: int):
    def run(key, docs, rows):
        reps = rows.filter(pc.is_null(rows.column("source")))
        replies = rows.filter(pc.is_valid(rows.column("source")))
        found = _wanted(docs, reps, width) if docs.num_rows else []
        keys, inverse, _ = _bucket_keys(found, drop)
        parts = way.parts(key[0].as_py(), keys << U64(drop)) if replies.num_rows else {}
        level = _read_levels(replies, parts, len(keys))[inverse].astype(U64)
        ids, sizes, tokens, places, sets, at = [], [], [], [], [], 0
        for i, s in found:
            n = len(s)
            rank = np.sort((level[at : at + n] << U64(56)) | (s >> U64(8)))
            at += n
            head = rank[: n - -(-percent * n // 100) + 1]
            common = np.flatnonzero(head >> U64(56))
            if len(common):
                ids.append(i)
                sizes.append(n)
                tokens.append(head[common].view(np.int64).tolist())
                places.append(common.tolist())
                sets.append(rank.tobytes())
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n": pa.array(sizes, pa.int64()),
                "tokens": pa.array(tokens, pa.list_(pa.int64())),
                "places": pa.array(places, pa.list_(pa.int32())),
                "shingles": pa.array(sets, pa.binary()),
            }
        )

    return run


# ------------------------------------------------------------------ verification


def apart(x: np.ndarray, y: np.ndarray, most: int, depth: int) -> int:
    """Suffix filter: a lower bound of the elements in one of two ordered sets only."""
    gap = abs(len(x) - len(y))
    if depth == 0 or gap > most or not len(x) or not len(y):
        return gap
    middle = len(y) >> 1
    w = y[middle]
    k = int(np.searchsorted(x, w))
    same = k < len(x) and x[k] == w
    rest = len(x) - k - same
    left, right = abs(k - middle), abs(rest - (len(y) - middle - 1))
    if left + right + (not same) > most:
        return left + right + (not same)
    left = apart(x[:k], y[:middle], most - right - (not same), depth - 1)
    if left + right + (not same) > most:
        return left + right + (not same)
    return left + apart(x[k + same :], y[middle + 1 :], most - left - (not same), depth - 1) + (not same)


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for k, (p, q) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (p, q))
                need = least_common(len(x), len(y), percent)
                if apart(x, y, len(x) + len(y) - 2 * need, 3) > len(x) + len(y) - 2 * need:
                    continue
                common = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                if common >= need:
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def _need(n, m, percent: int):
    return _ceil_div((n + m) * percent, 100 + percent)


def _ceil_div(a, b: int):
    """Whole numbers only: a float could miss the threshold of very large sets."""
    return F.call_function("div", a + F.lit(b - 1), F.lit(b))


def _can_match(x: str, y: str, percent: int):
    """Length and positional filters for a shared shingle, which stands at place p of
    n in its document with e shared ones in front of it."""
    n, p, e, m, q, f = (F.col(f"{side}.{c}") for side in (x, y) for c in "npe")
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (F.least(e, f) + F.least(n - p, m - q) >= _need(n, m, percent))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a bigint, b bigint")


def _index(docs: DataFrame, width: int, percent: int, buckets: int | None, owners: int | None, most_blobs: int = MOST_BLOBS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class (doc_id, n, f1, rep, n_same), prefixes of the classes'
    representatives as postings (token, doc_id, n, p, e), and their ordered sets."""
    if width > len(_STEP):
        raise ValueError(f"width: at most {len(_STEP)} words")
    docs = keyed(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    profile = materialize(spread_rows(docs).mapInArrow(_profile(width), "doc_id bigint, n bigint, f1 bigint, f2 bigint, size bigint"))
    total, size = profile.agg(F.sum("n"), F.sum("size")).first()
    buckets, owners = exchange_sizes(docs.sparkSession, size or 0, buckets, owners)
    # a hash is cut to so many bits that one in some thousands meets another by chance, which costs time only
    drop = max(0, 64 - max(32, (total or 0).bit_length() + 13))
    usable = profile.where("n > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_same"))
    members = materialize(join_counted(profile, classes, ["f1", "f2", "n"], "n_same", "left").select("doc_id", "n", "f1", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"), "n_same"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    reps = members.where("doc_id = rep").select(bucket.alias("target"), F.lit(None).cast("int").alias("source"), "doc_id", "f1").distinct()
    dealt = docs.select(bucket.alias("bucket"), "doc_id", "text").where("doc_id IS NOT NULL").groupBy("bucket")
    way = route(buckets, owners, most_blobs)
    counts = dealt.cogroup(reps.groupBy("target")).applyInArrow(_send_counts(width, way, drop), _BLOB)
    levels = exchange(counts, way, _levels, _merge_counts(way, drop), _answer_counts(way, drop), _BLOB)
    rows = levels.unionByName(reps, allowMissingColumns=True)
    indexed = materialize(dealt.cogroup(rows.groupBy("target")).applyInArrow(_prefixes(width, way, drop, percent), "doc_id bigint, n bigint, tokens array<bigint>, places array<int>, shingles binary"))
    postings = indexed.select("doc_id", "n", F.posexplode(F.arrays_zip("tokens", "places")).alias("e", "z"))
    postings = postings.select(F.col("z.tokens").alias("token"), "doc_id", "n", F.col("z.places").cast("bigint").alias("p"), F.col("e").cast("bigint").alias("e"))
    return members, postings, indexed.select("doc_id", "shingles")


def _pairs(rows: DataFrame, differ: str, percent: int) -> DataFrame:
    """Pairs (a, b) of postings that share a token, pass the length and positional
    filters and have a smaller ``differ`` in a than in b, each once.

    A pair is formed at its first common shingle, as far as the last ``RECENT`` ones
    of each document tell.  For documents with no more postings than those, all
    earlier common shingles are known, so there the positional filter is asked again
    with none in front; for longer ones it is left out and pairs may be formed twice.
    Either way no pair that can reach the threshold is left out.  AQE splits the
    partitions of frequent tokens.
    """
    recent = Window.partitionBy("doc_id").orderBy("e").rowsBetween(-RECENT, -1)
    order = Window.partitionBy("doc_id").orderBy("e")
    rows = materialize(rows.select("token", "doc_id", "n", "p", "e", F.col(differ).alias("c"), F.collect_list("token").over(recent).alias("seen"), F.row_number().over(order).alias("k")))
    x, y = rows.alias("x"), rows.alias("y")
    whole = (F.col("x.k") <= RECENT + 1) & (F.col("y.k") <= RECENT + 1)
    fresh = ~F.arrays_overlap("x.seen", "y.seen") & (~whole | (F.least(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p")) >= _need(F.col("x.n"), F.col("y.n"), percent)))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.c") < F.col("y.c")) & _can_match("x", "y", percent) & fresh)
    return met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()


def near_pairs(docs: DataFrame, width: int = 5, percent: int = 80, buckets: int | None = None, owners: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every link between different shingle sets, for callers that want the pairs.

    Returns the links (a, b; a < b) between the representatives of classes of equal
    sets, and the membership (doc_id, rep, n_shingles); edge cases as in
    ``near_duplicates``.  The number of links inside a group of near copies grows
    with its square, so for components ``near_duplicates`` is the one to take.
    """
    members, postings, sets = _index(docs, width, percent, buckets, owners)
    lists = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = join_counted(postings, lists, ["token"], "k").drop("k").withColumn("c", F.col("doc_id"))
    links = _links(_pairs(shared, "c", percent), sets, percent)
    return links, members.select("doc_id", "rep", F.col("n").alias("n_shingles"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, buckets: int | None = None, owners: int | None = None, most_blobs: int = MOST_BLOBS) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard of percent/100 or more.

    Words are runs of bytes other than space and \t to \r, after lower-casing
    A-Z.  Returns one row per input row: doc_id, n_shingles, component_id (the
    least doc_id reachable by links), n_same (rows with the same set).  Null,
    empty and blank texts have no shingles and link with nothing.  Rows that
    share a doc_id are one node.  A null doc_id is linked with nothing and has a
    null component.  Other columns are ignored; an empty table gives none.  Beyond
    ``most_blobs`` blobs the counts go by relays; the result is the same.
    """
    members, postings, sets = _index(docs, width, percent, buckets, owners, most_blobs)

    # rows that share a doc_id but not a set are one node
    nodes = members.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    shared = nodes.join(members, "doc_id").select("a", F.col("rep").alias("b"))

    lead = postings.groupBy("token").agg(F.min(F.struct("p", "doc_id", "n", "e")).alias("l"), F.count(F.lit(1)).alias("k")).where("k > 1")
    star = join_counted(postings, lead, ["token"], "k").alias("x").where("x.doc_id <> l.doc_id").where(_can_match("x", "l", percent))
    star = materialize(star.select(F.col("l.doc_id").alias("a"), F.col("x.doc_id").alias("b")).distinct())
    first = materialize(_links(star, sets, percent))
    label = components(first.unionByName(shared))

    # pairs that could still join two components: of each list only members that
    # its smallest set could match, and only lists with two components; those with
    # one hold no such pair, so they need not be looked at for the first common shingle
    named = postings.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")
    lists = named.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).where("c0 <> c1")
    floor = F.greatest(F.col("least"), _ceil_div(F.col("n") * percent, 100))
    left = join_counted(named, lists, ["token"], "k").where(F.col("e") + F.col("n") - F.col("p") >= _need(F.col("n"), floor, percent))
    cross = _pairs(left, "c", percent)
    tried = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = _links(cross.join(tried, ["a", "b"], "left_anti"), sets, percent)
    label = components(first.unionByName(second).unionByName(shared))

    # the label of a class meets as many rows as the class has
    sizes = members.where("rep IS NOT NULL").groupBy("rep").agg(F.count(F.lit(1)).alias("__k"))
    named = label.withColumnRenamed("node", "rep").join(sizes, "rep")
    out = join_counted(members, named, ["rep"], "__k", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("n_same", F.lit(1).cast("bigint")).alias("n_same"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of least doc_id, with all its columns.

    Of rows that repeat its doc_id one stays.  Documents without shingles and
    rows with a null doc_id stay.
    """
    found = near_duplicates(docs, width, percent).where("doc_id IS NOT NULL")
    ids = materialize(found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("k")))
    kept = docs.join(ids.where("c = doc_id").select("doc_id"), "doc_id", "left_semi")
    if ids.where("c = doc_id AND k > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)
