"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Each starts in the shard that its id
hashes to.  Groups that are large beside a shard are dealt first, each to as few
shards as hold it.  In every round the documents of the other groups are counted
by shard, and each group moves to the shard where most of it is, as far as there is
room; a refused group tries another shard with room in the next round, until every
group has one.  So cut links fall while no shard is overfilled.  At last the shards
are evened out to sizes at most one apart, moving documents without links first.

All counts are combined in each partition before they are shuffled, a hot group
is counted and split by rows and never gathered, and the driver sees only one
row for each shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, materialize, partitions
from .ranking import gapless

_UNIT = 1 << 40


def _draw(*columns: str):
    """A fraction in [0, 1) that depends on the columns only."""
    return F.pmod(F.xxhash64(*columns), F.lit(_UNIT)) / F.lit(float(_UNIT))


def _lookup(values: dict[int, float], at):
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (int(k), float(v))]), at)


def _deal_hot(hot: list[tuple[int, int]], room: dict[int, float]) -> list[tuple[int, float, float, int]]:
    """Shards for the groups that are large beside a shard, largest first: one where it
    fits, else as few as hold it.  Gives (key, from, to, shard) with shares of its rows."""
    out = []
    for key, n in sorted(hot, key=lambda g: (-g[1], g[0])):
        left = n
        while left > 0:
            shard = max(room, key=lambda k: (room[k], -k))
            part = left if room[shard] < 1 else min(left, int(room[shard]))
            out.append((key, (n - left) / n, (n - left + part) / n if part < left else 2.0, shard))
            room[shard] -= part
            left -= part
    return out


def _propagate(loose: DataFrame, room: dict[int, float]) -> list[DataFrame]:
    """Rounds of propagation on groups (key, n, held), until each has one shard.

    A group wishes for the shard that holds most of it among those with room, or for
    any with room, drawn anew in each round.  Returns parts with (key, shard)."""
    settled, turn = [], 0
    while not loose.isEmpty():
        open_ = {k: v for k, v in room.items() if v >= 1} or room
        has = lambda h: h["shard"].isin(list(open_))
        best = F.array_max(F.filter("held", has))["shard"]
        total = sum(max(v, 0.0) for v in open_.values()) or 1.0
        lot = _draw("key", F.lit(turn), F.lit(1))
        bounds, at = [], 0.0
        for k, v in sorted(open_.items()):
            at += max(v, 0.0) / total
            bounds.append((at, k))
        any_ = F.lit(bounds[-1][1])
        for upto, k in reversed(bounds[:-1]):
            any_ = F.when(lot < upto, k).otherwise(any_)
        # after the first round whoever was refused may also try elsewhere
        wish = loose.withColumn("wish", (F.coalesce(best, any_) if turn < 3 else any_).cast("int"))
        come = {r.wish: r.n for r in wish.groupBy("wish").agg(F.sum("n").alias("n")).collect()}
        share = {k: min(1.0, max(0.0, room[k]) / n) for k, n in come.items()}
        judged = materialize(wish.withColumn("enters", _draw("key", F.lit(turn)) < _lookup(share, F.col("wish"))))
        entered = {r.wish: r.n for r in judged.where("enters").groupBy("wish").agg(F.sum("n").alias("n")).collect()}
        if not entered:
            # too little room for anyone: the last go whole where they wish, and evening out takes the excess
            settled.append(judged.select("key", F.col("wish").alias("shard")))
            break
        for k, n in entered.items():
            room[k] -= n
        settled.append(judged.where("enters").select("key", F.col("wish").alias("shard")))
        loose, turn = judged.where("NOT enters").select("key", "n", "held"), turn + 1
    return settled


def shard_rows(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put every row into a shard, with row counts at most one apart.

    Takes ``doc_id`` and ``text``.  Returns one row per input row: doc_id, size
    (UTF-8 bytes plus one; null text has none), text_crc32 (null text: of the
    empty text), shard (0 to shards - 1), slot (0, 1, ... in each shard), group
    (documents with equal texts; null and empty differ).  Rows that repeat are
    told apart by nothing, so which of them takes which place is not defined;
    an empty table gives none.  Other columns are ignored.
    """
    parts = partitions(docs.sparkSession)
    raw = F.coalesce("text", F.lit("")).cast("binary")
    key = F.when(F.col("text").isNotNull(), F.xxhash64(F.xxhash64("text"), F.crc32(raw), F.octet_length("text")))
    rows = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(raw).cast("bigint").alias("text_crc32"),
            F.coalesce(key, F.lit(0)).alias("key"),
        )
    )
    total = rows.count()
    groups = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    quota = total / shards
    large = (F.col("n") > 1) & (F.col("n") > quota / 10)
    # at most ten for each shard
    hot = [(r.key, r.n) for r in groups.where(large).collect()]
    room = {k: quota for k in range(shards)}
    deal = docs.sparkSession.createDataFrame(_deal_hot(hot, room), "key long, low double, high double, shard int")
    rows = join_counted(rows, groups, ["key"], "n").withColumn("first", F.pmod(F.xxhash64("doc_id", "key"), F.lit(shards)).cast("int"))
    rows = materialize(rows)
    small = rows.where((F.col("n") > 1) & ~large)
    held = small.groupBy("key", "n", "first").agg(F.count(F.lit(1)).alias("here"))
    # ties differ by group, so that no shard draws them all
    loose = materialize(held.groupBy("key", "n").agg(F.collect_list(F.struct("here", F.xxhash64("key", "first").alias("tie"), F.col("first").alias("shard"))).alias("held")))
    placed = docs.sparkSession.createDataFrame([], "key long, shard int")
    for part in _propagate(loose, room):
        placed = placed.unionByName(part)
    lot = _draw("row", "key")
    out = rows.where("n = 1").withColumn("shard", F.col("first"))
    out = out.unionByName(small.join(placed, "key"))
    wide = rows.where(large).withColumn("lot", lot)
    out = out.unionByName(wide.join(F.broadcast(deal), "key").where("lot >= low AND lot < high").select(*rows.columns, "shard"))
    rows = out.drop("first")
    return _even(materialize(rows), shards, total, parts)


def _even(rows: DataFrame, shards: int, total: int, parts: int) -> DataFrame:
    """Move the least linked rows from full shards to short ones, then number the slots."""
    goal = [total // shards + (k < total % shards) for k in range(shards)]
    # the shards that hold most get the larger goals
    have = {r.shard: r["count"] for r in rows.groupBy("shard").count().collect()}
    order = sorted(range(shards), key=lambda k: (-have.get(k, 0), k))
    goal = {k: goal[i] for i, k in enumerate(order)}
    over = {k: max(0, have.get(k, 0) - goal[k]) for k in goal}
    under = {k: max(0, goal[k] - have.get(k, 0)) for k in goal}
    surplus = {k: v for k, v in over.items() if v}
    if surplus:
        # rows without links come first, then those of the smallest groups; within a class of sizes by number
        level = F.least(F.lit(40), F.floor(F.log2("n"))).cast("int")
        ranked = rows.withColumn("level", level)
        classes = ranked.groupBy("shard", "level").count().collect()  # at most 41 rows for each shard
        before, base = {}, {k: 0 for k in goal}
        for r in sorted(classes, key=lambda r: (r.shard, r.level)):
            before[r.shard * 64 + r.level] = base[r.shard]
            base[r.shard] += r["count"]
        ranked = gapless(ranked.withColumn("pool", F.col("shard") * 64 + F.col("level")), "pool", ["key", "row"], parts, "place")
        lookup = lambda d, c: F.element_at(F.create_map(*[F.lit(x) for k, v in d.items() for x in (int(k), int(v))]), c)
        place = F.col("place") + lookup(before, F.col("pool"))
        first, at = {}, 0
        for k in sorted(over):
            first[k] = at
            at += over[k]
        leaves = place < lookup(over, F.col("shard"))
        seat = place + lookup(first, F.col("shard"))
        to, at = F.lit(None).cast("int"), 0
        for k in sorted(under):
            if under[k]:
                to = F.when((seat >= at) & (seat < at + under[k]), F.lit(k)).otherwise(to)
                at += under[k]
        rows = ranked.withColumn("shard", F.when(leaves, to).otherwise(F.col("shard"))).drop("level", "pool", "place")
    out = gapless(rows, "shard", ["key", "row"], parts, "slot")
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot", F.col("key").alias("group"), "row")
