"""Contiguous shards, resumable batches and run identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textgauge.sources.sinks import checkpointed


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``pos`` 0, 1, ... over the whole table in ``order``, without a single-task window.

    Rows are range-partitioned; each partition is numbered on its own and shifted
    by the sizes of those before it, of which the driver sees one number each.
    """
    # written once, as a second sampling could choose other range bounds
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    shift, total = [], 0
    for k in sorted(counts):
        shift += [F.lit(k), F.lit(total).cast("bigint")]
        total += counts[k]
    w = Window.partitionBy("__part").orderBy(*order)
    base = F.create_map(*shift)[F.col("__part")] if shift else F.lit(0)
    return ranged.withColumn("pos", (F.row_number().over(w) - 1 + base).cast("bigint")).drop("__part")


def contiguous_shards(df: DataFrame, shards: int, *order: str) -> DataFrame:
    """Shard i holds places n*i//shards up to n*(i+1)//shards of the order."""
    placed = positions(df, *order)
    n = max(1, df.count())
    # the largest i with n * i // shards <= pos, in whole numbers
    return placed.withColumn("shard", F.expr(f"cast(((pos + 1) * {shards} - 1) div {n} as int)"))


def run_identity(files: DataFrame) -> DataFrame:
    """SHA-256 over a file inventory (name, size, hash), whatever its order.

    An inventory is configuration: a row for each input file.
    """
    lines = F.sort_array(F.collect_list(F.concat_ws("\t", "name", F.col("size").cast("string"), "hash")))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def changed_artifacts(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded artifacts that are missing or have another hash."""
    out = recorded.join(actual.select("path", F.col("sha256").alias("found")), "path", "left")
    return out.where(~F.col("sha256").eqNullSafe(F.col("found"))).withColumn("fault", F.when(F.col("found").isNull(), "missing").otherwise("changed"))


def backoff_seconds(attempt, most: int = 60):
    return F.least(F.lit(most), F.lit(10) * attempt)
