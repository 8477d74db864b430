"""Distributed gapless numbering without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, within: str, order: list[str], parts: int, into: str) -> DataFrame:
    """Number the rows of each ``within`` value 0, 1, ... into the column ``into``.

    Rows are numbered inside hash chunks of (within, order); the counts of the
    chunks, ``parts`` for each value, give every chunk its offset.  The order of
    chunks is by number, so the numbering is the same for any partitioning, and
    no task sees more than a chunk's rows.
    """
    chunked = df.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = chunked.groupBy(within, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(within).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(within, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    here = Window.partitionBy(within, "__chunk").orderBy(*order)
    numbered = chunked.withColumn("__row", F.row_number().over(here) - 1)
    out = numbered.join(offsets, [within, "__chunk"])
    return out.withColumn(into, (F.col("__row") + F.col("__offset")).cast("bigint")).drop("__chunk", "__row", "__offset")
