"""How a table's rows lie in partitions before a costly stage that only maps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def _bytes(size: str) -> int:
    m = re.fullmatch(r"(\d+)\s*([bkmg]?)b?", str(size).strip().lower())
    return int(m[1]) * _UNITS[m[2]] if m else 128 << 20


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` over all cores where one scan partition could hold it.

    A file of one row group is read by one task, whatever the number of cores.  Up
    to the size of one scan partition (``spark.sql.files.maxPartitionBytes``) rows
    are dealt out at the cost of one small exchange; larger tables have row groups
    of their own and stay as they are.  Rows and results are the same either way.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size > _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")):
        return df
    return df.repartition(2 * spark.sparkContext.defaultParallelism)
