"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (large star) or smaller (small star) neighbours to
    the least node around it.  Minima are combined before the shuffle, so a hub
    costs one row per partition; the join that follows is one AQE can split."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    turned = both if large else both.where("b < a")
    least = turned.groupBy(F.col("a").alias("u")).agg(F.min(F.least("a", "b")).alias("m"))
    moved = turned.where("b > a") if large else turned
    out = moved.join(least, moved.a == least.u).select(F.col("b").alias("x"), "m")
    if not large:
        out = out.unionByName(least.select(F.col("u").alias("x"), "m"))
    return out.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Nodes with the least node of their component: (node, component).

    ``edges`` has integer columns a and b; loops and nulls are dropped, and nodes
    without an edge are not returned.  Each round writes its edges to the shared
    checkpoint folder.
    """
    e = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    sign = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign or not now[0]:
            break
        sign = now
        e = materialize(_star(_star(e, large=True), large=False))
    return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
