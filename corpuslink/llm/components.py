"""Connected components of a table of links, by alternating stars.

Every round links each node's larger neighbours to its smallest one, then its smaller ones, until the links are stars around
the smallest node of each component. A round is an aggregate (combined before its shuffle) and a join whose large keys
adaptive execution splits; links are written to the shared checkpoint folder after each round. No links or components reach
the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslink.session import frozen


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (u > v). Large: v's of every node's greater neighbours become the least of its neighbours and itself; small:
    the same for its lesser neighbours and itself."""
    if large:
        sides = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
    else:
        sides = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = sides.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("b").alias("u"), F.col("m").alias("v")), F.struct(F.col("a").alias("u"), F.col("m").alias("v")))).alias("l")).select("l.*")
    return out.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link but each component's smallest; component is that smallest node."""
    now = frozen(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        now = frozen(_star(_star(now, True), False))
        r = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if tuple(r) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = tuple(r)
