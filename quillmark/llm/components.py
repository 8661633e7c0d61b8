"""Connected components by alternating large-star and small-star contraction.

Each round is a pair of grouped minima and joins on Spark; edges stay
distributed throughout and only a count and a checksum reach the driver.
A hub's edges are never gathered: they are dealt over SALTS keys, whose minima
are map-side combined; a node's least minimum goes back to the salts that it
has, and the join with the edges is on node and salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Keys over which the edges of a node are dealt.
SALTS = 32


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) with ``m``, the least v of their u; and (u, m), one row for each u."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("part"))
    low = parts.groupBy("u").agg(F.min("part").alias("m"), F.collect_list("salt").alias("salts"))  # at most SALTS values
    return salted.join(low.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).drop("salt"), low.select("u", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Point every larger neighbour of a node at the smallest node around it."""
    near, _ = _with_least(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    least = F.least("u", "m")
    return near.where((F.col("v") > F.col("u")) & (F.col("v") != least)).select(F.col("v").alias("u"), least.alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Point a node and its smaller neighbours at the smallest of them (u > v in every edge)."""
    near, low = _with_least(edges)
    moved = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Label every node that has an edge with the smallest node it can reach.

    edges: two integer columns; self-loops, repeated and reversed rows and
    rows with nulls are allowed (the last are ignored). Returns
    ``node`` and ``component`` (bigint); nodes that only have self-loops, and
    therefore no other member, do not appear. An empty input gives an empty
    result. The number of rounds grows with the logarithm of the component
    size; each round's edges are written to the shared folder, and the
    round before is deleted.
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v")).distinct()
    check = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v") % (1 << 31))}
    now, seen, path = common.materialize_counted(pairs, "edges", **check)
    while seen["n"]:
        after, got, new = common.materialize_counted(_small_star(_large_star(now)), "edges", **check)
        common.remove(spark, path)
        now, path = after, new
        if got == seen:
            break
        seen = got
    flat = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return flat.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
