"""Connected components of an edge table by alternating large and small stars.

Every round is grouping and joins over the edges; nothing but a count and a
checksum of the edge table reaches the driver.  Each round is written to the
shared folder, so a lost executor costs one round at most, and both sides of
the joins are stored tables, which lets Spark split the rows of a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlscore.session import stash


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """``pairs`` (u, v): for each u the least m among u and its v; small star:
    u and all v point to m; large star: every v > u points to m."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = stash(pairs, "star-pairs").join(stash(least, "star-least"), "u")
    if small:
        out = joined.select(F.col("v").alias("u"), "m").union(least.select("u", "m"))
    else:
        out = joined.filter("v > u").select(F.col("v").alias("u"), "m")
    return out.filter("u != m").select("u", F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns u and v; returns ``node`` and ``root`` (the least node
    of the component) for every node of an edge between different nodes."""
    e = stash(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(),
              "star-edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = stash(_star(stash(_star(both, small=False), "star-large"), small=True), "star-small")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
