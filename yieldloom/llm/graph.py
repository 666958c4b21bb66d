"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its least neighbour to its larger (or its smaller and equal) neighbours."""
    if large:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = ways.join(least, "a")
    if large:
        made = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return made.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) of each node of the edges (a, b), both bigint. Loops and repeats do no harm."""
    now = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    state = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"), F.sum(F.col("b").cast("decimal(38,0)")).alias("t")).first()
        if tuple(sums) == state or not sums["n"]:
            break
        state = tuple(sums)
        now = materialize(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
