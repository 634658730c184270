"""Distributed connected components by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in `edges` (a, b): the smallest node that it reaches.

    Each round hooks every node to its smallest neighbour, if that is smaller, shortens
    those chains by half and replaces the edges' ends by what they hook to; edges within one
    end vanish. Nodes with an edge left at least halve, so rounds are logarithmic. A hub's
    edges are spread by salts, minima are pre-aggregated, and every round is a written
    table, so nothing is collected and lost executors cost one step."""
    spark = edges.sparkSession
    left, _ = common.saved(edges.select("a", "b").where("a <> b AND a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        hook, once = common.saved(hook, "hooks")
        up = hook.select(F.col("node").alias("to"), F.col("to").alias("further"))
        short = common.salted_lookup(hook, "to", F.xxhash64("node"), up).select("node", F.coalesce("further", "to").alias("to"))
        short, _ = common.saved(short, "hooks")
        common.drop(spark, once)
        steps.append(short)
        at_a = short.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        at_b = short.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = common.salted_lookup(left, "a", F.xxhash64("b"), at_a)
        moved = common.salted_lookup(moved, "b", F.xxhash64("a"), at_b)
        left, _ = common.saved(moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    out = steps[0].withColumnRenamed("to", "component")
    for step in steps[1:]:
        more = step.select(F.col("node").alias("component"), F.col("to").alias("next"))
        # written each time: a lookup reads its left side twice, so plans would double
        out, _ = common.saved(common.salted_lookup(out, "component", F.xxhash64("node"), more).select("node", F.coalesce("next", "component").alias("component")), "components")
    return out
