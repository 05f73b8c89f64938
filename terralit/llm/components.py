"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of a non-null ordered type -> (node, root); the root is the component's least node.

    Each step groups by node and so shuffles the edges once; the number of steps grows with the
    logarithm of the component's diameter.  Each round is written to the shared folder, which cuts the
    lineage.  Loops (a = b) give a node that is its own root; empty edges give an empty result."""
    kind = edges.schema["a"].dataType.simpleString()
    now = written(edges.selectExpr("greatest(a, b) u", "least(a, b) v").distinct(), "cc")
    nodes = now
    seen = None
    while True:
        both = now.filter("u <> v").selectExpr("u n", "v m").unionAll(now.filter("u <> v").selectExpr("v n", "u m"))
        # Large star: greater neighbours of n are tied to the least node near n.
        least = F.expr("least(n, min(m))")
        large = (both.groupBy("n").agg(least.alias("root"), F.collect_set(F.when(F.col("m") > F.col("n"), F.col("m"))).alias("ms"))
                 .select(F.explode("ms").alias("u"), F.col("root").alias("v")))
        # Small star: n and its lesser neighbours are tied to the least of them.
        small = (large.groupBy("u").agg(F.min("v").alias("root"), F.collect_set("v").alias("ms"))
                 .select(F.explode(F.array_union("ms", F.array("u"))).alias("u"), F.col("root").alias("v"))
                 .filter("u <> v").distinct())
        old, now = now, written(small, "cc")
        if old is not nodes:
            discard(old)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark:
            break
        seen = mark
    found = now.selectExpr("u node", "v root")
    return (found.unionAll(found.selectExpr("root node", "root"))
            .unionAll(nodes.filter("u = v").selectExpr("u node", "v root"))
            .groupBy("node").agg(F.min("root").cast(kind).alias("root")))
