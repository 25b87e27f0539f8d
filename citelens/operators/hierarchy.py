"""Hierarchies with several parents: ancestors level by level, roots, votes of roots, scores by depth, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.storage import forget, written


def parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent").agg(F.count("*").alias("degree"))


def ancestors(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, ancestor, depth: the least depth at which the ancestor is met; every node is its own ancestor at depth 0.

    Up to a depth, where that is the operator's feature; else until a level brings nothing new, each level being written to the
    shared folder. Only pairs that are new go on, so a cycle ends too."""
    edges = edges.select("child", "parent").distinct()
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    level = nodes.select("node", F.col("node").alias("ancestor"))
    up = lambda pairs: pairs.join(edges, pairs["ancestor"] == edges["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
    every = level.withColumn("depth", F.lit(0))
    if most is not None:
        for depth in range(1, most + 1):
            level = up(level)
            every = every.unionByName(level.withColumn("depth", F.lit(depth)))
        return every.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))
    depth, every = 0, written(every, "ancestors")
    level = every.select("node", "ancestor")
    while True:
        depth += 1
        level = written(up(level).join(every, ["node", "ancestor"], "left_anti"), "ancestors-new")
        if level.isEmpty():
            return every
        before, every = every, written(every.unionByName(level.withColumn("depth", F.lit(depth))), "ancestors")
        forget(before)


def roots(edges: DataFrame) -> DataFrame:
    """node, root: the ancestors, at any depth, that have no parent."""
    inner = edges.select(F.col("child").alias("ancestor")).distinct()
    return ancestors(edges).join(inner, "ancestor", "left_anti").select("node", F.col("ancestor").alias("root"))


def top_roots(labelled: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """key, root, n: the roots of each key's nodes, a vote of every row for each of its roots, all that share the most votes. A node without edges is its own root."""
    up = roots(edges).withColumnRenamed("node", "__node")
    votes = labelled.groupBy(key, node).agg(F.count("*").alias("__n")).join(up, F.col(node) == F.col("__node"), "left")
    votes = votes.groupBy(key, F.coalesce("root", node).alias("root")).agg(F.sum("__n").alias("n"))
    best = votes.groupBy(key).agg(F.max("n").alias("n"))
    return votes.join(best, [key, "n"]).select(key, "root", "n")


def match_score(pairs: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """pairs (node, target) with score: 1 - 0.2 * depth at which the target is an ancestor of the node, else 0."""
    up = ancestors(edges, most).withColumnRenamed("ancestor", "target")
    return pairs.join(up, ["node", "target"], "left").select("node", "target", F.coalesce(1 - 0.2 * F.col("depth"), F.lit(0.0)).alias("score"))


def distance(pairs: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """pairs (a, b) with distance: the least depth within which both have a common ancestor, else most + 1."""
    up = ancestors(edges, most)
    left = up.select(F.col("node").alias("a"), "ancestor", F.col("depth").alias("da"))
    right = up.select(F.col("node").alias("b"), "ancestor", F.col("depth").alias("db"))
    met = pairs.join(left, "a").join(right, ["b", "ancestor"]).groupBy("a", "b").agg(F.min(F.greatest("da", "db")).alias("distance"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce("distance", F.lit(most + 1)).alias("distance"))


def expanded(sets: DataFrame, edges: DataFrame, key: str, node: str) -> DataFrame:
    """key, node: the nodes and their parents."""
    up = sets.join(edges, sets[node] == edges["child"]).select(key, F.col("parent").alias(node))
    return sets.select(key, node).unionByName(up).distinct()
