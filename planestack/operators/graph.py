"""Connected components by contraction: hooks to the smallest neighbour, pointer jumping, then the graph between the roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planestack.sources import scratch


def components(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """node, root of every node in edges (a, b); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour (a minimum per node, combined before the shuffle, so a hub costs one
    row for each task), follows hooks to the roots, and keeps only the edges between different roots. What a round leaves is
    written to the shared folder, and dropped when the next round stands.

    partitions: tasks of each join, if the caller knows how many the edges need; else Spark merges shuffled rows until each core
    has one task, whose memory then grows with the edges.
    """
    spark = edges.sparkSession
    dealt = lambda rows, key: rows.repartition(partitions, key) if partitions else rows
    edges, at = scratch.materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def jumped(hooks: DataFrame) -> DataFrame:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        return dealt(hooks, "root").join(dealt(up, "root"), "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))

    roots, roots_at = None, None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "to")
        first = dealt(both, "node").groupBy("node").agg(F.least("node", F.min("to")).alias("root"))
        hooks, hooks_at = scratch.materialize(jumped(first).select("node", "root"), "hooks")
        while not jumped(hooks).filter("moved").isEmpty():
            twice, twice_at = scratch.materialize(jumped(jumped(hooks).select("node", "root")).select("node", "root"), "hooks")
            scratch.drop(spark, hooks_at)
            hooks, hooks_at = twice, twice_at
        if roots is None:
            roots, roots_at = hooks, hooks_at
        else:
            step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged, merged_at = scratch.materialize(dealt(roots, "root").join(dealt(step, "root"), "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            scratch.drop(spark, roots_at)
            roots, roots_at = merged, merged_at
        end = lambda c: hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))  # noqa: B023, E731
        ended = dealt(edges, "a").join(dealt(end("a"), "a"), "a")
        left = dealt(ended, "b").join(dealt(end("b"), "b"), "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        if left.isEmpty():
            break
        kept, kept_at = scratch.materialize(left, "edges")
        scratch.drop(spark, at)
        edges, at = kept, kept_at
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
