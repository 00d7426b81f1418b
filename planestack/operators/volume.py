"""Volumes as voxel tables (z, y, x, ...): sampling along three axes, filling gaps, voting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planestack.functions import geometry

#: Positions of an axis that one task looks at together.
BUCKET = 4096
#: plane -> (axis it is cut along, axes of the slice)
PLANES = {"xy": ("z", "y", "x"), "xz": ("y", "z", "x"), "yz": ("x", "z", "y")}


def extent(voxels: DataFrame) -> tuple[int, int, int]:
    """Sizes along z, y and x (one row comes back)."""
    r = voxels.agg(*[F.max(c) for c in ("z", "y", "x")]).first()
    return tuple(int(n) + 1 if n is not None else 0 for n in r)


def even_indices(spark, n: int, m: int) -> DataFrame:
    """index: m (at most n) indices spread evenly over 0 .. n-1."""
    m = min(m, n)
    return spark.range(m).select(geometry.even_index(F.col("id"), F.lit(n), F.lit(m)).alias("index")).distinct()


def numbered(rows: DataFrame) -> DataFrame:
    """index, place: distinct indices with their place in order, from 0. Ranges are counted, then numbered each for itself."""
    from pyspark.sql import Window

    from planestack.sources import scratch

    spread = rows.select("index").distinct().repartitionByRange("index").withColumn("part", F.spark_partition_id())
    spread, _ = scratch.materialize(spread, "places")  # ranges are drawn once
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", F.col("n"), F.lit(0).alias("one"))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("one").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = starts.select("part", first.alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("index")) - 1
    return spread.withColumn("at", within).join(starts, "part").select("index", (F.col("at") + F.col("first")).cast("long").alias("place"))


def strided(voxels: DataFrame, step: int, first: int = 0) -> DataFrame:
    """Every step-th slice; the predicate stands on the stored column."""
    return voxels.filter((F.col("z") >= first) & ((F.col("z") - first) % step == 0))


def planes(voxels: DataFrame, indices: dict[str, DataFrame], value: str = "v") -> DataFrame:
    """plane, index, row, col, value of the sampled slices along the three axes."""
    out = None
    for plane, (axis, row, col) in PLANES.items():
        cut = voxels.join(indices[plane], F.col(axis) == F.col("index")).select(F.lit(plane).alias("plane"), "index", F.col(row).alias("row"), F.col(col).alias("col"), value)
        out = cut if out is None else out.unionByName(cut)
    return out


def ortho_planes(voxels: DataFrame, step: int, value: str = "v") -> DataFrame:
    """The xy slices at a stride, and as many xz and yz slices spread evenly."""
    spark, (nz, ny, nx) = voxels.sparkSession, extent(voxels)
    many = len(range(0, nz, step))
    at = {"xy": spark.range(0, nz, step).withColumnRenamed("id", "index"), "xz": even_indices(spark, ny, many), "yz": even_indices(spark, nx, many)}
    return planes(voxels, at, value)


def _carried(at: DataFrame, low: int, high: int) -> DataFrame:
    """at (pos, least, most) with before and after: the largest `most` of smaller positions, the smallest `least` of larger ones.

    Positions from low to high lie in buckets of BUCKET. Windows run within a bucket; what comes from the buckets before and after
    is found in the same way among the buckets, of which there are so many times fewer.
    """
    from pyspark.sql import Window

    rows = at.withColumn("bucket", F.expr(f"(pos - {low}) div {BUCKET}"))
    up = Window.partitionBy("bucket").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("bucket").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"before": F.max("most").over(up), "after": F.min("least").over(down)})
    buckets = (high - low) // BUCKET + 1
    if buckets == 1:
        return rows.drop("bucket")
    edges = at.groupBy(F.expr(f"(pos - {low}) div {BUCKET}").alias("pos")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    edges = _carried(edges, 0, buckets - 1).select(F.col("pos").alias("bucket"), F.col("before").alias("b"), F.col("after").alias("a"))
    return rows.join(edges, "bucket").withColumns({"before": F.coalesce("before", "b"), "after": F.coalesce("after", "a")}).drop("bucket", "a", "b")


def nearest_sampled(n: DataFrame, sampled: DataFrame) -> DataFrame:
    """index, source for each distinct index of n and sampled: the nearest sampled index, the lower one of two equally near.

    An as-of join both ways: the last sampled index below and the first above, carried into buckets of neighbouring positions
    (see _carried), so that no task holds more than a bucket. Without a sampled index the source is null; null indices are left
    out.
    """
    rows = n.select("index", F.lit(None).cast("long").alias("s")).unionByName(sampled.select("index", F.col("index").alias("s")))
    rows = rows.filter("index IS NOT NULL").groupBy(F.col("index").alias("pos")).agg(F.max("s").alias("s"))
    ends = rows.agg(F.min("pos").alias("low"), F.max("pos").alias("high")).first()
    if ends["low"] is None:
        return rows.select(F.col("pos").alias("index"), F.col("s").alias("source"))
    found = _carried(rows.select("pos", F.col("s").alias("least"), F.col("s").alias("most")), ends["low"], ends["high"])
    before, after = F.col("before"), F.col("after")
    near = F.when(F.col("most").isNotNull(), F.col("most")).when(before.isNull(), after).when(after.isNull() | (F.col("pos") - before <= after - F.col("pos")), before).otherwise(after)
    return found.select(F.col("pos").alias("index"), near.alias("source"))


def filled(slices: DataFrame, plane: str, n: int) -> DataFrame:
    """z, y, x of a mask volume: each slice (index, row, col) stands for itself and for the positions nearest to it."""
    spark, (axis, row, col) = slices.sparkSession, PLANES[plane]
    sampled = slices.select("index").distinct()
    source = nearest_sampled(spark.range(n).withColumnRenamed("id", "index"), sampled).withColumnRenamed("index", "at")
    rows = slices.join(source, F.col("index") == F.col("source"))
    return rows.select(F.col("at").alias(axis), F.col("row").alias(row), F.col("col").alias(col)).select("z", "y", "x")


def fitted(slices: DataFrame, plane: str, have: dict[str, int], want: dict[str, int]) -> DataFrame:
    """index, row, col of mask slices brought to the volume's sizes by nearest centres (have, want: sizes of the axes z, y, x).

    Both index maps have a row for each row and column of the wanted slice, and meet the pixels by their source.
    """
    spark, (_, row, col) = slices.sparkSession, PLANES[plane]
    out = slices
    for c, axis in (("row", row), ("col", col)):
        if have[axis] != want[axis]:
            to = spark.range(want[axis]).select(F.col("id").alias("_to"), geometry.nearest_source(F.col("id"), want[axis], have[axis]).alias(c))
            out = out.join(to, c).drop(c).withColumnRenamed("_to", c)
    return out.select("index", "row", "col")


def rebuilt(slices: DataFrame, plane: str, have: dict[str, int], want: dict[str, int]) -> DataFrame:
    """z, y, x of a mask volume from the slices (index, row, col) of one plane: each brought to size, gaps from the nearest slice."""
    return filled(fitted(slices, plane, have, want), plane, want[PLANES[plane][0]])


def thinned(voxels: DataFrame, most: int = 500_000) -> DataFrame:
    """Voxels of slices with more than `most` values at every n-th row and column, n the root of how many times more there are."""
    sizes = voxels.groupBy("z").agg(F.count(F.lit(1)).alias("_size"))
    step = F.when(F.col("_size") > most, F.greatest(F.lit(1), F.sqrt(F.col("_size") / most).cast("int"))).otherwise(1)
    rows = voxels.join(sizes, "z").withColumn("_step", step)
    return rows.filter((F.col("y") % F.col("_step") == 0) & (F.col("x") % F.col("_step") == 0)).drop("_size", "_step")


def majority(masks: list[DataFrame]) -> DataFrame:
    """z, y, x of the voxels in at least max(1, (n + 1) // 2) of the n masks (of two, one is enough)."""
    votes = masks[0].select("z", "y", "x")
    for m in masks[1:]:
        votes = votes.unionByName(m.select("z", "y", "x"))
    return votes.groupBy("z", "y", "x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(1, (len(masks) + 1) // 2)).select("z", "y", "x")


def first_claim(claims: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """The label of the first claim on each key."""
    return claims.groupBy(*keys).agg(F.min_by(label, order).alias(label))


def last_writer(claims: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """The label of the last claim on each key."""
    return claims.groupBy(*keys).agg(F.max_by(label, order).alias(label))


def merged(forward: DataFrame, reverse: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Results of two passes; where both have one, the first wins."""
    f, r = forward.withColumnRenamed(value, "_f"), reverse.withColumnRenamed(value, "_r")
    return f.join(r, keys, "full").select(*keys, F.coalesce("_f", "_r").alias(value))


def confident_union(objects: DataFrame, image: str, score: str, least: float) -> DataFrame:
    """Objects with a score of at least `least`; in images without any, the single best one (first of equals by `ordinal`)."""
    best = objects.groupBy(image).agg(F.max(score).alias("_top"), F.min_by("ordinal", F.struct(-F.col(score), F.col("ordinal"))).alias("_best"))
    joined = objects.join(best, image)
    return joined.filter((F.col(score) >= least) | ((F.col("_top") < least) & (F.col("ordinal") == F.col("_best")))).drop("_top", "_best")
