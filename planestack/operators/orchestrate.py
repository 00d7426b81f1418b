"""Whole runs over a volume: slices to masks along one axis or three, filled, voted and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planestack import models
from planestack.functions import replies
from planestack.operators import propagate, refine, volume


def zstack(voxels: DataFrame, step: int, generator: str) -> DataFrame:
    """z, y, x of the mask of every step-th slice along z (slices between them stay empty)."""
    slices = volume.strided(voxels, step).select(F.col("z").alias("index"), F.col("y").alias("row"), F.col("x").alias("col"), "v")
    return models.segment(slices, generator, ["index"]).select(F.col("index").alias("z"), F.col("row").alias("y"), F.col("col").alias("x"))


def ortho(voxels: DataFrame, step: int, generator: str) -> DataFrame:
    """z, y, x by majority of three planes: each is sampled, segmented, and filled up from the nearest sampled slice."""
    sizes = dict(zip("zyx", volume.extent(voxels), strict=True))
    found = models.segment(volume.ortho_planes(voxels, step), generator, ["plane", "index"])
    filled = []
    for plane, (axis, row, col) in volume.PLANES.items():
        spark, n = voxels.sparkSession, sizes[axis]
        many = len(range(0, sizes["z"], step))
        sampled = spark.range(0, n, step).withColumnRenamed("id", "index") if plane == "xy" else volume.even_indices(spark, n, many)
        source = volume.nearest_sampled(spark.range(n).withColumnRenamed("id", "index"), sampled).withColumnRenamed("index", "at")
        own = found.filter(F.col("plane") == plane).join(source, F.col("index") == F.col("source"))
        filled.append(own.select(F.col("at").alias(axis), F.col("row").alias(row), F.col("col").alias(col)).select("z", "y", "x"))
    return volume.majority(filled)


def detected_points(slices: DataFrame, chat: str, width: int, height: int) -> DataFrame:
    """index, x, y that a chat model points at in each slice (index, prompt); slices without a point are left out."""
    asked = models.ask(slices.select("index", "prompt"), chat)
    return asked.select("index", F.explode(replies.coordinates(F.col("reply"), F.lit(width), F.lit(height))).alias("p")).select("index", "p.x", "p.y")


def points_per_slice(slices: DataFrame, chat: str, width: int, height: int, sample: int | None = None) -> DataFrame:
    """index, points of each slice (index, prompt): a model is asked about `sample` slices spread evenly (all, if None).

    Slices are told by their place in the order of their indices. One that isn't asked about, or that nothing is found in, has an
    empty list; every point is foreground and an instance of its own.
    """
    n = slices.count()
    asked = slices
    if sample and sample < n:
        spark = slices.sparkSession
        placed = volume.numbered(slices.select("index"))
        asked = slices.join(placed.join(volume.even_indices(spark, n, sample).withColumnRenamed("index", "place"), "place", "left_semi").select("index"), "index", "left_semi")
    found = models.ask(asked.select("index", "prompt"), chat)
    point = lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(1).alias("label"), i.cast("int").alias("instance"))
    found = found.select("index", F.transform(replies.coordinates(F.col("reply"), F.lit(width), F.lit(height)), point).alias("points"))
    none = F.array().cast("array<struct<x:int,y:int,label:int,instance:int>>")
    return slices.select("index").join(found, "index", "left").select("index", F.coalesce("points", none).alias("points"))


def stack(frames: DataFrame, mode: str, painter: str = "", judge: str = "", tracker: str = "", seeds: DataFrame | None = None, points: DataFrame | None = None, **settings) -> DataFrame:
    """The masks of a stack's slices by one of three modes, with mask (bytes).

    video: frames (vol, frame, tile) and seeds (vol, frame, mask) through a tracking model, both ways.
    slices: each slice (frame, ...) refined by itself; its best image is the mask. Slices whose images all failed have none.
    points: as slices, with a slice's own points (frame, points) where some were found for it.
    """
    if mode == "video":
        return propagate.propagated(frames, seeds, tracker, **settings)
    if mode not in ("slices", "points"):
        raise ValueError(f"no mode {mode}")
    slices = frames.withColumnRenamed("frame", "run")
    if mode == "points":
        slices = slices.join(points.select(F.col("frame").alias("run"), "points"), "run", "left")
    return refine.refine(slices, painter, judge, **settings).best().select(F.col("run").alias("frame"), F.col("image").alias("mask"), "score")
