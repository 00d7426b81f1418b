"""Masks: components, morphology, sizes, labels. Sparse masks are tables of their foreground pixels (img_id, y, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planestack import dims
from planestack.functions import pixels
from planestack.operators import tiles
from planestack.sources import images


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets of a disk footprint: 13 for radius 2, 29 for radius 3."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def dilate(mask: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Pixels within the footprint of a foreground pixel, inside the image."""
    return tiles.morphed(mask, [("dilate", radius)], height, width)


def erode(mask: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Pixels whose whole footprint, as far as it lies in the image, is foreground."""
    return tiles.morphed(mask, [("erode", radius)], height, width)


def opening(mask: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    return tiles.morphed(mask, tiles.opened(radius), height, width)


def closing(mask: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    return tiles.morphed(mask, tiles.closed(radius), height, width)


def smooth(mask: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """Opened, then closed, in one pass."""
    return tiles.morphed(mask, tiles.smoothed(radius), height, width)


def components(mask: DataFrame, eight: bool = True, width: int = 1 << 20) -> DataFrame:
    """img_id, y, x, first: pixels with the raster index (y * width + x) of their component's first pixel.

    An image is labelled by numpy within one task, many small ones at once. Volumes of larger planes are cut into tiles, whose
    components are then joined by tiled_components.
    """

    def label(img, y, x):
        import numpy as np
        import pyarrow as pa

        at = y * width + x
        _, of = np.unique(img, return_inverse=True)
        low = int(at.min())
        apart = of * (int(at.max()) - low + width + 2) + at - low  # images follow each other, too far apart to touch
        order = np.argsort(apart, kind="stable")
        apart, at, img, y, x = apart[order], at[order], img[order], y[order], x[order]
        root = np.arange(len(at))
        steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
        ends = []
        for dy, dx in steps:
            to = np.searchsorted(apart, apart + dy * width + dx)
            ok = (to < len(at)) & (x + dx >= 0) & (x + dx < width)
            ok[ok] = apart[to[ok]] == apart[ok] + dy * width + dx
            ends.append((np.flatnonzero(ok), to[ok]))
        a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            root = root[root]
            if (root == before).all():
                break
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (img, y, x, at[root])], ["img_id", "y", "x", "first"])

    def run(batches):
        for img, y, x in images.whole(batches, ["img_id", "y", "x"]):
            yield label(img, y, x)

    return images.by_image(mask, ["y", "x"]).mapInArrow(run, "img_id long, y long, x long, first long")


def tiled_components(mask: DataFrame, tile: int, width: int, eight: bool = True, height: int | None = None) -> DataFrame:
    """As components(), for images of any size: tiles are labelled apart, then joined where they touch.

    Without a height the lowest pixel of all masks ends the images (one number comes back).
    """
    if height is None:
        height = (mask.agg(F.max("y")).first()[0] or 0) + 1
    return tiles.labelled(mask, [], height, width, eight, tile=tile)


large_enough, relabelled = tiles.large_enough, tiles.relabelled


def areas(labelled: DataFrame) -> DataFrame:
    """img_id, first, area, cy, cx: size and truncated centroid of each component."""
    return labelled.groupBy("img_id", "first").agg(F.count(F.lit(1)).alias("area"), F.avg("y").cast("long").alias("cy"), F.avg("x").cast("long").alias("cx"))


def instance_mask(mask: DataFrame, height: int, width: int, least: int = 50, radius: int = 2) -> DataFrame:
    """Foreground, opened and closed, split into components, small ones dropped, numbered."""
    return tiles.instances(mask, tiles.smoothed(radius), height, width, least)


def direct_mask(mask: DataFrame, height: int, width: int, least: int = 50, radius: int = 2) -> DataFrame:
    """Foreground, opened and closed, without small components."""
    return tiles.instances(mask, tiles.smoothed(radius), height, width, least).select("img_id", "y", "x")


def inverted(mask: DataFrame, images: DataFrame, height: int, width: int) -> DataFrame:
    """The background of each image in `images` (img_id)."""
    return tiles.morphed(mask.join(images.select("img_id").distinct(), "img_id", "left_semi"), [("invert", 0)], height, width, images)


def invert_mask(edges: DataFrame, images: DataFrame, height: int, width: int, least: int = 50) -> DataFrame:
    """Instances as the parts of the background that edges leave: smooth, invert, open and close with a larger disk, number."""
    own = edges.join(images.select("img_id").distinct(), "img_id", "left_semi")
    return tiles.instances(own, [*tiles.smoothed(2), ("invert", 0), *tiles.smoothed(3)], height, width, least, images=images)


def instance_overlay(image: DataFrame, labelled: DataFrame, alpha: float = 0.5) -> DataFrame:
    """img_id, y, x, r, g, b of an image with its instances (img_id, y, x, label) blended in, in the palette's colours by their rank.

    Ranks are over the distinct labels of an image; the palette is twelve rows.
    """
    ranks = labelled.select("img_id", "label").distinct().withColumn("slot", (F.dense_rank().over(Window.partitionBy("img_id").orderBy("label")) - 1) % len(dims.INSTANCE_COLORS))
    coloured = labelled.join(ranks, ["img_id", "label"]).join(F.broadcast(dims.palette(image.sparkSession)), "slot")
    rows = image.join(coloured.select("img_id", "y", "x", "pr", "pg", "pb"), ["img_id", "y", "x"], "left")
    return rows.select("img_id", "y", "x", *[F.when(F.col(f"p{c}").isNotNull(), pixels.blended(F.col(c), F.col(f"p{c}"), alpha)).otherwise(F.col(c)).alias(c) for c in "rgb"])


def foreground(image: DataFrame, mode: str, above: float = 30) -> DataFrame:
    """img_id, y, x that a mode starts from, of coloured pixels (img_id, y, x, r, g, b): saturated ones for instances, else bright ones."""
    value = pixels.saturation([F.col(c) for c in "rgb"]) if mode == "instance" else pixels.luma(F.col("r"), F.col("g"), F.col("b"))
    return image.filter(value > above).select("img_id", "y", "x")


def mode_of(instance: bool, mask_mode: str) -> str:
    """The way a coloured image becomes a mask: inverted edges, else direct, else instances, else the colour's score."""
    if mask_mode in ("invert", "direct"):
        return mask_mode
    return "instance" if instance else "semantic"


def extracted(image: DataFrame, instance: bool, mask_mode: str, target: tuple[int, int, int], height: int, width: int, above: float = 30, least: int = 50) -> DataFrame:
    """img_id, y, x, label of coloured images by their mode; the bound is on saturation or brightness, and a semantic mask has none.

    label: the instance's number, 255 for a direct mask, and for a semantic one the colour's score where it isn't 0.
    """
    mode = mode_of(instance, mask_mode)
    if mode == "semantic":
        score = pixels.target_score([F.col(c) for c in "rgb"], target).cast("long")
        return image.select("img_id", "y", "x", score.alias("label")).filter("label > 0")
    found = foreground(image, mode, above)
    if mode == "invert":
        return invert_mask(found, image.select("img_id").distinct(), height, width, least)
    if mode == "direct":
        return direct_mask(found, height, width, least).withColumn("label", F.lit(255).cast("long"))
    return instance_mask(found, height, width, least)


def markers(scored: DataFrame, above: float, width: int, least: int = 5, most: int = 2000) -> DataFrame:
    """img_id, y, x: truncated centroids of 4-connected regions of the score over a bound, of plausible size."""
    found = areas(components(scored.filter(F.col("score") > above).select("img_id", "y", "x"), False, width))
    return found.filter(F.col("area").between(least, most)).select("img_id", F.col("cy").alias("y"), F.col("cx").alias("x"), "area")


def union_of(objects: DataFrame, value: str, above: float) -> DataFrame:
    """img_id, y, x, value, any: the largest value of all objects at a pixel, and whether any of them is over the bound."""
    return objects.groupBy("img_id", "y", "x").agg(F.max(value).alias("value"), F.bool_or(F.col(value) > above).alias("any"))


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """img_id, dice of two masks: 2 TP / (2 TP + FP + FN)."""
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), ["img_id", "y", "x"], "full")
    n = both.groupBy("img_id").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("tp"), F.count(F.lit(1)).alias("any"))
    return n.select("img_id", (2 * F.col("tp") / (F.col("tp") + F.col("any"))).alias("dice"))
