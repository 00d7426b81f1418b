"""Masks carried from frame to frame by a tracking model, both ways through a volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planestack import models
from planestack.sources import scratch

#: Frames that a task goes through before it hands its mask over.
SPAN = 256


def _reached(rows: DataFrame, ascending: bool, span: int) -> DataFrame:
    """rows (vol, frame, tile, mask) that a pass can reach, with the frame of the seed that it starts from and their range from there.

    The nearest seed is looked up within blocks of `span` frames; only one row of each block meets the others of its volume.
    """
    sign = 1 if ascending else -1
    at = F.col("frame") * sign
    blocks = rows.withColumn("_b", F.floor(F.col("frame") / span)).withColumn("_s", F.when(F.col("mask").isNotNull(), at))
    before = Window.partitionBy("vol").orderBy(F.col("_b") * sign).rowsBetween(Window.unboundedPreceding, -1)
    last = blocks.groupBy("vol", "_b").agg(F.max("_s").alias("_e")).withColumn("_e", F.max("_e").over(before))
    within = Window.partitionBy("vol", "_b").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    found = blocks.withColumn("_s", F.max("_s").over(within)).join(last, ["vol", "_b"]).withColumn("seed", F.coalesce("_s", "_e"))
    return found.filter("seed IS NOT NULL").select("vol", "frame", "tile", "mask", "seed", F.floor((at - F.col("seed")) / span).alias("part"))


def _pass(frames: DataFrame, tracker: str, ascending: bool) -> tuple[DataFrame, list[str]]:
    """vol, frame, mask of one pass over frames (vol, frame, tile, mask of the seed or null, seed, part)."""
    factory = models.create_tracker(tracker)

    def carried(key, left, mask):
        import pyarrow as pa

        track, found = factory(), []
        if left.num_rows:
            left = left.sort_by([("frame", "ascending" if ascending else "descending")])
            for frame, tile, seed in zip(left.column("frame").to_pylist(), left.column("tile").to_pylist(), left.column("mask").to_pylist(), strict=True):
                mask = seed if seed is not None else track(mask, tile) if mask is not None else None
                if mask is None:
                    break
                found.append((frame, mask))
        found.append((None, mask))  # handed over, also through a range without frames
        n = len(found)
        return pa.table({"vol": pa.array([key[0]] * n, pa.int64()), "seed": pa.array([key[1]] * n, pa.int64()), "frame": pa.array([f for f, _ in found], pa.int64()), "mask": pa.array([m for _, m in found], pa.binary())})

    def begin(key, left):
        return carried([k.as_py() for k in key], left, None)

    def go_on(key, left, right):
        return carried([k.as_py() for k in key], left, right.column("mask")[0].as_py() if right.num_rows else None)

    kind, by = "vol long, seed long, frame long, mask binary", ["vol", "seed"]
    out, paths, state, ends = None, [], None, None
    last = frames.agg(F.max("part")).first()[0] or 0
    for part in range(last + 1):
        own = frames.filter(F.col("part") == part).select("vol", "frame", "tile", "mask", "seed")
        done = own.groupBy(*by).applyInArrow(begin, kind) if state is None else own.groupBy(*by).cogroup(state.groupBy(*by)).applyInArrow(go_on, kind)
        done, path = scratch.materialize(done, "frames")
        paths.append(path)
        found = done.filter("frame IS NOT NULL").select("vol", "frame", "mask")
        out = found if out is None else out.unionByName(found)
        if part == last:
            break
        if ends is None:  # groups that are over aren't carried along
            ends, path = scratch.materialize(frames.groupBy(*by).agg(F.max("part").alias("end")).filter("end > 0"), "ends")
            paths.append(path)
        state = done.filter("frame IS NULL AND mask IS NOT NULL").select(*by, "mask").join(ends.filter(F.col("end") > part), by, "left_semi")
    return out, paths


def propagated(frames: DataFrame, seeds: DataFrame, tracker: str, span: int = SPAN) -> DataFrame:
    """vol, frame, mask: seeds (vol, frame, mask) carried through frames (vol, frame, tile), forward and back.

    A frame with a seed has the seed; another has what the model makes of its neighbour's mask, until it finds nothing. Where both
    passes have a mask the forward one counts. A seed starts anew whatever came before it, so the frames from one seed to the next
    are a group of their own, and all groups go at once. Within a group frames are gone through in ranges of `span`: a round takes
    the same range of all groups, each in a task that gets the mask of the range before and hands on its last one. So a task holds
    one range of one group, and rounds are as many as the longest stretch without a seed has ranges. Of several seeds or tiles of a
    frame the smallest seed and any tile count; rows with a null volume or frame are left out, and seeds of frames that aren't
    there have no effect.
    """
    spark = frames.sparkSession
    one = seeds.groupBy("vol", "frame").agg(F.min("mask").alias("mask"))
    rows = frames.filter("vol IS NOT NULL AND frame IS NOT NULL").groupBy(F.col("vol").cast("long").alias("vol"), F.col("frame").cast("long").alias("frame")).agg(F.first("tile").alias("tile"))
    rows, path = scratch.materialize(rows.join(one, ["vol", "frame"], "left"), "frames")
    passes, paths = [], [path]
    for ascending in (True, False):
        own, at = scratch.materialize(_reached(rows, ascending, span), "frames")
        found, more = _pass(own, tracker, ascending)
        passes.append(found)
        paths += [at, *more]
    merged = passes[0].withColumnRenamed("mask", "_f").join(passes[1].withColumnRenamed("mask", "_b"), ["vol", "frame"], "full")
    out, _ = scratch.materialize(merged.select("vol", "frame", F.coalesce("_f", "_b").alias("mask")), "propagated")
    for p in paths:
        scratch.drop(spark, p)
    return out


def pixels_of(masks: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """keys, y, x of the foreground of masks (bytes of 0 and more, row by row)."""
    keys = keys or ["vol", "frame"]
    kinds = ", ".join(f"{k} {masks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = [np.flatnonzero(np.frombuffer(m or b"", np.uint8)) for m in batch.column("mask").to_pylist()]
            of = np.repeat(np.arange(batch.num_rows), [len(a) for a in at])
            flat = np.concatenate(at) if at else np.empty(0, np.int64)
            own = batch.select(keys).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(flat // width), pa.array(flat % width)], [*keys, "y", "x"])

    return masks.mapInArrow(run, f"{kinds}, y long, x long")
