"""Two-dimensional windows of crops, read from the chunks that they touch: raw values, and labels on the raw window's grid.

A window's box becomes rows of chunk numbers. Each chunk is opened by one task for all windows that want it, and cut; windows of
many stores go through one job.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planestack.functions import pixels
from planestack.sources import zarr

#: Side of a window in a crop that isn't small.
SIZE = 1024


def _clamped(v: Column, most: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.rint(v).cast("long"), most))


def boxed(windows: DataFrame, store: str, size: int = SIZE) -> DataFrame:
    """windows with z, y0, y1, x0, x1: the voxels of a store (struct path, scale, resolution, offset, shape, array) that they mean.

    windows: window, z_index, small, origin, extent (of the crop, in nm), raw_resolution, and at_y, at_x (in nm, where small isn't
    true). A small crop's window is its whole extent; another one has `size` raw voxels a side, moved to lie within the data.
    """
    s = lambda f, i: F.col(f"{store}.{f}")[i]
    world_z = F.col("origin")[0] + F.col("z_index") * F.col("raw_resolution")[0]
    out = {"z": _clamped((world_z - s("offset", 0)) / s("resolution", 0), s("shape", 0) - 1)}
    for axis, i in (("y", 1), ("x", 2)):
        step, n = s("resolution", i), s("shape", i)
        wide = F.rint(F.lit(size) * F.col("raw_resolution")[i] / step).cast("long")
        whole = F.rint(F.col("extent")[i] / step).cast("long")
        begin = F.when(F.col("small"), _clamped((F.col("origin")[i] - s("offset", i)) / step, n - 1)).otherwise(_clamped((F.col(f"at_{axis}") - s("offset", i)) / step, n - wide))
        out[f"{axis}0"] = begin
        out[f"{axis}1"] = F.least(begin + F.when(F.col("small"), whole).otherwise(wide), n)
    return windows.withColumns(out)


def read(boxes: DataFrame, store: str, keys: list[str]) -> DataFrame:
    """keys, y, x (from the box's corner), v of boxes (keys, z, y0, y1, x0, x1 and the store's struct)."""
    chunks = F.from_json(f"{store}.array", "chunks array<bigint>")["chunks"]
    rows = boxes.filter("y1 > y0 AND x1 > x0").withColumn("_c", chunks)
    div = lambda a, i: F.floor(F.col(a) / F.col("_c")[i]).cast("long")
    each = lambda c, i: F.explode(F.sequence(div(f"{c}0", i), F.floor((F.col(f"{c}1") - 1) / F.col("_c")[i]).cast("long")))
    rows = rows.select(*keys, "z", "y0", "y1", "x0", "x1", F.col(f"{store}.path").alias("_path"), F.col(f"{store}.scale").alias("_scale"), F.col(f"{store}.array").alias("_array"), div("z", 0).alias("_cz"), each("y", 1).alias("_cy"), "_c")
    rows = rows.select("*", each("x", 2).alias("_cx")).drop("_c")
    place = ["_path", "_scale", "_cz", "_cy", "_cx"]
    kinds = ", ".join(f"`{k}` {boxes.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator) -> Iterator:
        import json

        import numpy as np
        import pyarrow as pa

        held, block, described = None, None, {}
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in (*place, "_array", "z", "y0", "y1", "x0", "x1")}
            for k in range(batch.num_rows):
                at = tuple(cols[c][k] for c in place)
                if cols["_array"][k] not in described:
                    described[cols["_array"][k]] = zarr.described(json.loads(cols["_array"][k]), None, "")
                meta = described[cols["_array"][k]]
                if at != held:
                    zarr.readable(meta)
                    store, folder = zarr._store(at[0])
                    held, block = at, zarr.chunk(store, f"{folder}/{at[1]}", meta, at[2:])
                _, cy, cx = meta["chunks"]
                y0, y1 = max(cols["y0"][k], at[3] * cy), min(cols["y1"][k], (at[3] + 1) * cy)
                x0, x1 = max(cols["x0"][k], at[4] * cx), min(cols["x1"][k], (at[4] + 1) * cx)
                cut = block[cols["z"][k] - at[2] * meta["chunks"][0], y0 - at[3] * cy : y1 - at[3] * cy, x0 - at[4] * cx : x1 - at[4] * cx]
                y, x = np.mgrid[y0 - cols["y0"][k] : y1 - cols["y0"][k], x0 - cols["x0"][k] : x1 - cols["x0"][k]]
                own = batch.select(keys).take(pa.array(np.full(cut.size, k)))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(y.ravel(), pa.int64()), pa.array(x.ravel(), pa.int64()), pa.array(cut.ravel().astype(float))], [*keys, "y", "x", "v"])

    return rows.repartition(*place).sortWithinPartitions(*place).mapInArrow(run, f"{kinds}, y long, x long, v double")


def raw(windows: DataFrame, size: int = SIZE) -> DataFrame:
    """window, y, x, v of raw windows (as for boxed(), with a struct `raw`)."""
    return read(boxed(windows, "raw", size), "raw", ["window"])


def _zoomed(i: Column, out: Column, into: Column) -> Column:
    """Source of output index i for an order-0 zoom of `into` cells to `out`, end points to end points."""
    return F.when(out <= 1, F.lit(0)).otherwise(F.floor(i * ((into - 1) / (out - 1)) + 0.5)).cast("long")


def labels(windows: DataFrame, size: int = SIZE) -> DataFrame:
    """window, y, x of the raw windows' pixels that any of their classes covers (windows as for raw(), with an array `classes`).

    Each class is read on its own grid; foreground is neither 0 nor 255. It meets the raw window's rows and columns by the zoom's
    index map, a row for each row and column of the window. A window without foreground has no rows.
    """
    box = boxed(windows, "raw", size).select("window", (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"))
    each = windows.select("*", F.posexplode("classes").alias("k", "label"))
    boxes = boxed(each, "label", size)
    found = read(boxes, "label", ["window", "k"]).filter(pixels.valid_label(F.col("v"))).select("window", "k", F.col("y").alias("sy"), F.col("x").alias("sx"))
    sizes = boxes.select("window", "k", (F.col("y1") - F.col("y0")).alias("lh"), (F.col("x1") - F.col("x0")).alias("lw")).join(box, "window").filter("h > 0 AND w > 0 AND lh > 0 AND lw > 0")
    along = lambda c, n, m: sizes.select("window", "k", n, m, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(c)).select("window", "k", c, _zoomed(F.col(c), F.col(n), F.col(m)).alias(f"s{c}"))
    rows = found.join(along("y", "h", "lh"), ["window", "k", "sy"]).join(along("x", "w", "lw"), ["window", "k", "sx"])
    return rows.select("window", "y", "x").distinct()
