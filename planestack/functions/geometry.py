"""Regions, grids and coordinate maps as Column expressions and plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_roi(text: Column) -> Column:
    """struct(offset, shape) of `[b:e,b:e,b:e]` (brackets optional); an error for anything but three whole-number ranges."""
    body = F.regexp_replace(F.trim(text), r"^\[|\]$", "")
    shaped = body.rlike(r"^\s*-?\d+\s*:\s*-?\d+\s*(,\s*-?\d+\s*:\s*-?\d+\s*){2}$")
    axes = F.transform(F.split(body, ","), lambda a: F.transform(F.split(a, ":"), lambda n: F.trim(n).cast("long")))
    axes = F.when(shaped, axes).otherwise(F.raise_error(F.concat(F.lit("not a region: "), text)).cast("array<array<bigint>>"))
    return F.struct(F.transform(axes, lambda a: a[0]).alias("offset"), F.transform(axes, lambda a: a[1] - a[0]).alias("shape"))


def snapped(begin: Column, end: Column, step: Column, origin: Column, extent: Column) -> Column:
    """struct(first, last): the voxels that a range of world units touches, grown to whole voxels and cut to the data."""
    first = F.floor((begin - origin) / step)
    last = F.ceil((end - origin) / step)
    return F.struct(F.greatest(first, F.lit(0)).cast("long").alias("first"), F.least(last, extent).cast("long").alias("last"))


def stride(step_nm: float, voxel_nm: int) -> int:
    """Slices to go on by, for a distance in nm."""
    return max(1, round(step_nm / int(voxel_nm)))


def even_index(k: Column, n: Column, m: Column) -> Column:
    """k-th of m indices spread evenly over 0 .. n-1, truncated; the last one is n - 1."""
    inner = F.floor(k * ((n - 1) / F.greatest(m - 1, F.lit(1)))).cast("long")
    return F.when(m == 1, F.lit(0)).when(k == m - 1, n - 1).otherwise(inner).cast("long")


def voxel_of(world: Column, origin: Column, step: Column, extent: Column) -> Column:
    """Index of the voxel nearest a world coordinate (ties to even), kept within the data."""
    return F.least(F.greatest(F.rint((world - origin) / step), F.lit(0.0)), extent - 1.0).cast("long")


def padded_square(w: Column, h: Column) -> Column:
    """struct(size, left, top): the square that holds a centred image."""
    size = F.greatest(w, h)
    return F.struct(size.alias("size"), F.floor((size - w) / 2).alias("left"), F.floor((size - h) / 2).alias("top"))


def unpadded_box(w: Column, h: Column, target: int) -> Column:
    """struct(left, top, right, bottom): where the centred image lies in its padded square after that is resized to target, ties to even."""
    s = padded_square(w, h)
    scale = F.lit(float(target)) / s["size"]
    at = lambda v: F.rint(v * scale).cast("long")
    return F.struct(at(s["left"]).alias("left"), at(s["top"]).alias("top"), at(s["left"] + w).alias("right"), at(s["top"] + h).alias("bottom"))


def unpadded(pixels: DataFrame, w: int, h: int, target: int) -> DataFrame:
    """Pixels (y, x, ...) of a square image of `target` a side that show the image, moved to its corner."""
    size, left, top = max(w, h), (max(w, h) - w) // 2, (max(w, h) - h) // 2
    begin_y, end_y, begin_x, end_x = (round(v * (target / size)) for v in (top, top + h, left, left + w))
    cut = box(pixels, y=(begin_y, end_y), x=(begin_x, end_x))
    return cut.withColumns({"y": F.col("y") - begin_y, "x": F.col("x") - begin_x})


def nearest_source(i: Column, out: int, into: int) -> Column:
    """Source index of output index i when `into` pixels are resized to `out` by nearest centre."""
    return F.floor((i + 0.5) * (into / out)).cast("long")


def zoom_source(i: Column, out: int, into: int) -> Column:
    """Source index of output index i for an order-0 zoom, which maps end points to end points."""
    if out == 1:
        return F.lit(0).cast("long")
    return F.floor(i * ((into - 1) / (out - 1)) + 0.5).cast("long")


def turned(y: Column, x: Column, side: int, quarter_turns: int) -> tuple[Column, Column]:
    """Where a pixel of a square tile goes under counter-clockwise quarter turns."""
    for _ in range(quarter_turns % 4):
        y, x = side - 1 - x, y
    return y, x


def fitted(w: Column, h: Column, most: int = 1008, unit: int = 28) -> Column:
    """struct(w, h): shrunk so that the longer side is at most `most`, each side cut to a multiple of unit (one at least)."""
    scale = F.least(F.lit(1.0), most / F.greatest(w, h))
    cut = lambda s: F.greatest(F.floor((s * scale).cast("long") / unit) * unit, F.lit(unit))
    return F.struct(cut(w).cast("long").alias("w"), cut(h).cast("long").alias("h"))


def generated_size(w: Column, h: Column, longer: int = 1024, unit: int = 32) -> Column:
    """struct(w, h): the longer side becomes `longer`, the other the nearest multiple of unit (one at least)."""
    other = lambda a, b: F.greatest(F.rint(longer * a / b / unit) * unit, F.lit(float(unit))).cast("long")
    wide = w >= h
    return F.struct(F.when(wide, F.lit(longer)).otherwise(other(w, h)).cast("long").alias("w"), F.when(wide, other(h, w)).otherwise(F.lit(longer)).cast("long").alias("h"))


def box(df: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Rows with begin <= column < end for each named column; the comparisons reach the scan."""
    for name, (begin, end) in ranges.items():
        df = df.filter((F.col(name) >= begin) & (F.col(name) < end))
    return df
