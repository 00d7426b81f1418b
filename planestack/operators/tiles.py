"""Dense tiles: morphology and components on packed arrays, cut from tables of foreground pixels (img_id, y, x).

Pixels are dealt out to the tiles that need them, those near an edge to the neighbours as well: a tile has a halo as wide as all
steps together reach, so it comes out exactly as the whole image would. A partition takes its tiles one stack after the other,
and a stack goes through every step as one array, so small images cost no call each. What lies outside an image neither holds
back an erosion nor feeds a dilation.

Components are labelled within tiles. If an image has more than one, those that touch across an edge are links of a graph, whose
roots name the whole. A tile is the most that a task holds of an image; an image that is one tile is finished in the same pass.

Defined results: pixels outside the image are left out, repeated ones count once, and rows with a null are left out. Images
without foreground have no rows, unless `images` lists them and a step inverts them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planestack.operators import graph
from planestack.sources import scratch

#: Side of a tile, cells of a stack, and pixels that a task joins at once.
TILE, STACK, PIXELS = 1024, 1 << 23, 1 << 18
Steps = list[tuple[str, int]]


def opened(radius: int) -> Steps:
    return [("erode", radius), ("dilate", radius)]


def closed(radius: int) -> Steps:
    return [("dilate", radius), ("erode", radius)]


def smoothed(radius: int) -> Steps:
    """Opening, then closing."""
    return [*opened(radius), *closed(radius)]


def _dilated(cells, radius: int):
    """Cells within a disk of a set one, for a stack (k, h, w): running maxima along the rows, the rows then put together."""
    import numpy as np

    wide, widths = [cells], []
    for n in range(1, radius + 1):
        grown = wide[-1].copy()
        grown[:, :, n:] |= cells[:, :, :-n]
        grown[:, :, :-n] |= cells[:, :, n:]
        wide.append(grown)
    for dy in range(radius + 1):
        widths.append(max(n for n in range(radius + 1) if n * n + dy * dy <= radius * radius))
    out = wide[widths[0]].copy()
    for dy in range(1, radius + 1):
        row = wide[widths[dy]]
        out[:, dy:] |= row[:, :-dy]
        out[:, :-dy] |= row[:, dy:]
    return np.ascontiguousarray(out)


def _stepped(cells, inside, steps: Steps):
    for op, radius in steps:
        if op == "invert":
            cells = ~cells & inside
        elif op == "dilate":
            cells = _dilated(cells, radius) & inside
        else:
            cells = ~_dilated(~cells & inside, radius) & inside
    return cells


def _labels(cells, eight: bool):
    """g, y, x and root of each set cell of a stack; root is the place in this list of its component's first cell."""
    import numpy as np

    g, y, x = np.nonzero(cells)
    place = np.full(cells.shape, -1, np.int64)
    place[g, y, x] = np.arange(len(g))
    ends = []
    for dy, dx in [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]:
        a = place[:, : cells.shape[1] - dy, max(0, -dx) : cells.shape[2] - max(0, dx)]
        b = place[:, dy:, max(0, dx) : cells.shape[2] - max(0, -dx)]
        both = (a >= 0) & (b >= 0)
        ends.append((a[both], b[both]))
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    root = np.arange(len(g))
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
        left = root[a] != root[b]
        a, b = a[left], b[left]
    while not (root[root] == root).all():
        root = root[root]
    return g, y, x, root


def _run(mask: DataFrame, steps: Steps, height: int, width: int, images: DataFrame | None, tile: int, finish, schema: str) -> DataFrame:
    """finish(cells of the tiles' own area, image of each tile, its first row and column) as Arrow columns, a stack at a time."""
    halo = sum(r for _, r in steps)
    th, tw = min(tile, max(1, height)), min(tile, max(1, width))
    ny, nx = -(-height // th), -(-width // tw)
    pixels = mask.select(F.col("img_id").cast("long"), F.col("y").cast("long"), F.col("x").cast("long")).filter(f"img_id IS NOT NULL AND y BETWEEN 0 AND {height - 1} AND x BETWEEN 0 AND {width - 1}")
    # each pixel goes to the tiles whose halo reaches it
    spread = lambda c, size, n: F.explode(F.sequence(F.greatest(F.lit(0), F.expr(f"({c} - {halo}) div {size}")), F.least(F.lit(n - 1), F.expr(f"({c} + {halo}) div {size}"))).cast("array<int>")) if n > 1 else F.lit(0)
    dealt = pixels.withColumn("ty", spread("y", th, ny)).withColumn("tx", spread("x", tw, nx))
    if images is not None:
        none = F.lit(-1).cast("long")
        every = images.select(F.col("img_id").cast("long")).filter("img_id IS NOT NULL").select("img_id", none.alias("y"), none.alias("x"), F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("ty"))
        dealt = dealt.unionByName(every.select("*", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("tx")))
    keys = ["img_id", "ty", "tx"]
    sorted_rows = dealt.select(*keys, "y", "x").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        h, w = th + 2 * halo, tw + 2 * halo
        most = max(1, STACK // (h * w))

        def done(rows):
            """The tiles of whole groups of rows."""
            img, ty, tx, y, x = rows
            new = np.concatenate([[True], (img[1:] != img[:-1]) | (ty[1:] != ty[:-1]) | (tx[1:] != tx[:-1])])
            starts = np.append(np.flatnonzero(new), len(img))
            for at in range(0, len(starts) - 1, most):
                cut = starts[at : at + most + 1]
                first, a, b = cut[:-1], cut[0], cut[-1]
                of = np.repeat(np.arange(len(first)), np.diff(cut))
                top, left = ty[first].astype(np.int64) * th - halo, tx[first].astype(np.int64) * tw - halo
                cells = np.zeros((len(first), h, w), bool)
                there = y[a:b] >= 0
                cells[of[there], (y[a:b] - top[of])[there], (x[a:b] - left[of])[there]] = True
                rows_in = (top[:, None] + np.arange(h) >= 0) & (top[:, None] + np.arange(h) < height)
                cols_in = (left[:, None] + np.arange(w) >= 0) & (left[:, None] + np.arange(w) < width)
                cells = _stepped(cells, rows_in[:, :, None] & cols_in[:, None, :], steps)
                out = finish(cells[:, halo : halo + th, halo : halo + tw], img[first], top + halo, left + halo)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], [f.split()[0] for f in schema.split(", ")])

        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in (*keys, "y", "x")]
            if not len(rows[0]):
                continue
            rows = rows if held is None else [np.concatenate(p) for p in zip(held, rows, strict=True)]
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]) | (rows[2] != rows[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last tile may go on in the next batch
            if cut:
                yield from done([c[:cut] for c in rows])
            held = [c[cut:] for c in rows]
        if held is not None:
            yield from done(held)

    return sorted_rows.mapInArrow(run, schema)


def morphed(mask: DataFrame, steps: Steps, height: int, width: int, images: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """img_id, y, x of the masks after the steps (`erode`, `dilate` with a radius, `invert`)."""
    import numpy as np

    def finish(cells, img, top, left):
        g, y, x = np.nonzero(cells)
        return img[g], y + top[g], x + left[g]

    return _run(mask, steps, height, width, images, tile, finish, "img_id long, y long, x long")


def labelled(mask: DataFrame, steps: Steps, height: int, width: int, eight: bool = True, images: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """img_id, y, x, first: pixels after the steps, with the raster index (y * width + x) of their component's first pixel."""

    def finish(cells, img, top, left):
        g, y, x, root = _labels(cells, eight)
        y, x = y + top[g], x + left[g]
        return img[g], y, x, (y * width + x)[root]

    own = _run(mask, steps, height, width, images, tile, finish, "img_id long, y long, x long, first long")
    return own if height <= tile and width <= tile else _joined(own, tile, eight)


def _joined(own: DataFrame, tile: int, eight: bool) -> DataFrame:
    """Tiles' components put together where they touch; only pixels on edges meet in a join, PIXELS or so in a task."""
    named, _ = scratch.materialize(own, "tiles")
    n = max(named.sparkSession.sparkContext.defaultParallelism, -(-named.count() // PIXELS))
    edge = named.filter(f"y % {tile} IN (0, {tile - 1}) OR x % {tile} IN (0, {tile - 1})")
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    to = F.explode(F.array(*[F.struct(F.lit(a).cast("long").alias("dy"), F.lit(b).cast("long").alias("dx")) for a, b in steps]))
    moved = edge.select("img_id", F.col("first").alias("f"), "y", "x", to.alias("o")).select("img_id", "f", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    node = lambda c: F.struct(F.col("img_id"), F.col(c).alias("first"))
    at = ["img_id", "y", "x"]
    links = moved.repartition(n, *at).join(edge.select(*at, "first").repartition(n, *at), at).filter("f <> first").select(node("f").alias("a"), node("first").alias("b"))
    roots = graph.components(links, n).select("node.img_id", "node.first", F.col("root.first").alias("least"))
    # the root is the smallest node of its component, so it is the first pixel of the whole
    of = ["img_id", "first"]
    return named.repartition(n, *of).join(roots.repartition(n, *of), of, "left").select("img_id", "y", "x", F.coalesce("least", "first").alias("first"))


def large_enough(found: DataFrame, least: int) -> DataFrame:
    """Pixels of components (img_id, first) with at least so many pixels."""
    sizes = found.groupBy("img_id", "first").agg(F.count(F.lit(1)).alias("area")).filter(F.col("area") >= least)
    return found.join(sizes.select("img_id", "first"), ["img_id", "first"], "left_semi")


def relabelled(found: DataFrame) -> DataFrame:
    """img_id, y, x, label: components numbered from 1 in the order of their first pixels (the list of labels is per image)."""
    numbers = found.select("img_id", "first").distinct()
    numbers = numbers.withColumn("label", F.row_number().over(Window.partitionBy("img_id").orderBy("first")).cast("long"))
    return found.join(numbers, ["img_id", "first"]).select("img_id", "y", "x", "label")


def instances(mask: DataFrame, steps: Steps, height: int, width: int, least: int, eight: bool = True, images: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """img_id, y, x, label: after the steps, components of at least so many pixels, numbered in raster order of their first ones."""
    import numpy as np

    if height > tile or width > tile:
        return relabelled(large_enough(labelled(mask, steps, height, width, eight, images, tile), least))

    def finish(cells, img, top, left):
        g, y, x, root = _labels(cells, eight)
        area = np.bincount(root, minlength=len(root))
        firsts = np.flatnonzero(area >= max(1, least))  # in raster order, tile by tile
        begin = np.searchsorted(g[firsts], np.arange(len(cells)))
        label = np.zeros(len(root), np.int64)
        label[firsts] = np.arange(len(firsts)) - begin[g[firsts]] + 1
        keep = label[root] > 0
        return img[g[keep]], y[keep], x[keep], label[root[keep]]

    return _run(mask, steps, height, width, images, tile, finish, "img_id long, y long, x long, label long")
