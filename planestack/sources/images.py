"""Two-dimensional images: PNG without an image library, folders of images, and resampling of dense tiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = r"(?i)\.(png|jpe?g|tiff?)$"
MAGIC = b"\x89PNG\r\n\x1a\n"


def encode_png(pixels) -> bytes:
    """PNG of a 2-D array of 8 or 16 bits, or of an (h, w, 3) array of 8 bits."""
    import numpy as np

    deep = pixels.dtype.itemsize == 2
    data = np.ascontiguousarray(pixels.astype(">u2") if deep else pixels.astype(np.uint8))
    h, w = data.shape[:2]
    rows = np.hstack([np.zeros((h, 1), np.uint8), data.reshape(h, -1).view(np.uint8)])

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 16 if deep else 8, 2 if data.ndim == 3 else 0, 0, 0, 0)
    return MAGIC + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def decode_png(content: bytes):
    """Array of a PNG that is not interlaced, in grey or RGB (an alpha channel is dropped)."""
    import numpy as np

    if content[:8] != MAGIC:
        raise ValueError("not a PNG")
    at, body, head = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += content[at + 8 : at + 8 + n]
        at += 12 + n
    w, h, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if channels is None or depth not in (8, 16) or interlaced:
        raise ValueError("this kind of PNG can't be read")
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, -1)
    out = np.zeros((h, raw.shape[1] - 1), np.uint8)
    above = np.zeros(raw.shape[1] - 1, np.uint8)
    for i in range(h):
        out[i] = above = _unfiltered(raw[i, 0], raw[i, 1:], above, step)
    pixels = out.view(">u2").astype(np.uint16) if depth == 16 else out
    pixels = pixels.reshape(h, w, channels)
    return pixels[:, :, 0] if channels < 3 else pixels[:, :, :3]


def _unfiltered(kind: int, line, above, step: int):
    import numpy as np

    if kind == 0:
        return line.copy()
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line), np.uint8)
    for i in range(len(line)):
        a, b, c = (int(out[i - step]), int(above[i]), int(above[i - step])) if i >= step else (0, int(above[i]), 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (int(line[i]) + guess) & 255
    return out


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the images in a folder in the order of their paths, whatever the case of their suffix; an error if there are none."""
    found = spark.read.format("binaryFile").load(folder).filter(F.col("path").rlike(SUFFIXES)).select("path", "content")
    if found.select("path").isEmpty():
        raise ValueError(f"no images in {folder}")
    return found.orderBy("path")


def pixels_of(images: DataFrame) -> DataFrame:
    """path, y, x, r, g, b of PNG images (path, content); grey ones have three equal channels."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                p = decode_png(content)
                p = np.dstack([p] * 3) if p.ndim == 2 else p
                y, x = np.mgrid[: p.shape[0], : p.shape[1]]
                yield pa.RecordBatch.from_pydict({"path": [path] * y.size, "y": y.ravel(), "x": x.ravel(), **{c: p[:, :, i].ravel().astype(np.int32) for i, c in enumerate("rgb")}})

    return images.mapInArrow(run, "path string, y long, x long, r int, g int, b int")


def by_image(rows: DataFrame, columns: list[str]) -> DataFrame:
    """img_id and columns (all as long) with the rows of an image in one partition, one after the other. Rows of no image are left out."""
    long = rows.select(*[F.col(c).cast("long").alias(c) for c in ("img_id", *columns)]).filter("img_id IS NOT NULL")
    return long.repartition("img_id").sortWithinPartitions("img_id")


def whole(batches: Iterator, columns: list[str]) -> Iterator:
    """Arrays of the columns, img_id first, of whole images: an image that goes on in the next batch waits for it."""
    import numpy as np

    held: list = []
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in columns]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # ids ascend, so the last image begins here
        if held and cut:
            first = int(np.searchsorted(rows[0], held[0][0][0], "right"))
            yield [np.concatenate([*(h[k] for h in held), rows[k][:first]]) for k in range(len(columns))]
            if first < cut:
                yield [c[first:cut] for c in rows]
            held = [[c[cut:] for c in rows]]
        elif held and rows[0][0] != held[0][0][0]:
            yield [np.concatenate([h[k] for h in held]) for k in range(len(columns))]
            held = [rows]
        else:
            if cut:
                yield [c[:cut] for c in rows]
            held.append([c[cut:] for c in rows])
    if held:
        yield [np.concatenate([h[k] for h in held]) for k in range(len(columns))]


def png_of(masks: DataFrame, height: int, width: int, deep: bool = True) -> DataFrame:
    """img_id, content: a PNG of each labelled mask (img_id, y, x, label), of 16 bits, or of 8 with labels up to 255.

    One image is put together in one task, one after the other.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for img, y, x, label in whole(batches, ["img_id", "y", "x", "label"]):
            ids, starts = np.unique(img, return_index=True)
            content = []
            for a, b in zip(starts, [*starts[1:], len(img)], strict=True):
                grid = np.zeros((height, width), np.uint16 if deep else np.uint8)
                grid[y[a:b], x[a:b]] = label[a:b]
                content.append(encode_png(grid))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(content, pa.binary())], ["img_id", "content"])

    return by_image(masks, ["y", "x", "label"]).mapInArrow(run, "img_id long, content binary")


def windowed_sinc(out: int, into: int, lobes: int = 3):
    """(out, into) weights that resample a line by a windowed sinc, widened when the line shrinks; rows add up to 1."""
    import numpy as np

    scale = max(1.0, into / out)
    centre = (np.arange(out) + 0.5) * into / out
    d = (np.arange(into)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resampled(tiles: DataFrame, size: tuple[int, int]) -> DataFrame:
    """z, y, x, v of dense tiles (z, y, x, v) resized by a windowed sinc; one tile is one group."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        grid = np.zeros((y.max() + 1, x.max() + 1))
        grid[y, x] = table.column("v").to_numpy()
        new = windowed_sinc(size[0], grid.shape[0]) @ grid @ windowed_sinc(size[1], grid.shape[1]).T
        yy, xx = np.mgrid[: size[0], : size[1]]
        return pa.table({"z": np.full(yy.size, table.column("z")[0].as_py(), np.int64), "y": yy.ravel(), "x": xx.ravel(), "v": new.ravel()})

    return tiles.groupBy("z").applyInArrow(run, "z long, y long, x long, v double")
