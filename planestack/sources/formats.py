"""Formats for spark.read and df.write: chunked volumes with predicates that prune chunks, and files of bytes.

    formats.register(spark)
    spark.read.format("volume").option("scale", "s0").load(root).filter("z >= 40 AND z < 90")
    rows.write.format("files").mode("append").save(folder)          # name, content

Both work through the file system of the path (pyarrow.fs), as the tasks do.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from planestack.sources import zarr

#: Partitions of a read at most; beyond it each takes several chunks.
MOST_PARTITIONS = 10_000
AXES = ("z", "y", "x")


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let it hand predicates down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (VolumeSource, FileSink):
        spark.dataSource.register(source)


class Chunks(InputPartition):
    """Chunks by their place in the grid of chunks that are left."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class VolumeSource(DataSource):
    """z, y, x, v of one scale of a volume. Options: scale (s0), stride (1, along z)."""

    @classmethod
    def name(cls) -> str:
        return "volume"

    def schema(self) -> str:
        return "z long, y long, x long, v double"

    def reader(self, schema) -> DataSourceReader:
        return VolumeReader(dict(self.options))


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.scale, self.stride = options["path"], options.get("scale", "s0"), int(options.get("stride", "1"))
        store, folder = zarr._store(self.root)

        def read(name: str):
            with store.open_input_stream(f"{folder}/{name}") as stream:
                return json.loads(stream.read())

        try:
            attrs = read(".zattrs")
        except FileNotFoundError:
            attrs = None
        self.meta = zarr.described(read(f"{self.scale}/.zarray"), attrs, self.scale)
        zarr.readable(self.meta)
        self.ranges = [(0, n) for n in self.meta["shape"]]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on z, y and x narrow the ranges, from which chunks and voxels are taken; other predicates go back to Spark."""
        for f in filters:
            axis = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if axis not in AXES:
                yield f
                continue
            i = AXES.index(axis)
            low, high = self.ranges[i]
            if isinstance(f, EqualTo):
                low, high = max(low, f.value), min(high, f.value + 1)
            elif isinstance(f, GreaterThan):
                low = max(low, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                low = max(low, f.value)
            elif isinstance(f, LessThan):
                high = min(high, f.value)
            elif isinstance(f, LessThanOrEqual):
                high = min(high, f.value + 1)
            elif isinstance(f, In) and f.value:
                low, high = max(low, min(f.value)), min(high, max(f.value) + 1)
                yield f  # the values between are Spark's to leave out
            else:
                yield f
            self.ranges[i] = (low, max(low, high))

    def _grid(self) -> list[range]:
        return [range(a // c, -(-b // c)) if a < b else range(0) for (a, b), c in zip(self.ranges, self.meta["chunks"], strict=True)]

    def partitions(self) -> list[Chunks]:
        z, y, x = self._grid()
        n = len(z) * len(y) * len(x)
        each = max(1, -(-n // MOST_PARTITIONS))
        return [Chunks(a, min(n, a + each)) for a in range(0, n, each)] or [Chunks(0, 0)]

    def read(self, partition: Chunks):
        store, folder = zarr._store(self.root)
        z, y, x = self._grid()
        wanted = range(0, self.meta["shape"][0], self.stride)
        for k in range(partition.first, partition.last):
            at = (z[k // (len(y) * len(x))], y[k // len(x) % len(y)], x[k % len(x)])
            yield from zarr.chunk_batches(store, f"{folder}/{self.scale}", self.meta, at, self.ranges, wanted)


class FileSink(DataSource):
    """Rows (name string, content binary) as files under a folder; names may hold sub-folders."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["path"], schema.names, overwrite)


class Written(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class FileWriter(DataSourceArrowWriter):
    """A task writes each file beside its place and then moves it there, so that a file that is there is whole.

    A repeated or second attempt of a task writes the same names with the same content, so nothing is left twice. The mark
    _SUCCESS comes when all tasks are done, with the count of files; without it a reader knows that some may lack. Two rows with
    one name leave one of them. A null content is an empty file, a null name an error.
    """

    def __init__(self, root: str, names: list[str], overwrite: bool):
        if not {"name", "content"} <= set(names):
            raise ValueError("files have a name and a content")
        self.root = root
        store, folder = zarr._store(root)
        if overwrite:
            from pyarrow import fs

            if store.get_file_info(folder).type == fs.FileType.Directory:
                store.delete_dir_contents(folder)

    def write(self, iterator) -> Written:
        import uuid

        store, folder = zarr._store(self.root)
        made, files = set(), 0
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or ".." in name.split("/"):
                    raise ValueError(f"not a file name: {name}")
                at = f"{folder}/{name}"
                parent = at.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                beside = f"{parent}/_{uuid.uuid4().hex}"
                with store.open_output_stream(beside, compression=None) as out:
                    out.write(content or b"")
                store.move(beside, at)
                files += 1
        return Written(files)

    def commit(self, messages: list) -> None:
        store, folder = zarr._store(self.root)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m is not None)).encode())

    def abort(self, messages: list) -> None:
        """Whole files stay, without the mark; the next run writes them again."""
