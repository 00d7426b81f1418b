"""Trees of folders as rows: children and small files are listed and read by tasks, level by level.

A walk is a chain of these with filters between, so that what a filter leaves out is never listed below. Each level is dealt out
anew by its paths, since one folder's children come from one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

from planestack.sources import zarr


def children(rows: DataFrame, path: str = "path") -> DataFrame:
    """rows, once for each entry of their folder, with name and is_dir; a folder that isn't there (or a null path) has none."""
    schema = StructType([*rows.schema.fields, StructField("name", StringType()), StructField("is_dir", BooleanType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for i, at in enumerate(batch.column(path).to_pylist()):
                if at is None:
                    continue
                store, folder = zarr._store(at)
                for entries in _pieces(store.get_file_info(fs.FileSelector(folder, allow_not_found=True)), 1000):
                    own = batch.take(pa.array([i] * len(entries), pa.int64()))
                    names, dirs = pa.array([e.base_name for e in entries], pa.string()), pa.array([e.type == fs.FileType.Directory for e in entries])
                    yield pa.RecordBatch.from_arrays([*own.columns, names, dirs], schema.names)

    return rows.repartition(path).mapInArrow(run, schema)


def _pieces(items: list, size: int) -> Iterator[list]:
    for at in range(0, len(items), size):
        yield items[at : at + size]


def _bytes(path: str | None) -> bytes | None:
    if path is None:
        return None
    store, file = zarr._store(path)
    try:
        with store.open_input_stream(file, compression=None) as stream:
            return stream.read()
    except (FileNotFoundError, NotADirectoryError):
        return None


def contents(rows: DataFrame, path: Column | str, column: str, text: bool = True) -> DataFrame:
    """rows with a column that holds the text (or the bytes) of a small file; null if there is none."""
    schema = StructType([*rows.schema.fields, StructField(column, StringType() if text else BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [_bytes(at) for at in batch.column("_path").to_pylist()]
            held = pa.array([b if b is None else b.decode("utf-8", "replace") for b in found], pa.string()) if text else pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_path"], held], schema.names)

    return rows.withColumn("_path", path if not isinstance(path, str) else F.col(path)).mapInArrow(run, schema)
