"""Helpers shared by the language-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.sources.scratch import drop, materialize  # noqa: F401


def boxed(df: DataFrame) -> DataFrame:
    """All columns as one struct, `row`, so that whatever their names they can't clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unboxed(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator, rows: int = 256) -> Iterator:
    """Record batches in pieces of so many rows, which keeps small what a worker turns into Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterator, key: str, columns: list[str]) -> Iterator[tuple]:
    """(key, {column: array}) for each run of equal keys in Arrow batches that are sorted by key, across batch borders."""
    import numpy as np

    held, of = {c: [] for c in columns}, None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        data = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if of is not None and keys[a] != of:
                yield of, {c: np.concatenate(v) for c, v in held.items()}
                held = {c: [] for c in columns}
            of = keys[a]
            for c in columns:
                held[c].append(data[c][a:b])
    if of is not None:
        yield of, {c: np.concatenate(v) for c, v in held.items()}


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, train: F.Column, most: int
) -> DataFrame:
    """doc_id, text and y (0 or 1) of at most `most` labelled training rows, those with the smallest hash of doc_id.

    Null labels or ids are left out; of several labels for one id the largest counts, of several texts the smallest. The ids
    are picked first, so that only `most` short rows meet; their texts follow by a join whose small side has that bound.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train)
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def crc_remainder(of: int) -> F.Column:
    """crc32 of doc_id as text, modulo `of`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(of)

