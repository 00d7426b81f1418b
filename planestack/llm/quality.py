"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal, scored as sparse dot products.

Tokens are runs of word characters or runs of other visible characters. A token that repeats the one before it is replaced by
a fixed mark, so that stutter looks alike whatever the word. Features are the distinct unigrams and bigrams of a text with the
weight log(1 + count), scaled to unit length, plus a bias.

Defined results: a null or empty text has only the bias. Repeated rows are scored each for itself; further columns are left
out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.llm import common, ftrl

SIZE = 1 << 20
BIAS = SIZE - 1
#: At most so many labelled documents are learned from (the bound of the training sample).
MOST = 12_000
ROUNDS = 4
#: Times a partition goes over its rows in each round.
PASSES = 2
SETTINGS = {"alpha": 1.0, "beta": 1.0, "l1": 0.3, "l2": 0.3}
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Distinct tokens whose hash a task remembers before it starts afresh.
MEMO = 1 << 17
SAME = 2_654_435_761


class Features:
    """Distinct feature ids of a text and their weights; remembers the hashes of tokens."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = TOKEN.findall(text or "")
        memo = self.memo
        try:
            own = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for t in set(tokens):
                if t not in memo:
                    memo[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
            own = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        if not len(own):
            return np.empty(0, np.int32), np.empty(0, np.float32)
        again = np.append(False, own[1:] == own[:-1])
        own = np.where(again, np.uint64(SAME), own)
        pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        pairs = (pairs ^ (pairs >> np.uint64(29))) >> np.uint64(11)
        ids = np.concatenate([own, pairs]) % np.uint64(BIAS)
        ids = np.sort(ids.astype(np.int32))
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        weight = np.log1p(np.diff(np.append(first, len(ids)))).astype(np.float32)
        return ids[first], weight / np.sqrt(weight @ weight)


def _featurised(rows: DataFrame) -> DataFrame:
    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        features = Features()
        for batch in common.slices(batches):
            found = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "ids": [i.tobytes() for i, _ in found], "weights": [w.tobytes() for _, w in found]})

    return rows.mapInArrow(make, "doc_id long, y int, ids binary, weights binary")


def _step(model: ftrl.Ftrl, row: dict) -> None:
    ids = np.frombuffer(row["ids"], np.int32)
    at, x = np.append(ids, BIAS), np.append(np.frombuffer(row["weights"], np.float32), 1.0)
    w = model.weights(at)
    p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
    model.update(at, w, (p - row["y"]) * x)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: F.Column | None = None, most: int = MOST) -> np.ndarray:
    """Weights learned from a bounded sample of the labelled rows for which held_out is not true."""
    keep = ~held_out if held_out is not None else F.lit(True)
    rows, path = common.materialize(_featurised(ftrl.spread(common.training_rows(docs, labels, label, keep, most))), "ngram")
    weights = ftrl.train(ftrl.spread(rows), _step, SIZE, ROUNDS, passes=PASSES, **SETTINGS)
    common.drop(docs.sparkSession, path)
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (probability of label 1), n_features (distinct features found)."""
    at = np.flatnonzero(weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at].astype(np.float32)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = np.zeros(SIZE, np.float32)
        table[shared.value[0]] = shared.value[1]
        features, bias = Features(), float(table[BIAS])
        for batch in common.slices(batches):
            scores, counts = [], []
            for text in batch.column("text").to_pylist():
                ids, weight = features(text)
                z = bias + float(table[ids] @ weight)
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
                counts.append(len(ids))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64()), "n_features": pa.array(counts, pa.int32())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, n_features int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; labels are learned from the rows that aren't held out."""
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = common.crc_remainder(4) == 2
    scored = score(docs, train(docs, labels, held_out=held_out))
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "n_features",
    )
