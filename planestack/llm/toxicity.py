"""Toxicity by multiple-instance learning: sentences are instances, documents the bags that carry the labels.

A sentence has the probability sigmoid(w.x + b) over its hashed distinct words and word beginnings (3 to 6 letters, so that the
inflected forms of a stem share weight); a document combines its sentences by noisy-or, 1 - prod(1 - p). Training follows the gradient of the document's log-loss into every sentence (FTRL-proximal), so the
sentences that make a document toxic are located without any sentence label. No feature is left out; l1 keeps most at 0.

Noisy-or alone makes any text toxic that is long enough, as each harmless sentence adds a little. So a sentence counts once in a
document, however often it is repeated, and a document longer than usual is held against what harmless text of that length adds
up to: from the harmless training documents come the usual length, and mean and spread of what a sentence adds. Sentences beyond
the usual length must exceed the mean by SURE standard errors together; or a stretch of STRETCH sentences must do so by itself,
which finds a toxic passage in a text of any length.

Defined results: a null or empty text, or one without words, has no sentence and scores 0. Repeated rows are scored each for
itself. Further columns are left out.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.llm import common, ftrl

SIZE = 1 << 20
#: The last coordinate is the bias.
BIAS = SIZE - 1
#: At most so many labelled documents are learned from (the bound of the training sample).
MOST = 12_000
ROUNDS = 5
#: Times a partition goes over its rows in each round.
PASSES = 3
SETTINGS = {"alpha": 0.5, "beta": 1.0, "l1": 2.0, "l2": 0.2}
SENTENCE = re.compile(r"[^.!?\n。！？]+")
WORD = re.compile(r"\w+")
#: Standard errors that a text must be over what harmless text adds up to; sentences of a stretch looked at for itself.
SURE, STRETCH = 3.0, 8
#: Share of the harmless training documents that are no longer than the usual length.
USUAL = 0.9
#: Distinct words whose weight a task remembers before it starts afresh.
MEMO = 1 << 16


class Model(NamedTuple):
    """Weights, and what harmless text is like: the usual number of sentences, mean and spread of what one adds (-log(1 - p))."""

    weights: np.ndarray
    usual: float = math.inf
    mean: float = 0.0
    spread: float = 0.0

    def expected(self, sentences: int) -> float:
        """The most that so many sentences of harmless text are held to add up to."""
        return self.mean * sentences + SURE * self.spread * math.sqrt(sentences)

    def evidence(self, added: list[float]) -> float:
        """What a document's distinct sentences add up to beyond harmless text; 1 - exp(-it) is the score."""
        n = len(added)
        if n <= self.usual:
            return math.fsum(added)
        sums = np.concatenate([[0.0], np.cumsum(added)])
        whole = sums[-1] - self.expected(n - int(self.usual))
        if n > STRETCH:
            whole = max(whole, float((sums[STRETCH:] - sums[:-STRETCH]).max()) - self.expected(STRETCH))
        return max(0.0, whole)


def features(word: str) -> list[int]:
    """Ids of a word and of its beginnings."""
    parts = [word, *(f"^{word[:k]}" for k in range(3, min(6, len(word)) + 1))]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BIAS for p in parts]


def _instances(text: str | None) -> tuple[list[int], list[int]]:
    """Feature ids of the distinct sentences in a row, and the count of each sentence's."""
    ids, counts = [], []
    for sentence in dict.fromkeys(s.strip() for s in SENTENCE.findall((text or "").lower())):
        if words := set(WORD.findall(sentence)):
            own = {i for w in words for i in features(w)}
            ids += sorted(own)
            counts.append(len(own))
    return ids, counts


def _featurised(rows: DataFrame) -> DataFrame:
    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in common.slices(batches):
            out = [_instances(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "y": batch.column("y"),
                    "ids": [np.array(i, np.int32).tobytes() for i, _ in out],
                    "counts": [np.array(c, np.int32).tobytes() for _, c in out],
                }
            )

    return rows.mapInArrow(make, "doc_id long, y int, ids binary, counts binary")


def _step(model: ftrl.Ftrl, row: dict) -> None:
    ids, counts = np.frombuffer(row["ids"], np.int32), np.frombuffer(row["counts"], np.int32)
    if not len(counts):
        return
    at, where = np.unique(ids, return_inverse=True)
    at = np.append(at, BIAS)
    w = model.weights(at)
    starts = np.cumsum(counts) - counts
    score = np.add.reduceat(w[where], starts) + w[-1]
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    log_clean = np.log1p(-np.minimum(p, 1 - 1e-12)).sum()
    clean = np.exp(log_clean)
    toxic = max(-np.expm1(log_clean), 1e-9)
    slope = -clean / toxic * p if row["y"] else p
    g = np.append(np.bincount(where, np.repeat(slope, counts), len(at) - 1), slope.sum())
    model.update(at, w, g)


def _harmless(rows: DataFrame, weights: np.ndarray) -> Model:
    """The model with the background of the harmless training rows (those that don't score 0.5 against their label)."""
    at = np.flatnonzero(weights).astype(np.int32)
    shared = rows.sparkSession.sparkContext.broadcast((at, weights[at]))

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        dense = np.zeros(SIZE)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            out = []
            for ids, counts in zip(batch.column("ids").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                ids, counts = np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int32)
                if len(counts):
                    z = np.add.reduceat(dense[ids], np.cumsum(counts) - counts) + dense[BIAS]
                    x = -np.log1p(-np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-12))
                    if x.sum() < math.log(2):
                        out.append((len(x), float(x.sum()), float((x * x).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.float64()) for i in range(3)], ["n", "x", "xx"])

    found = rows.filter("y = 0").select("ids", "counts").mapInArrow(add, "n double, x double, xx double")
    r = found.agg(F.percentile("n", F.lit(USUAL)).alias("usual"), F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("xx").alias("xx")).first()
    shared.destroy()
    if not r["n"]:
        return Model(weights)
    mean = r["x"] / r["n"]
    return Model(weights, r["usual"], mean, math.sqrt(max(0.0, r["xx"] / r["n"] - mean * mean)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: F.Column | None = None, most: int = MOST) -> Model:
    """A model learned from a bounded sample of the labelled rows for which held_out is not true."""
    keep = ~held_out if held_out is not None else F.lit(True)
    rows, path = common.materialize(_featurised(ftrl.spread(common.training_rows(docs, labels, label, keep, most))), "mil")
    # A bag of sentences starts out improbable: the bias is set so that w = -6 there.
    z = 6 * (SETTINGS["beta"] / SETTINGS["alpha"] + SETTINGS["l2"]) + SETTINGS["l1"]
    model = _harmless(rows, ftrl.train(ftrl.spread(rows), _step, SIZE, ROUNDS, {BIAS: z}, PASSES, **SETTINGS))
    common.drop(docs.sparkSession, path)
    return model


def _located(spans: list[tuple], threshold: float) -> list[tuple]:
    """The spans (start, end, p) at or over the threshold, and more, the likeliest first, until all reach it by noisy-or."""
    kept, clean = [], 1.0
    for span in sorted(spans, key=lambda s: (-s[2], s[0])):
        if span[2] < threshold and 1 - clean >= threshold:
            break
        kept.append(span)
        clean *= 1 - span[2]
    return sorted(kept)


def _span(start: int, end: int, p: float, place: np.ndarray | None) -> dict:
    if place is not None:
        start, end = int(np.searchsorted(place, start, "right")), int(np.searchsorted(place, end - 1, "right")) + 1
    return {"start": start, "end": end, "score": float(p)}


def score(rows: DataFrame, weights: Model | np.ndarray, threshold: float = 0.5) -> DataFrame:
    """row, score, sentences: array of (start, end, score), in the order of the text.

    sentences: those at or over the threshold; if a document is over it with none of these enough, also the fewest others, the
    likeliest first, whose noisy-or reaches the threshold together. So each document over the threshold has some. rows: boxed
    documents. Positions are code points of the text itself. Bare weights make no allowance for length.
    """
    model = weights if isinstance(weights, Model) else Model(weights)
    weights, model = model.weights, model._replace(weights=None)
    at = np.flatnonzero(weights).astype(np.int32)
    shared = rows.sparkSession.sparkContext.broadcast((at, weights[at]))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        dense = np.zeros(SIZE)
        dense[shared.value[0]] = shared.value[1]
        table, bias = array("d", dense.tobytes()), float(dense[BIAS])
        del dense
        quiet = -math.log1p(-1 / (1 + math.exp(-min(30.0, max(-30.0, bias)))))
        memo: dict[str, array] = {}  # ids with a weight, as plain integers: a worker keeps some 200 bytes for a word
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in common.slices(batches):
            scores, found = [], []
            for text in batch.column("row").field("text").to_pylist():
                added, spans, said = [], [], set()
                text = text or ""
                low = text.lower()
                place = None  # where lower case has another length: the end of each character in it
                if len(low) != len(text):
                    place = np.cumsum([len(c.lower()) for c in text])
                for m in SENTENCE.finditer(low):
                    words = set(WORD.findall(m[0]))
                    if not words or (sentence := m[0].strip()) in said:
                        continue
                    said.add(sentence)
                    total, seen = bias, None
                    for w in words:
                        v = memo.get(w)
                        if v is None:
                            if len(memo) >= MEMO:
                                memo.clear()
                            v = memo[w] = array("i", [i for i in features(w) if table[i]])
                        if v:
                            if seen is None:
                                seen = set()
                            seen.update(v)
                    if seen is None:
                        added.append(quiet)
                        continue
                    total += math.fsum(map(table.__getitem__, seen))  # the same in whatever order words come
                    p = 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))
                    added.append(-math.log1p(-min(p, 1 - 1e-12)))
                    spans.append((m.start(), m.end(), p))
                scores.append(-math.expm1(-model.evidence(added)))
                found.append([_span(a, b, p, place) for a, b, p in _located(spans, threshold)] if scores[-1] >= threshold else [])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(scores, pa.float64()), pa.array(found, kind)], ["row", "score", "sentences"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, sentences array<struct<start:int,end:int,score:double>>")


def clean(docs: DataFrame, weights: Model | np.ndarray, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score under the threshold; all columns unchanged."""
    return common.unboxed(score(common.boxed(docs), weights, threshold).filter(F.col("score") < threshold))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; labels are learned from the rows that aren't held out."""
    docs = common.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = common.crc_remainder(5) == 0
    scored = score(common.boxed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), train(docs, labels, held_out=held_out))
    scored = scored.select("row.doc_id", "score", "sentences")
    return scored.select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("sentences").alias("n_sentences"),
        "sentences",
    )
