"""Scores and training steps of the two classifiers against plain versions."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planestack.llm import common, ftrl, quality, toxicity

TEXTS = ["You are bad. All is well! And more", "", None, "...", "İstanbul GROß. Bad BAD bad\nend", "bad " * 300, "x" * 5000, "one. two. three. four. bad", "İİ bad. tail words here"]


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def plain_toxicity(text, w):
    """Score and (start, end, p) of each sentence in lower case, feature by feature."""
    out, clean = [], 1.0
    for m in re.finditer(r"[^.!?\n。！？]+", (text or "").lower()):
        ids = set()
        for word in re.findall(r"\w+", m[0]):
            ids |= {zlib.crc32(p.encode()) % toxicity.BIAS for p in [word] + ["^" + word[:k] for k in range(3, 7) if k <= len(word)]}
        if ids:
            p = sigmoid(w[toxicity.BIAS] + sum(w[i] for i in ids))
            out.append((m.start(), m.end(), p))
            clean *= 1 - p
    return 1 - clean, out


@pytest.mark.parametrize("bias", [-4.0, -1.0])
def test_toxicity_scores(spark, bias):
    w = np.random.default_rng(1).normal(0, 0.4, toxicity.SIZE)
    w[toxicity.BIAS] = bias
    w[zlib.crc32(b"bad") % toxicity.BIAS], w[zlib.crc32(b"^bad") % toxicity.BIAS] = 3.0, 3.0
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    seen = 0
    for r in toxicity.score(common.boxed(df), w).collect():
        text = TEXTS[r.row.doc_id] or ""
        score, sentences = plain_toxicity(text, w)
        assert r.score == pytest.approx(score, abs=1e-9)
        found = [(s.start, s.end, round(s.score, 9)) for s in r.sentences]
        assert found == sorted(found) and bool(found) == (score >= 0.5)
        assert 1 - np.prod([1 - s.score for s in r.sentences]) >= 0.5 or not found
        low = {round(p, 9): text.lower()[a:b] for a, b, p in sentences}
        assert all(text[a:b].lower() == low[p] for a, b, p in found)
        if found:
            assert {round(p, 9) for _, _, p in sentences if p >= 0.5} <= {p for _, _, p in found}
            seen += 1
    assert seen > 2


@pytest.fixture(scope="module")
def learned(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    return docs, labels, toxicity.train(docs, labels, held_out=common.crc_remainder(5) == 0)


def test_harmless_text_of_any_length_stays_harmless(spark, learned):
    docs, labels, model = learned
    clean = docs.join(labels.filter("toxic = 0"), "doc_id").select("doc_id", "text").orderBy("doc_id")
    kept = toxicity.score(common.boxed(clean), model).filter("score < 0.5").select("row.text").collect()
    sentences = [s for r in kept for s in re.findall(r"[^.!?\n]+[.!?\n]+", r.text or "")]
    draw = np.random.default_rng(3)
    texts = [" ".join(sentences[i] for i in draw.integers(0, len(sentences), n)) for n in (10, 100, 300, 1000, 3000, 10_000, 50_000) for _ in range(4)]
    texts += ["The weather is fine today. " * n for n in (1, 1000, 50_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    over = {r.row.doc_id: r.score for r in toxicity.score(common.boxed(df), model).filter("score >= 0.5").collect()}
    assert over == {}


def test_a_toxic_passage_shows_in_a_long_text(spark, learned):
    docs, labels, model = learned
    both = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id")
    toxic = toxicity.score(common.boxed(both.filter("toxic = 1")), model).filter("score >= 0.95").select("row.text").collect()
    clean = [r.text or "" for r in both.filter("toxic = 0").limit(300).collect()]
    texts = ["\n".join([*clean[i : i + 60], r.text, *clean[i + 60 : i + 120]]) for i, r in enumerate(toxic[:40])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = toxicity.score(common.boxed(df), model).filter("score >= 0.5").count()
    assert found >= 0.9 * len(texts)


def test_allowance_for_length():
    model = toxicity.Model(None, 20, 0.001, 0.01)
    assert model.evidence([0.5] * 20) == pytest.approx(10)
    assert model.evidence([0.001] * 10_000) == 0
    assert model.evidence([0.001] * 5000 + [1.0] * 3 + [0.001] * 5000) == pytest.approx(3.005 - 0.008 - 0.03 * 8**0.5)
    assert model.evidence([]) == 0


def test_few_sentences_locate_a_document_together():
    spans = [(0, 5, 0.3), (6, 9, 0.1), (10, 20, 0.4), (21, 30, 0.2)]
    assert toxicity._located(spans, 0.5) == [(0, 5, 0.3), (10, 20, 0.4)]
    assert toxicity._located([(0, 5, 0.6), (6, 9, 0.55), (10, 20, 0.4)], 0.5) == [(0, 5, 0.6), (6, 9, 0.55)]


def gradients(step, row, size, start):
    """What a step takes as the gradient of each coordinate, read off its new state (alpha = 1, n = 0)."""
    model = ftrl.Ftrl(size, 1.0, 1.0, 0.0, 0.0)
    model.z[:] = -start  # with beta = alpha = 1, n = 0 and no l1 or l2, w = -z
    step(model, row)
    g = np.sqrt(model.n)
    moved = model.z + start
    return np.where(np.abs(moved - (g - g * start)) < 1e-9, g, -g)


@pytest.mark.parametrize("y", [0, 1])
def test_gradient_of_a_bag(y):
    draw = np.random.default_rng(y)
    w = np.zeros(toxicity.SIZE)
    ids, counts = [3, 9, 3, 20, 9, 20, 40], [2, 3, 2]
    at = [3, 9, 20, 40, toxicity.BIAS]
    w[at] = draw.normal(0, 0.7, 5)

    def loss(w):
        clean, a = 1.0, 0
        for n in counts:
            clean *= 1 - sigmoid(w[toxicity.BIAS] + w[ids[a : a + n]].sum())
            a += n
        return -np.log(1 - clean if y else clean)

    got = gradients(toxicity._step, {"ids": np.array(ids, np.int32).tobytes(), "counts": np.array(counts, np.int32).tobytes(), "y": y}, toxicity.SIZE, w)
    for i in at:
        up, down = w.copy(), w.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert got[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)
    assert np.count_nonzero(got) == len(at)


def plain_quality(text, w):
    counts, before = {}, None
    tokens = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text or "")]
    marks = [quality.SAME if i and tokens[i] == tokens[i - 1] else t for i, t in enumerate(tokens)]
    for i, t in enumerate(marks):
        counts[t % quality.BIAS] = counts.get(t % quality.BIAS, 0) + 1
        if i:
            pair = (before * 0x9E3779B97F4A7C15 + t * 0xC2B2AE3D27D4EB4F) % 2**64
            pair = ((pair ^ (pair >> 29)) >> 11) % quality.BIAS
            counts[pair] = counts.get(pair, 0) + 1
        before = t
    x = {i: np.log1p(n) for i, n in counts.items()}
    norm = np.sqrt(sum(v * v for v in x.values())) or 1.0
    return sigmoid(w[quality.BIAS] + sum(w[i] * v / norm for i, v in x.items())), len(x)


def test_quality_scores(spark):
    w = np.random.default_rng(2).normal(0, 1, quality.SIZE)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in quality.score(df, w).collect():
        score, n = plain_quality(TEXTS[r.doc_id], w)
        assert r.score == pytest.approx(score, abs=1e-5) and r.n_features == n


@pytest.mark.parametrize("y", [0, 1])
def test_gradient_of_a_text(y):
    w = np.zeros(quality.SIZE)
    ids, x = np.array([2, 5, 11], np.int32), np.array([0.6, 0.3, 0.1], np.float32)
    w[[2, 5, 11, quality.BIAS]] = [0.5, -1.0, 2.0, 0.3]
    got = gradients(quality._step, {"ids": ids.tobytes(), "weights": x.tobytes(), "y": y}, quality.SIZE, w)
    p = sigmoid(w[ids] @ x + w[quality.BIAS])
    assert got[ids] == pytest.approx((p - y) * x) and got[quality.BIAS] == pytest.approx(p - y)


def test_one_text_of_several_for_an_id(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, quality int")
    rows = common.training_rows(docs, labels, "quality", labels.doc_id >= 0, 10)
    assert {tuple(r) for r in rows.collect()} == {(1, "a", 1), (2, None, 0)}


def test_a_round_is_the_mean_of_its_partitions(spark):
    size, settings = 64, {"alpha": 0.5, "beta": 1.0, "l1": 0.01, "l2": 0.1}

    def step(model, row):
        at = np.array([row["doc_id"] % 7, 10 + row["doc_id"] % 50, 63])
        w = model.weights(at)
        model.update(at, w, np.full(3, 1 / (1 + np.exp(-w.sum())) - row["y"]))

    rows = spark.createDataFrame([(i, i % 3 % 2) for i in range(90)], "doc_id long, y int").repartition(5, "doc_id").cache()
    parts = rows.select("*", F.spark_partition_id().alias("part")).collect()
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(3):
        states = []
        for part in sorted({r.part for r in parts}):
            own = [r.asDict() for r in parts if r.part == part]
            model = ftrl.Ftrl(size, z=z, n=n, **settings)
            for row in own * -(-ftrl.LEAST // len(own)):
                step(model, row)
            states.append((len(own), model))
        z = sum(k * m.z for k, m in states) / len(parts)
        n = sum(k * m.n for k, m in states) / len(parts)
    want = ftrl.Ftrl(size, z=z, n=n, **settings).weights(slice(None))
    got = ftrl.train(rows, step, size, 3, **settings)
    rows.unpersist()
    assert np.abs(want).max() > 0.1 and got == pytest.approx(want, abs=1e-4)
    assert not ftrl.train(rows.limit(0), step, size, 2, **settings).any()
