"""Fingerprints of awkward tables and of long texts."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from planestack.llm import fingerprint

LINES = lambda t: {p for p in t.split("\n") if p}
LIKE = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0


def saved(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, next string, a string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_followers_of_uneven_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS", 4)
    rows = [(i, f"text {i}\nline {i % 3}\nsame", "n", "a") for i in [*range(50), 2**60, -(2**61), 1000]] + [(7, "", "n", "a"), (None, "no id", "n", "a"), (None, None, "n", "a"), (9, None, "n", "a"), (9, "\n\n", "n", "a")]
    got = fingerprint.op9_fingerprint(spark, saved(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    by_id = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    texts = {i: sorted(r[1] or "" for r in rows if r[0] == i) for i in [*by_id, None]}
    found = {(r.doc_id, r.edited_sha256, round(r.near_next, 6)) for r in got}
    for i, doc_id in enumerate(by_id[:-1]):
        if len(texts[doc_id]) > 1 or len(texts[by_id[i + 1]]) > 1:
            continue
        text, after = texts[doc_id][0], texts[by_id[i + 1]][0]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        assert (doc_id, hashlib.sha256(edited.encode()).hexdigest(), round(LIKE(LINES(text), LINES(after)), 6)) in found
    followers = {(r.text, r.next) for r in fingerprint.followed(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert {n for _, n in followers} == {t or "" for _, t, _, _ in rows}
    ranges = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert ranges.groupBy(fingerprint._range_of(ranges)).count().agg(F.max("count")).first()[0] < 20


def test_one_document_and_none(spark, tmp_path):
    sf = saved(spark, tmp_path, [(3, "a\nb", "", "")])
    row = fingerprint.op9_fingerprint(spark, sf).first()
    assert (row.doc_id, row.n_chars, row.near_next) == (3, 3, 1.0)
    assert fingerprint.followed(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


def timed(spark, tmp_path, n, step):
    """Seconds for two documents of n lines, of which the second's start `step` lines on; both likenesses are checked."""
    text = lambda k: "\n".join(f"line {i}" for i in range(k, k + n))
    sf = saved(spark, tmp_path, [(1, text(0), "", ""), (2, text(step), "", "")])
    began = time.time()
    rows = {r.doc_id: r for r in fingerprint.op9_fingerprint(spark, sf).select("doc_id", "near_next").collect()}
    want = max(0, n - step) / (n + min(n, step))
    assert rows[1].near_next == pytest.approx(want) and rows[2].near_next == pytest.approx(want)
    return time.time() - began


def test_time_follows_the_lines_of_a_text(spark, tmp_path):
    timed(spark, tmp_path / "a", 12_000, 6_000)
    few, many = timed(spark, tmp_path / "b", 50_000, 50_000), timed(spark, tmp_path / "c", 100_000, 100_000)
    assert many < 60 and many < 2.5 * few + 5
