"""Phrase collocations against a plain count and against SQL."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from planestack.llm import collocations
from tests.compare import assert_same, tables

SCHEMA = "doc_id long, text string, lang string, block string, a long, word string, bucket int"


def brute(rows, top=2000, longest=3, least=10, held=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {p[i:j] for p, a in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= held * counts[p[i:j]]}
        told = []
        for p, a in often.items():
            if p not in dropped:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                told.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]], score))
        out += [(lang, i + 1, p.decode(), a, le, r, n[lang], s) for i, (_, _, p, a, le, r, s) in enumerate(sorted(told)[:top])]
    return sorted(map(str, out))


def made():
    draw = np.random.default_rng(2)
    word = lambda: "wW é0 x-y b c ß ÄÖ q's".split(" ")[int(draw.integers(0, 7))]
    rows = []
    for i in range(300):
        rows.append(("".join(word() + [" ", "  ", "\t", ". ", ",", "\n", " ! "][int(min(6, draw.geometric(0.5) - 1))] for _ in range(int(draw.integers(0, 60)))), ["en", "de", None, "und", ""][i % 5]))
    return [*rows, (None, "en"), ("", "fr"), ("...", "en"), ("one two three four. " * 30, "en"), ("one two three four " * 30_000, "de"), ("a a a a a a a a a a a a a a", "xx")]


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i // 2, t, la, "b", 1, "w", 2) for i, (t, la) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("block,chunk", [(4 << 20, 1 << 20), (500, 100)])
def test_against_a_plain_count(spark, monkeypatch, block, chunk):
    rows, sizes = made(), {"BLOCK": block, "CHUNK": chunk}
    for k, v in sizes.items():
        monkeypatch.setattr(collocations, k, v)
    df = frame(spark, rows).repartition(3)
    assert told(collocations.collocations(df)) == brute(rows)
    if block > 500:
        assert told(collocations.collocations(df, top=5, max_words=5, least=3, held=80)) == brute(rows, 5, 5, 3, 80)
    assert collocations.collocations(df.limit(0)).collect() == []


def test_scores_are_exact(spark):
    rows = [(10**12 - 1, 10**12 + 7, 10**12 + 9), (3 * 10**11 + 1, 10**14, 3 * 10**11 + 1), (10, 10, 10)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r.s == 1_000_000 * r.a * r.a // (r.l * r.r) for r in df.collect())


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", None])
def test_sql(spark, tmp_path, sf):
    if sf is None:
        sf = str(tmp_path)
        frame(spark, made()).coalesce(1).write.parquet(f"{sf}/documents.parquet")
    assert_same(collocations.op11_collocations(spark, sf), collocations.OP11_SQL, tables(sf))
