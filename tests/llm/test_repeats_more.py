"""A very common line, and hashes that must not collide."""

import numpy as np
from pyspark.sql import functions as F

from planestack.llm import repeats
from planestack.llm.packed import unpack


def test_a_line_in_very_many_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(repeats, "BLOCK", 1 << 20)
    line = "All rights reserved, and this line stands in every document of the table."
    n = 10_000
    spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("own "), F.md5(F.col("id").cast("string")), F.lit(" "), F.lit(line)).alias("text")).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = df.join(repeats.cut_repeats(df), "doc_id").filter(F.size("spans") > 0)
    assert got.count() == n - 1 and got.filter("doc_id = 0").isEmpty()
    # What goes is the line, the space before it, and whatever ends of the own part stand before it elsewhere too.
    assert got.filter(F.octet_length("kept").between(28, 36) & (F.size("spans") == 1) & (F.col("spans")[0]["end"] == F.col("n_bytes"))).count() == n - 1
    # Each block announces the line's runs once, however many of its documents have it.
    blocks = df.select(F.pmod("doc_id", F.lit(4)).cast("int").alias("block"), "doc_id", F.col("text").cast("binary").alias("text"))
    sent = repeats._announced(blocks, 16).collect()
    names = np.concatenate([unpack(r.names) for r in sent])
    _, often = np.unique(names, return_counts=True)
    assert often.max() <= 4


def test_strings_that_collide_under_plain_powers():
    """Thue-Morse words of two letters have equal polynomial hashes modulo 2^64 whatever the base."""
    bits = np.array([bin(i).count("1") & 1 for i in range(1 << 11)], np.uint8)
    one, two = bytes(97 + bits), bytes(98 - bits)
    make = repeats.Runs()
    # Grams of 20 bytes are the same on both sides; whole runs are told by sums over them.
    eights = [make.eights(np.frombuffer(t, np.uint8)) for t in (one, two)]
    sums = [int(np.sum(e * make.powers[: len(e)], dtype=np.uint64)) for e in eights]
    assert sums[0] != sums[1]


def _codes_of(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    blocks = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)], "block int, doc_id long, text binary")
    return np.concatenate([unpack(r.codes, 1) for r in repeats._answered(repeats._announced(blocks, 16)).collect()])


def test_runs_with_a_gram_in_common_by_chance_are_not_sent(spark, monkeypatch):
    draw = np.random.default_rng(3)
    own = lambda n: bytes(draw.integers(97, 123, n, dtype=np.uint8))
    gram = own(30)
    chance = [own(200) + gram + own(200) for _ in range(40)]
    assert (_codes_of(spark, chance, monkeypatch, 4096) == 0).all()  # before: 2 for each run about the gram
    line = own(80)
    assert (_codes_of(spark, [own(200) + line + own(200) for _ in range(40)], monkeypatch, 4096) == 2).any()


def test_windows_of_hot_runs_go_once_for_a_block_and_meet_only_their_twins(monkeypatch):
    draw = np.random.default_rng(4)
    own = lambda n: draw.integers(97, 123, n, dtype=np.uint8)
    line = own(90)
    data = np.concatenate([x for _ in range(50) for x in (own(40), line)])
    start, windows = np.arange(0, len(data), 130), np.full(50, 130 - repeats.LENGTH + 1)
    at, _, runs, _, single, first = repeats._to_merge(np.full(50, 3), start, windows, data)
    assert len(runs) == 0 and len(single) == 50 * 81 and len(at) == len({bytes(data[a : a + 50]) for a in single}) < 2050  # before: 50 * 81
    assert all(bytes(data[a : a + 50]) == bytes(data[b : b + 50]) and a >= b for a, b in zip(single, at[first], strict=True))
    pieces = data[at[:, None] + np.arange(repeats.LENGTH)].reshape(-1)
    alone = repeats._twins(np.concatenate([pieces, data[at[-1] : at[-1] + 50]]), np.arange(0, len(pieces) + 50, 50), np.ones(len(at) + 1, bool))
    assert alone.sum() == 2 and alone[-1]


def test_whole_result_at_every_alignment(spark, monkeypatch):
    """Copies with all lengths beside the smallest gram, periodic texts, and lines whose runs are hot."""
    draw = np.random.default_rng(5)
    own = lambda n: bytes(draw.integers(97, 105, n, dtype=np.uint8))
    base, line = own(400), own(64)
    texts = [base] + [own(30) + base[k : k + 50 + k % 3] + own(30) for k in range(0, 340, 3)]
    texts += [b"ab" * 60, b"x" + b"ab" * 40, b"-" * 130, own(20) + b"-" * 70, own(9) + line + own(9)] + [own(25) + line + own(25) for _ in range(30)]
    want, seen = {}, {}
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if seen.get(t[a : a + 50], i) < i:
                gone[a : a + 50] = True
        for a in range(len(t) - 49):
            seen.setdefault(t[a : a + 50], i)
        want[i] = bytes(np.frombuffer(t, np.uint8)[~gone])
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    for hot, block in ((4096, 1 << 22), (3, 1 << 22), (3, 2000)):
        monkeypatch.setattr(repeats, "BLOCK", block)
        monkeypatch.setattr(repeats, "HOT", hot)
        got = {r.doc_id: bytes(r.kept) for r in repeats.cut_repeats(df).collect()}
        assert got == want, (hot, block)
