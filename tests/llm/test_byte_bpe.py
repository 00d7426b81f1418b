"""Byte-level BPE against each match of the pattern, encoded for itself; exact round trips."""

import hashlib
import random

import regex

from planestack.llm import byte_bpe

SCHEMA = "doc_id long, text string, ids string, decoded int"


def plain(model, text):
    return [i for m in regex.findall(byte_bpe.default_pattern(), text) for i in model._encode_single_piece(m)]


def test_pieces_give_the_ids_of_the_whole():
    model, draw = byte_bpe.load(byte_bpe.ranks_path(), byte_bpe.default_pattern()), random.Random(5)
    for _ in range(3_000):
        text = "".join(draw.choice("ab'sdtlve019  \n\t\r.,!?-。一é \x1c\x85 \U0001f600") for _ in range(draw.randint(0, 70)))
        cut = [i for whole, p in byte_bpe.pieces(text, draw.randint(1, 9), draw.randint(1, 5)) for i in (model._encode_single_piece(p) if whole else model.encode_ordinary(p))]
        assert cut == model.encode_ordinary(text)
        assert "".join(p for _, p in byte_bpe.pieces(text, 7, 3)) == text


def test_rows(spark):
    texts = [None, "", " ", "It's 12 words!  \n\n x", "一" * 50_000, "word, " * 100_000, "a" * 200_000, " " * 1_200_000 + "x", "x" + "\n" * 1_200_000, "<|endoftext|>", "é \U0001f600 \x00"]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[3], "clash", 1), (None, "no id", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.decoded), r.ids) for r in byte_bpe.decode(byte_bpe.encode(df)).collect())
    model = byte_bpe.load(byte_bpe.ranks_path(), byte_bpe.default_pattern())
    want = sorted((i is not None, i or 0, (t or "").encode(), plain(model, t or "")) for i, t, _, _ in rows)
    assert got == want
    assert byte_bpe.decode(byte_bpe.encode(df.limit(0))).collect() == []


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    model = byte_bpe.load(byte_bpe.ranks_path(), byte_bpe.default_pattern())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(model.decode_bytes(ids))) for r in docs for ids in [plain(model, r.text or "")])
    assert sorted(map(tuple, byte_bpe.op12_byte_bpe(spark, sf).collect())) == want
