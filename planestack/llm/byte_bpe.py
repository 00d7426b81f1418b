"""Byte-level byte-pair encoding and decoding with a rank file that lies on every machine.

Each task loads the ranks once and encodes whole texts; nothing is shuffled. A long text is cut at boundaries that no match of
the pattern crosses, so that the pieces give the ids of the whole and a task never holds the ids of more than one piece as
Python objects. The library's matcher runs out of stack on a very long run of white space; such a run is encoded as the
matches it consists of. Decoding joins the bytes of the ids' tokens and never passes through text.

Defined results: a null or empty text has no ids and decodes to no bytes. Null and repeated doc_ids are kept row by row;
further columns are left out. Bytes that aren't UTF-8 count as the replacement character.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.llm import common

#: Characters after which a text is cut at the next safe boundary; white space runs of this length are matched here.
PIECE, RUN = 1 << 17, 1 << 14

#: Unicode's White_Space, as the pattern's \s has it.
SPACE = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and digits, and marks that are neither, of every Unicode version: no match goes on from the first to the second.
LETTERS, MARKS = "A-Za-z0-9\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", ".,;:!?\u3001\u3002\uff0c\uff01\uff1f"


def ranks_path() -> str:
    """The default rank file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load(path: str, pattern: str):
    """The library's encoding for the ranks of a local file, without special tokens."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE, run: int = RUN) -> Iterator[tuple[bool, str]]:
    """(whether the piece is one match, piece): the text in pieces that are matched as they are within the whole.

    Cuts lie between a character that isn't white space and one that is, or between a letter and a mark. A white space run of
    `run` or more is one match up to its last character, which belongs to what follows; at the end of the text the whole run is.
    """
    import re

    cut = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{LETTERS}])(?=[{MARKS}])")
    spaces = re.compile(f"[{SPACE}]{{{run},}}")

    def parts(a: int, b: int) -> Iterator[tuple[bool, str]]:
        while b - a > size:
            found = cut.search(text, a + size, b)
            if not found or found.end() >= b:
                break
            yield False, text[a : found.end()]
            a = found.end()
        if a < b:
            yield False, text[a:b]

    at = 0
    if len(text) >= run:
        for found in spaces.finditer(text):
            end = found.end() if found.end() == len(text) else found.end() - 1
            yield from parts(at, found.start())
            if end > found.start():
                yield True, text[found.start() : end]
            at = end
    yield from parts(at, len(text))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int): each match of the pattern is encoded for itself."""
    path, pattern = path or ranks_path(), pattern or default_pattern()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        model = load(path, pattern)
        for batch in common.slices(batches):
            flat, ends = [], [0]
            for text in batch.column("text").to_pylist():
                n = 0
                for whole, piece in pieces((text or b"").decode("utf-8", "replace")):
                    found = model._encode_single_piece(piece) if whole else model.encode_ordinary(piece)
                    flat.append(np.array(found, np.int32))
                    n += len(found)
                ends.append(ends[-1] + n)
            ids = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (binary): the bytes of the ids' tokens, one after the other."""
    path = path or ranks_path()

    def run(batches: Iterator) -> Iterator:
        import base64

        import numpy as np
        import pyarrow as pa

        tokens = {}
        with open(path, "rb") as lines:
            for token, rank in map(bytes.split, lines):
                tokens[int(rank)] = base64.b64decode(token)
        table = [tokens.get(i) for i in range(max(tokens) + 1)]
        for batch in common.slices(batches):
            lists = batch.column("ids")
            flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
            said = [b"".join(map(table.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(said, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digest(ids: Column) -> Column:
    """sha256 of decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decode(encode(common.documents(spark, sf_dir)))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
