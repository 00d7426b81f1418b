"""Byte-pair encoding and decoding through a table of distinct words.

Texts are split at ASCII white space, which no token of the vocabulary crosses. Blocks of documents keep their words as codes
into a list of the block's distinct words. The lists are dealt out by a hash of the word, so that each distinct word of the
whole table lies in one bucket and is encoded there once; the ids return to the blocks that asked, and the codes put them in
place position by position. Decoding looks each id up in the id-to-piece table, whose size is fixed by the vocabulary.

What moves between tasks is packed (code planes and word lists, compressed), a row for each block or for each block and
bucket. Memory follows the size of a block or bucket; both are bounded, as the number of buckets grows with the input. One
document is the least a block can hold.

Defined results: a null or empty text, or one of white space only, has no ids and decodes to the empty text. Null and repeated
doc_ids are kept row by row; further columns are left out.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.llm import common

#: Bytes of text after which a block ends; bytes of text for each bucket of words.
BLOCK, BUCKET = 4 << 20, 8 << 20


def vocabulary_path() -> str:
    """The default vocabulary file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pack(a) -> bytes:
    """An array of unsigned numbers as compressed byte planes."""
    import numpy as np
    import zstandard

    a = np.ascontiguousarray(a, "<u4")
    planes = a.view(np.uint8).reshape(-1, 4).T
    used = max([k + 1 for k in range(4) if planes[k].any()], default=1)
    return bytes([used]) + zstandard.compress(planes[:used].tobytes(), 3)


def _unpack(data: bytes):
    import numpy as np
    import zstandard

    used, raw = data[0], zstandard.decompress(data[1:])
    a = np.zeros((len(raw) // used, 4), np.uint8)
    a[:, :used] = np.frombuffer(raw, np.uint8).reshape(used, -1).T
    return a.reshape(-1).view("<u4")


_BLOCKS = "block string, bucket int, doc_ids array<long>, counts binary, codes binary, buckets binary, words binary"


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """For each block: a row with its documents' codes (bucket -1), and a row with its words for each bucket that has some."""

    def split(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard
        from pyspark import TaskContext

        part, numbers = TaskContext.get().partitionId(), count()
        names = ["block", "bucket", "doc_ids", "counts", "codes", "buckets", "words"]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

        def flush(ids, counts, codes, table, content):
            codes, words = np.array(codes, np.int64), list(table)
            often = np.bincount(codes, minlength=len(words))
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            words = [words[i] for i in order]
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            block = f"{part}-{next(numbers)}-{content.hexdigest()}"
            rows = [(block, -1, ids, _pack(np.array(counts)), _pack(rank[codes]), _pack(of), None)]
            by = np.argsort(of, kind="stable")
            edges = np.flatnonzero(np.diff(of[by])) + 1
            for own in np.split(by, edges) if len(by) else []:
                rows.append((block, int(of[own[0]]), None, None, None, None, zstandard.compress(b"\n".join([words[i] for i in own]), 3)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        def fresh():
            table = defaultdict()
            table.default_factory = count().__next__
            return [], [], [], table, xxhash.xxh3_128()

        ids, counts, codes, table, content = fresh()
        size = 0
        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (text or b"").split()
                content.update(b"%d %d " % (len(text or b""), doc_id or 0))
                content.update(text or b"")
                codes.extend(map(table.__getitem__, words))
                ids.append(doc_id)
                counts.append(len(words))
                size += len(text or b"")
                if size >= BLOCK:
                    yield flush(ids, counts, codes, table, content)
                    ids, counts, codes, table, content = fresh()
                    size = 0
        if ids:
            yield flush(ids, counts, codes, table, content)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(split, _BLOCKS)


def _encoded(blocks: DataFrame, path: str) -> DataFrame:
    """block, bucket, lengths and ids (packed) of each block's words in the order of its list; each word is encoded once."""
    held: dict = {}  # the model, once for all groups of a task

    def encode(table):
        import os

        import numpy as np
        import pyarrow as pa
        import zstandard

        if not held:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            held["model"] = Tokenizer.from_file(path)
        model = held["model"]
        lists = [zstandard.decompress(w).split(b"\n") for w in table.column("words").to_pylist()]
        words = list({w for own in lists for w in own})
        lengths, ids = [], []
        for at in range(0, len(words), 4096):
            for e in model.encode_batch([w.decode("utf-8", "replace") for w in words[at : at + 4096]], add_special_tokens=False):
                lengths.append(len(e.ids))
                ids.extend(e.ids)
        lengths, ids = np.array(lengths, np.int64), np.array(ids, np.int64)
        starts = np.cumsum(lengths) - lengths
        place = {w: i for i, w in enumerate(words)}
        out = []
        for own in lists:
            at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
            out.append((_pack(lengths[at]), _pack(ids[_ragged(starts[at], lengths[at])])))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "lengths": [a for a, _ in out], "ids": [b for _, b in out]})

    return blocks.filter("bucket >= 0").select("block", "bucket", "words").groupBy("bucket").applyInArrow(encode, "block string, bucket int, lengths binary, ids binary")


def _ragged(starts, lengths):
    """Indices of the pieces [start, start + length), one after the other."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (the ids' pieces with a space between).

    The texts are split twice, for the words and for the codes, which takes less than keeping both. Blocks are therefore named
    by partition, number and a hash of their ids and texts: docs must give the same partitions each time it is read, as a scan
    of files does. If it doesn't, names don't meet and the job fails; ids never reach another document.
    """
    path = path or vocabulary_path()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = _blocks(docs, max(16, -(-size // BUCKET)))
    encoded = _encoded(blocks, path)
    held: dict = {}  # the id-to-piece table, once for all groups of a task

    def place(left, right):
        import numpy as np
        import pyarrow as pa

        if not held:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            held["pieces"] = np.array([(model.id_to_token(i) or "") for i in range(model.get_vocab_size(with_added_tokens=True))], object)
        pieces = held["pieces"]
        if not left.num_rows:
            raise ValueError("the rows of docs came in another order when they were read again")
        of = _unpack(left.column("buckets")[0].as_py()).astype(np.int64)
        lengths, flat = [], []
        for i in np.argsort(right.column("bucket").to_numpy()):
            lengths.append(_unpack(right.column("lengths")[int(i)].as_py()))
            flat.append(_unpack(right.column("ids")[int(i)].as_py()))
        own = np.argsort(of, kind="stable")
        if sum(map(len, lengths)) != len(of):
            raise ValueError("the rows of docs came in another order when they were read again")
        by_bucket = np.concatenate(lengths).astype(np.int64) if lengths else np.empty(0, np.int64)
        flat = np.concatenate(flat) if flat else np.empty(0, np.uint32)
        length, start = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
        length[own], start[own] = by_bucket, np.cumsum(by_bucket) - by_bucket
        said = pieces[flat]
        decoded = [" ".join(said[a : a + n]) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
        codes, counts = _unpack(left.column("codes")[0].as_py()).astype(np.int64), _unpack(left.column("counts")[0].as_py()).astype(np.int64)
        doc_ids = left.column("doc_ids")[0].as_py()
        n_tokens, ids, texts, at = [], [], [], 0
        for n in counts.tolist():
            mine = codes[at : at + n]
            at += n
            found = flat[_ragged(start[mine], length[mine])]
            n_tokens.append(len(found))
            ids.append(found.astype("<u4").tobytes())
            texts.append(" ".join(filter(None, map(decoded.__getitem__, mine.tolist()))))
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n_tokens, pa.int64()), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())})

    left = blocks.filter("bucket < 0").select("block", "doc_ids", "counts", "codes", "buckets")
    return left.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(place, "doc_id long, n_tokens long, ids binary, decoded string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode_decode(common.documents(spark, sf_dir))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
