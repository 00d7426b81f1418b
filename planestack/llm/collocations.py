"""Phrases whose words belong together: hierarchical pair naming, from words to pairs of words to pairs of pairs.

Texts become blocks: sequences of codes into the block's own list of distinct words, per language. The lists are dealt out by a
hash, so that all blocks' counts of a word meet in one bucket; frequent words get an id there, which goes back to the blocks
that asked. The next level reads the sequences again: two adjacent frequent names are a pair, the pairs are counted and named in
the same way, and a name of k words is the pair of the names of its first and its last k - 1 words. A phrase that is frequent
enough has only frequent parts, so nothing else needs a name. The two ids are pointers to the parents: along them a phrase finds
the counts of each first and last part, and each shorter phrase the longer ones that hold it.

What moves is packed, a row for each block and for each block and bucket, and blocks hold each word or pair once. Buckets grow in
number with the input; a bucket holds a name at most once for each block. Names depend on the input alone.

Defined results: a null text is empty, a null language is `und`. Null, equal and repeated doc_ids don't matter; further columns are
left out. Bytes over 127 are part of words as they are.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planestack.llm import common

MAX_WORDS, LEAST, HELD, TOP = 3, 10, 50, 2000
#: Words after which a block ends; bytes of a text that are split at a time; words of input for each bucket.
BLOCK, CHUNK, BUCKET = 4 << 20, 1 << 20, 4 << 20
#: Parts that the phrases of a language are cut in before its best are picked.
PARTS = 64

_LEVEL = "block string, lang string, bucket int, tokens long, codes binary, left binary, right binary, counts binary"
_KINDS = ["block", "lang", "bucket", "tokens", "codes", "left", "right", "counts"]
#: A-Z as a-z, marks and line ends as `.`, a tab as a space.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def _pack(a) -> bytes:
    import numpy as np
    import zstandard

    a = np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(a.tobytes(), 3)


def _unpack(data: bytes):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(-1)


def _batch(rows: list):
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _KINDS)


def _words(docs: DataFrame, buckets: int) -> DataFrame:
    """Level 1: for each block its codes (bucket -1; 0 parts pieces), and its words and their counts for each bucket.

    Codes count from 1 in the order of the buckets' lists.
    """

    def split(batches: Iterator) -> Iterator:
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        part, numbers, held, size = TaskContext.get().partitionId(), count(), {}, 0

        def fresh():
            table = defaultdict()
            table.default_factory = table.__len__
            table[b"."]
            return table, []

        def flush(lang, table, codes):
            codes, words = np.concatenate(codes), list(table)[1:]
            of = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            rank = np.zeros(len(words) + 1, np.int64)
            rank[order + 1] = np.arange(1, len(words) + 1)
            counts, block = np.bincount(codes, minlength=len(words) + 1)[1:], f"{part}-{next(numbers)}"
            rows = [(block, lang, -1, int(counts.sum()), _pack(rank[codes]), None, None, None)]
            for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                rows.append((block, lang, int(of[own[0]]), None, None, zstandard.compress(b"\n".join([words[i] for i in own]), 3), None, _pack(counts[own])))
            return _batch(rows)

        for batch in common.slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text, at = (text or b"").translate(_BYTES), 0
                while at < len(text):
                    end = min((e for e in (text.find(b" ", at + CHUNK), text.find(b".", at + CHUNK)) if e >= 0), default=len(text))
                    table, codes = held.setdefault(lang, fresh())
                    found = text[at:end].replace(b".", b" . ").split()
                    if end == len(text):
                        found.append(b".")
                    codes.append(np.fromiter(map(table.__getitem__, found), np.int32, len(found)))
                    at, size = end, size + len(found)
                    if size >= BLOCK and end < len(text):  # within a text: the last piece, which goes on, moves to the next block
                        whole = np.concatenate(codes)
                        cut = len(whole) - int(np.argmax(whole[::-1] == 0)) if (whole == 0).any() else 0
                        if cut:
                            names = list(table)
                            yield flush(lang, table, [whole[:cut]])
                            held[lang] = table, codes = fresh()
                            codes.append(np.fromiter((table[names[c]] for c in whole[cut:].tolist()), np.int32, len(whole) - cut))
                            size -= cut
                if size >= BLOCK:
                    for own, (table, codes) in held.items():
                        yield flush(own, table, codes)
                    held, size = {}, 0
        for own, (table, codes) in held.items():
            yield flush(own, table, codes)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary")).mapInArrow(split, _LEVEL)


_NAMED = "block string, bucket int, names binary, id long, a long, b long, f long, lang string, word binary"


def _named(level: DataFrame, buckets: int, least: int, last: bool) -> DataFrame:
    """For each block and bucket the names of its list (0: not frequent), and a row for each frequent name (block null)."""

    def name(table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        bucket, langs = table.column("bucket")[0].as_py(), table.column("lang").to_pylist()
        counts = [_unpack(c) for c in table.column("counts").to_pylist()]
        edges = np.cumsum([0, *map(len, counts)])
        counts = np.concatenate(counts)
        right = table.column("right").to_pylist()
        words = lang_of = a = b = None
        if right[0] is None:
            keys = sorted({(la, w) for la, ws in zip(langs, table.column("left").to_pylist(), strict=True) for w in zstandard.decompress(ws).split(b"\n")})
            place = defaultdict(dict)
            for i, (la, w) in enumerate(keys):
                place[la][w] = i
            of = np.concatenate([np.fromiter(map(place[la].__getitem__, zstandard.decompress(ws).split(b"\n")), np.int64) for la, ws in zip(langs, table.column("left").to_pylist(), strict=True)])
            n = len(keys)
        else:
            pairs = np.stack([np.concatenate([_unpack(x) for x in table.column(c).to_pylist()]) for c in ("left", "right")])
            order = np.lexsort(pairs[::-1])
            pairs = pairs[:, order]
            new = np.concatenate([[True], (np.diff(pairs) != 0).any(axis=0)])
            of = np.empty(len(order), np.int64)
            of[order] = np.cumsum(new) - 1
            n, a, b = int(new.sum()), pairs[0, new], pairs[1, new]
        total = np.zeros(n, np.int64)
        np.add.at(total, of, counts)
        often = np.flatnonzero(total >= least)
        ids = np.zeros(n, np.int64)
        ids[often] = np.arange(1, len(often) + 1) * buckets + bucket
        blocks = table.column("block").to_pylist() if not last else []
        names = [_pack(ids[of[x:y]]) for x, y in zip(edges[:-1], edges[1:], strict=True)] if not last else []
        if a is None:
            lang_of, words = [keys[i][0] for i in often], [keys[i][1] for i in often]
        none, m, k = pa.nulls, len(blocks), len(often)
        longs = lambda x: pa.concat_arrays([none(m, pa.int64()), pa.array(x, pa.int64()) if x is not None else none(k, pa.int64())])
        return pa.table(
            {
                "block": pa.array(blocks + [None] * k, pa.string()), "bucket": pa.array([bucket] * (m + k), pa.int32()), "names": pa.array(names + [None] * k, pa.binary()),
                "id": longs(ids[often]), "a": longs(a[often] if a is not None else None), "b": longs(b[often] if b is not None else None), "f": longs(total[often]),
                "lang": pa.array([None] * m + (lang_of or [None] * k), pa.string()), "word": pa.array([None] * m + (words or [None] * k), pa.binary()),
            }
        )

    return level.filter("bucket >= 0").select("bucket", "block", "lang", "left", "right", "counts").groupBy("bucket").applyInArrow(name, _NAMED)


def _paired(level: DataFrame, named: DataFrame, buckets: int) -> DataFrame:
    """The next level: each block's codes as names, and adjacent names as pairs."""

    def pair(left, right):
        import numpy as np
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([_batch([])])
        codes = _unpack(left.column("codes")[0].as_py())
        names = np.concatenate([[0], *[_unpack(right.column("names")[int(i)].as_py()) for i in np.argsort(right.column("bucket").to_numpy())]])
        size, often = len(names), names[codes] != 0
        both = often[:-1] & often[1:]
        found, of, counts = np.unique(codes[:-1][both] * size + codes[1:][both], return_inverse=True, return_counts=True)
        a, b = names[found // size], names[found % size]
        mixed = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = ((mixed ^ mixed >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(1, len(found) + 1)
        whole = np.zeros(len(both), np.int64)
        whole[both] = rank[of]
        block, lang = left.column("block")[0].as_py(), left.column("lang")[0].as_py()
        rows = [(block, lang, -1, None, _pack(whole[(whole != 0) | np.append(True, whole[:-1] != 0)] if len(whole) else whole), None, None, None)]
        for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            rows.append((block, lang, int(bucket[own[0]]), None, None, _pack(a[own]), _pack(b[own]), _pack(counts[own])))
        return pa.Table.from_batches([_batch(rows)])

    left = level.filter("bucket < 0").select("block", "lang", "codes")
    right = named.filter("block IS NOT NULL").select("block", "bucket", "names")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(pair, _LEVEL)


def phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """Tables of the frequent phrases of 1 to max_words words, the words n of each language, and the paths of the tables made.

    id, lang, phrase (binary), a (its count), first, last (the counts of its first and last 1, 2, ... words), left, right (the ids
    of its first and last words but one).
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-size // (6 * BUCKET)))
    level, path = common.materialize(_words(docs, buckets), "phrases-words")
    totals, paths, tables = level.filter("bucket < 0").groupBy("lang").agg(F.sum("tokens").alias("n")), [path], []
    for k in range(1, max_words + 1):
        named, path = common.materialize(_named(level, buckets, least, k == max_words), "phrases-named")
        paths.append(path)
        found = named.filter("block IS NULL").select("id", "a", "b", F.col("f"), "lang", "word")
        if k == 1:
            table = found.select("id", "lang", F.col("word").alias("phrase"), F.col("f").alias("a"), F.array("f").alias("first"), F.array("f").alias("last"), F.col("word").alias("final"), F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))
        else:
            start = tables[-1].select(F.col("id").alias("a"), F.col("lang"), F.col("phrase").alias("head"), F.col("first").alias("firsts"))
            end = tables[-1].select(F.col("id").alias("b"), "final", F.col("last").alias("lasts"))
            joined = found.drop("lang", "word").join(start, "a").join(end, "b")
            table = joined.select("id", "lang", F.concat("head", F.lit(b" "), "final").alias("phrase"), F.col("f").alias("a"), F.concat("firsts", F.array("f")).alias("first"), F.concat("lasts", F.array("f")).alias("last"), "final", F.col("a").alias("left"), F.col("b").alias("right"))
        tables.append(table)
        if k < max_words:
            level, path = common.materialize(_paired(level, named, buckets), "phrases-pairs")
            paths.append(path)
    return tables, totals, paths


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly."""
    wide = lambda c: c.cast("decimal(18,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, top: int | None = TOP, max_words: int = MAX_WORDS, least: int = LEAST, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two words or more (all, if top is None).

    The lowest-scoring cut counts, ties to the shorter first part. A phrase goes if a longer one that holds it has at least `held`
    per cent of its count; it is enough to look at those with one word more, as what is longer still is in one of them.
    """
    tables, totals, _ = phrases(docs, max_words, least)
    rows = None
    for k in range(2, max_words + 1):
        cuts = [F.struct(score(F.col("a"), F.col("first")[i - 1], F.col("last")[k - i - 1]).alias("score"), F.lit(i).alias("k"), F.col("first")[i - 1].alias("l"), F.col("last")[k - i - 1].alias("r")) for i in range(1, k)]
        these = tables[k - 1].withColumn("cut", F.array_min(F.array(*cuts)))
        if k < max_words:
            longer = tables[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
            these = these.join(longer, "id", "left").filter(F.col("over").isNull() | (100 * F.col("over") < held * F.col("a")))
        these = these.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        rows = these if rows is None else rows.unionByName(these)
    best = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    if top is not None:
        parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        rows = parts.withColumn("rank", best("lang", "part")).filter(F.col("rank") <= top).drop("part")
    rows = rows.withColumn("rank", best("lang").cast("long"))
    rows = rows if top is None else rows.filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


OP11_SQL = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
sequences AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
said AS (
    SELECT lang, 1 AS m, unnest(w) AS p FROM sequences
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM sequences
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM sequences),
f AS (SELECT lang, m, p, count(*) AS f FROM said GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, p, f AS a, string_split(p, ' ') AS w FROM f WHERE m > 1 AND f >= {LEAST}),
ends AS (
    SELECT lang, m, p, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:m], ' ') AS tail
    FROM candidates, (SELECT unnest(range(1, {MAX_WORDS})) AS k) WHERE k < m),
cuts AS (
    SELECT e.lang, e.m, e.p, e.a, e.k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * e.a * e.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM ends e JOIN f x ON x.lang = e.lang AND x.p = e.head JOIN f y ON y.lang = e.lang AND y.p = e.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(w[1:2], ' ') AS p, a FROM candidates WHERE m = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE m = 3),
longer AS (SELECT lang, p, max(a) AS a FROM inside GROUP BY ALL),
kept AS (SELECT x.* FROM lowest x LEFT JOIN longer o ON o.lang = x.lang AND o.p = x.p WHERE o.a IS NULL OR 100 * o.a < {HELD} * x.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT lang, rank, p AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
