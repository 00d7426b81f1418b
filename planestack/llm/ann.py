"""Approximate nearest neighbours by inner product: an adaptive dimension scan over inverted lists.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, and a query gets 0 there: the nearest by
Euclidean distance are then those with the largest inner product. Vectors are dealt to the lists of the nearest centroid
(k-means on a bounded sample), and lists to blocks of bounded size. Both sides are turned by a random rotation, so that the
first columns of a difference foretell the rest: a query scans its lists in blocks of columns and, after each, drops the
candidates whose partial distance is so large that (by a test with error bound EPSILON) the whole can't be under the bound of
the k-th best. The bound comes from the query's nearest list, which is scanned first. Survivors get exact scores in double
precision on the original vectors.

Copies: of equal vectors only the k + 1 smallest ids can ever be among the nearest, and equal queries share one search, so a
vector that fills a third of the table costs no more than others.

Fitted on a sample: centroids, from SAMPLE vectors at most (the smallest hashes of ids). Every vector is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id.
Vectors of another length than the query's aren't candidates. Repeated ids with different vectors count as several candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planestack.llm import common

SAMPLE, STEPS = 16_384, 8
#: Lists at most, rows of a block (about), columns of a scan step, and the test's error bound.
LISTS, BLOCK, COLUMNS, EPSILON = 4096, 2048, 16, 2.1
#: Queries that meet a block in one task, about.
QUERIES = 4096
_FOUND = "query_id long, rank int, vec_id long, score double"
#: Part of the lists that a query probes, and lists at least.
PROBED, LEAST = 0.75, 12


def vectors(rows: DataFrame, id_column: str, column: str) -> DataFrame:
    """id, vec (little-endian doubles) of the vectors that take part."""
    v = F.col(column).cast("array<double>")
    sound = v.isNotNull() & F.col(id_column).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(sound)

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            v = batch.column("v")
            flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False) + 0.0, "<f8").tobytes()  # a negative zero is a zero
            ends = np.cumsum([0, *v.value_lengths().to_pylist()]) * 8
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "vec": pa.array([flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())})

    return rows.mapInArrow(pack, "id long, vec binary")


def _centroids(vecs: DataFrame, most: float, lists: int):
    import numpy as np

    sample = np.array([np.frombuffer(r["vec"], "<f8") for r in vecs.select("vec", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    sample = _longer(sample, most)
    draw = np.random.default_rng(7)
    lists = min(lists, len(sample))
    c = sample[draw.choice(len(sample), lists, replace=False)]
    for _ in range(STEPS):
        of = np.argmin((c * c).sum(1)[None] - 2 * sample @ c.T, axis=1)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _longer(x, most: float):
    import numpy as np

    return np.hstack([x, np.sqrt(np.maximum(0, most * most - (x * x).sum(1)))[:, None]])


def _scan(x, ids, q, bound: float, k: int, turned_x, turned_q, order):
    """(id, score) of the best k of x for one query, by the adaptive scan; bound: a squared distance that the k-th best has or beats."""
    import numpy as np

    wide = turned_x.shape[1]
    alive = order
    partial = np.zeros(len(alive), np.float32)
    for at in range(0, wide, COLUMNS):
        part = turned_x[alive, at : at + COLUMNS] - turned_q[at : at + COLUMNS]
        partial += np.einsum("ij,ij->i", part, part)
        done = min(wide, at + COLUMNS)
        if np.isfinite(bound):
            if done < wide:
                fits = partial <= bound * (done / wide) * (1 + EPSILON / np.sqrt(done)) ** 2 + 1e-6
            else:
                fits = partial <= bound * (1 + 1e-4) + 1e-5
            alive, partial = alive[fits], partial[fits]
        if not len(alive):
            return []
    if len(alive) > k:
        kth = np.partition(partial, k - 1)[k - 1]
        alive = alive[partial <= kth * (1 + 1e-4) + 1e-5]
    score = (x[alive] * q).sum(axis=1)
    best = np.lexsort((ids[alive], -score))[:k]
    return [(int(ids[alive[i]]), float(score[i])) for i in best]


def _search(index: DataFrame, asked: DataFrame, k: int, most: float, rotation, chunks: int = 1) -> DataFrame:
    """query, id, score: the best k of each block for each query that asks it.

    Queries are dealt into chunks, and each block meets each chunk for itself, so that a task holds a block and a chunk.
    """
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query", F.lit(3)), F.lit(chunks)).cast("int"))
    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))) if chunks > 1 else index.withColumn("chunk", F.lit(0))

    def scan(left, right):
        import numpy as np
        import pyarrow as pa

        out = ([], [], [])
        if left.num_rows and right.num_rows:
            x = np.array([np.frombuffer(v, "<f8") for v in left.column("vec").to_pylist()])
            ids = left.column("id").to_numpy()
            q = np.array([np.frombuffer(v, "<f8") for v in right.column("vec").to_pylist()])
            turned_x = (_longer(x, most) @ rotation).astype(np.float32)
            turned_q = (np.hstack([q, np.zeros((len(q), 1))]) @ rotation).astype(np.float32)
            everyone = np.arange(len(x))
            norms = (q * q).sum(1)
            for i, (query, kth) in enumerate(zip(right.column("query").to_pylist(), right.column("kth").to_pylist(), strict=True)):
                bound = np.inf if kth is None else max(0.0, norms[i] + most * most - 2 * kth)
                for of, score in _scan(x, ids, q[i], bound, k, turned_x, turned_q[i], everyone):
                    out[0].append(query)
                    out[1].append(of)
                    out[2].append(score)
        return pa.table({"query": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return index.groupBy("list", "block", "chunk").cogroup(asked.groupBy("list", "block", "chunk")).applyInArrow(scan, "query long, id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def nearest(rows: DataFrame, k: int, is_query, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which is_query(id column) holds, among all other rows.

    An inner product needs vectors of one length, so each length is searched for itself (their number comes to the driver).
    """
    every, _ = common.materialize(vectors(rows, id_column, column), "vectors")
    found = None
    for r in every.select(F.octet_length("vec").alias("n")).distinct().orderBy("n").collect():
        own = _nearest(every.filter(F.octet_length("vec") == r["n"]), k, is_query)
        found = own if found is None else found.unionByName(own)
    return found if found is not None else rows.sparkSession.createDataFrame([], _FOUND)


def _nearest(every: DataFrame, k: int, is_query) -> DataFrame:
    """nearest() for vectors (id, vec) of one length."""
    import numpy as np

    copies = Window.partitionBy("vec").orderBy("id")
    few = every.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).drop("copy")
    few, _ = common.materialize(few, "distinct")
    first = few.limit(1).collect()
    if not first:
        return every.sparkSession.createDataFrame([], _FOUND)
    wide = len(first[0]["vec"]) // 8
    queries = every.filter(is_query(F.col("id")))
    searched = queries.groupBy("vec").agg(F.min("id").alias("query"))
    chunks = max(1, -(-searched.count() // QUERIES))

    def norms(batches: Iterator) -> Iterator:
        import pyarrow as pa

        top = 0.0
        for batch in batches:
            for v in batch.column("vec").to_pylist():
                a = np.frombuffer(v, "<f8")
                top = max(top, float(a @ a))
        yield pa.RecordBatch.from_pydict({"top": [top]})

    most = float(np.sqrt(few.select("vec").mapInArrow(norms, "top double").agg(F.max("top")).first()[0])) * (1 + 1e-9)
    n = few.count()
    centroids = _centroids(few, most, max(1, min(LISTS, int(np.sqrt(n) / 2))))
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((wide + 1, wide + 1)))[0]
    lists, squares = len(centroids), (centroids * centroids).sum(1)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in common.slices(batches, 2048):
            x = _longer(np.array([np.frombuffer(v, "<f8") for v in batch.column("vec").to_pylist()]), most)
            of = np.argmin(squares[None] - 2 * x @ centroids.T, axis=1)
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "vec": batch.column("vec"), "list": pa.array(of, pa.int32())})

    index, _ = common.materialize(few.mapInArrow(assign, "id long, vec binary, list int"), "lists")
    # At most LISTS rows, one count each.
    sizes = np.zeros(lists, np.int64)
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK))
    many = F.element_at(F.lit(blocks.tolist()).cast("array<long>"), F.col("list") + 1)
    index = index.withColumn("block", F.pmod(F.xxhash64("id"), many).cast("int"))
    probed = min(lists, max(LEAST, int(np.ceil(PROBED * lists))))

    def probe(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in common.slices(batches, 512):
            q = np.array([np.frombuffer(v, "<f8") for v in batch.column("vec").to_pylist()])
            order = np.argsort(squares[None] - 2 * q @ centroids[:, :-1].T, axis=1, kind="stable")
            out = ([], [], [], [], [])
            for i, (query, vec) in enumerate(zip(batch.column("query").to_pylist(), batch.column("vec").to_pylist(), strict=True)):
                held = np.cumsum(sizes[order[i]])
                # The lists that are probed hold several times k rows, unless all together don't.
                take = max(probed, int(np.searchsorted(held, 5 * (k + 1))) + 1)
                for nth, c in enumerate(order[i, :take].tolist()):
                    for b in range(int(blocks[c])):
                        for column, value in zip(out, (query, vec, nth, c, b), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["query", "vec", "nth", "list", "block"])

    asked = searched.mapInArrow(probe, "query long, vec binary, nth int, list int, block int")
    start, _ = common.materialize(_best(_search(index, asked.filter("nth = 0").withColumn("kth", F.lit(None).cast("double")), k + 1, most, rotation, chunks), k + 1), "nearest")
    bound = start.groupBy("query").agg(F.min(F.when(F.col("rank") == k + 1, F.col("score"))).alias("kth"))
    rest = asked.filter("nth > 0").join(bound, "query", "left")
    found = _best(start.drop("rank").unionByName(_search(index, rest, k + 1, most, rotation, chunks)), k + 1)
    # Each query row takes the result of its vector, without itself.
    own = queries.join(searched, "vec").select(F.col("id").alias("query_id"), "query")
    result = own.join(found.select("query", F.col("id").alias("vec_id"), "score"), "query").filter(F.col("vec_id") != F.col("query_id"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return result.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, 20, lambda i: i % 20 == 0)
