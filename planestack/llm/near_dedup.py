"""Near-duplicate documents: MinHash bands find candidates, odd sketches screen them, full shingle sets confirm them.

1. One pass over the texts gives each document its set of shingles of WORDS words (64-bit hashes), 128 MinHash samples, 32 band
   keys of 4 samples each, and an odd sketch: the samples are hashed into 512 bits whose parity is kept, so that the number of
   differing bits of two sketches tells how many samples differ. Documents with the same set are one class, which stands under
   its smallest id; classes that share an id are linked.
2. Each band bucket has a star: the member that meets most others over all its buckets is the centre, every other member its
   candidate. A pair goes on if its sketches differ in few enough bits.
3. Pairs between different components are confirmed on full sets, most similar first: one pair for each two components, then
   8, 64 and so on, until none is left between different components. Members of a component need no more pairs.
4. In buckets that still hold several components, members that can have no partner there are left out: of the shingles of a
   set, only those that another open set has too can be common ones, and if these are too few for any partner of the least size
   in the bucket, there is none. What is left of a bucket is compared inside its task: sketches first, then full sets, each link
   joining two components, so that fewer links than members leave the task.
5. Buckets too large for a task are banded again, with longer bands of fresh hash functions (8 samples, then 16; each member
   has a fixed number of keys, and dissimilar ones part), and go through 4 again. At the last level all are compared.

Rows and bytes thus grow with the members of a bucket, not with their pairs. A pair with a similarity of 0.8 shares no band
with a probability of 5e-8 (1e-7 for the longer bands) and fails the screen with less than 1e-8. Nothing is capped.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing. Null doc_ids are
linked with nothing, have a null component and are kept. Rows with the same id count as one document, whose links are those of
all its rows. Further columns are left out (near_duplicates) or kept (deduplicate).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.llm import common
from planestack.operators.graph import components

#: Words of a shingle, unless an argument says otherwise.
WORDS = 5
#: Links need PART * intersection >= LEAST * union.
PART, LEAST = 100, 80
BANDS, ROWS, BITS = 32, 4, 512
#: Differing sketch bits up to which a pair is looked at: six deviations above the mean at similarity 0.8.
MOST_BITS = 96
#: Members of a bucket that a task compares; one with a long set counts once for each LONG shingles.
BLOCK, LONG = 4096, 1024
#: Samples of a longer band and number of bands, by level.
LONGER = [(8, 88), (16, 568)]
#: Shingles of a group in which shared ones are counted, about.
COUNTED = 1 << 20
#: Bits of the filter that spares documents without a candidate the second pass; beyond its capacity it only spares fewer.
FILTER_BITS = 1 << 23
#: Bytes of text that are hashed at once.
CHUNK = 1 << 19


class Shingles:
    """Sets of shingle hashes of UTF-8 texts, many texts at a time."""

    def __init__(self, words: int = WORDS) -> None:
        import numpy as np

        draw = np.random.default_rng(20_240_601)
        self.words = words
        self.of_byte = draw.integers(1, 1 << 63, 256, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self.base = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.factors = draw.integers(1, 1 << 63, words, np.uint64) | np.uint64(1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    @staticmethod
    def mix(h):
        import numpy as np

        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    @staticmethod
    def _stretches(texts: list[bytes]):
        """Lists of (text number, part) of about CHUNK bytes; texts are cut at white space only."""
        held, size = [], 0
        for number, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = len(text)
                if end - at > CHUNK:
                    end = max(text.rfind(c, at, at + CHUNK) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) + 1
                    if end <= at:  # one word of more than CHUNK bytes
                        found = [i for i in (text.find(c, at) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if i >= 0]
                        end = min(found) + 1 if found else len(text)
                held.append((number, text[at:end]))
                size += end - at
                at = end
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
        if held:
            yield held

    def _hashed(self, group: list[tuple[int, bytes]]):
        """Word hashes of a stretch, and (text number, count of words) of its parts."""
        import numpy as np

        joined = b" ".join([t.lower() for _, t in group]) + b" "
        data = np.frombuffer(joined, np.uint8)
        if len(self.powers) < len(data):
            n = max(len(data), CHUNK + (CHUNK >> 1))
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(n, self.base)))
            self.inverses = np.cumprod(np.append(np.uint64(1), np.full(n, self.inverse)))
        blank = self.space[data]
        edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.cumsum(np.append(np.uint64(0), self.of_byte[data] * self.powers[: len(data)]))
        words = self.mix((sums[ends] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for _, t in group]))
        return words, list(zip((i for i, _ in group), np.diff(stops, prepend=0).tolist(), strict=True))

    def __call__(self, texts: list[bytes]) -> list:
        """A sorted array of distinct hashes for each text."""
        import numpy as np

        parts, counts = [], []
        for group in self._stretches(texts):
            words, n = self._hashed(group)
            parts.append(words)
            counts.append(n)
        words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        # A long text lies in several stretches: (text number, words) of each add up.
        total = np.zeros(len(texts), np.int64)
        for number, n in (c for own in counts for c in own):
            total[number] += n
        lasts = np.cumsum(total)
        firsts = lasts - total
        k = self.words
        full = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            full += words[i : i + len(full)] * self.factors[i]
        full = self.mix(full)
        out = []
        for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
            if b - a >= k:
                own = np.sort(full[a : b - k + 1])
                out.append(own[np.append(True, own[1:] != own[:-1])])
            elif b > a:
                out.append(self.mix(np.sum(words[a:b] * self.factors[: b - a], keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        return out


def _chunks(batches: Iterator, words: int, wanted=None) -> Iterator:
    """(ids, sets) of documents, about CHUNK bytes at a time; wanted: which ids."""
    shingles = Shingles(words)
    for batch in common.slices(batches):
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if wanted is not None and not wanted(doc_id):
                continue
            ids.append(doc_id)
            texts.append(text or b"")
            size += len(texts[-1])
            if size >= CHUNK:
                yield ids, shingles(texts)
                ids, texts, size = [], [], 0
        if ids:
            yield ids, shingles(texts)


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (which stand for the set), bands, sketch of every row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        draw = np.random.default_rng(3)
        n = BANDS * ROWS
        a, b = draw.integers(1, 1 << 63, (n, 1), np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, (n, 1), np.uint64)
        weights, mix = draw.integers(1, 1 << 63, (1, ROWS), np.uint64) | np.uint64(1), Shingles.mix
        salt = np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        band_salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for ids, sets in _chunks(batches, words):
            counts, k1, k2, bands, odd = [], [], [], [], []
            for own in sets:
                counts.append(len(own))
                k1.append(_name(own))
                k2.append(int(np.sum(mix(own ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).view(np.int64)))
                if not len(own):
                    bands.append([])
                    odd.append(b"")
                    continue
                least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(own), 1024):
                    least = np.minimum(least, (a * own[None, at : at + 1024] + b).min(axis=1))
                keys = mix((least.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64) + band_salt)
                bands.append(keys.view(np.int64))
                parity = np.bincount((mix(least + salt) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                odd.append(np.packbits(parity.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(counts, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "sketch": pa.array(odd, pa.binary())})

    return _raw(docs).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch binary")


def _differing(pairs: DataFrame) -> DataFrame:
    """a, b, bits of the pairs (a, b, sa, sb) that pass the screen."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        wide = BITS // 64
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint64).reshape(-1, wide)
            y = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint64).reshape(-1, wide)
            bits = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array(bits <= MOST_BITS)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "bits": pa.array(bits, pa.int64())}).filter(keep)

    return pairs.mapInArrow(run, "a long, b long, bits long")


def _screened(pairs: DataFrame, odd: DataFrame) -> DataFrame:
    of = lambda c: odd.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"s{c}"))
    return _differing(pairs.join(of("a"), "a").join(of("b"), "b"))


def _filter(ids: DataFrame):
    """A bitmap of FILTER_BITS for the hashes of the ids (eight of them meet on the driver, compressed, as most are sparse)."""
    import zlib

    import numpy as np

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[(Shingles.mix(batch.column("id").to_numpy().view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in ids.repartition(8).mapInArrow(fill, "bits binary").collect():
        bits |= np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return bits


def _name(own) -> int:
    """A hash that stands for a set of shingle hashes."""
    import numpy as np

    return int(np.sum(Shingles.mix(own + np.uint64(1)), dtype=np.uint64).view(np.int64))


def _per_set(docs: DataFrame, words: int, ids: DataFrame, make, schema: str) -> DataFrame:
    """What make(doc_ids, sets) yields over the documents with these ids (column id), and perhaps some more."""
    import numpy as np

    bits = docs.sparkSession.sparkContext.broadcast(_filter(ids))

    def run(batches: Iterator) -> Iterator:
        held = bits.value

        def wanted(doc_id):
            if doc_id is None:
                return False
            at = int(Shingles.mix(np.array([doc_id], np.int64).view(np.uint64))[0]) % FILTER_BITS
            return held[at >> 3] >> (7 - (at & 7)) & 1

        for found_ids, found in _chunks(batches, words, wanted):
            yield from make(found_ids, found)

    return _raw(docs).mapInArrow(run, schema)


def _sets(docs: DataFrame, words: int, ids: DataFrame) -> DataFrame:
    """doc_id, k1, set (sorted 64-bit hashes) of the documents with these ids, and perhaps some more."""

    def make(found_ids, found):
        import pyarrow as pa

        found_ids, found = [i for i, s in zip(found_ids, found, strict=True) if len(s)], [s for s in found if len(s)]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(found_ids, pa.int64()), "k1": pa.array([_name(s) for s in found], pa.int64()), "set": pa.array([s.tobytes() for s in found], pa.binary())})

    return _per_set(docs, words, ids, make, "doc_id long, k1 long, set binary")


def confirmed(docs: DataFrame, words: int, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    import numpy as np

    every = _sets(docs, words, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in common.slices(batches):
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y)
                if PART * min(len(x), len(y)) < LEAST * max(len(x), len(y)):
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(PART * shared >= LEAST * (both - shared))
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    of = lambda c: every.select(F.col("doc_id").alias(c), F.col("set").alias(f"x{c}"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(compare, "a long, b long").distinct()


def _label(rows: DataFrame, roots: DataFrame | None, column: str, label: str) -> DataFrame:
    """rows with the component (label) of the class in a column."""
    if roots is None:
        return rows.withColumn(label, F.col(column))
    of = roots.select(F.col("node").alias(column), F.col("root").alias(label))
    return rows.join(of, column, "left").withColumn(label, F.coalesce(label, column))


def _contracted(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, root) after links (a, b) between classes or roots."""
    links = _label(_label(links, roots, "a", "la"), roots, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    merged = components(links)
    if roots is None:
        return merged
    step = merged.select(F.col("node").alias("root"), F.col("root").alias("next"))
    old = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return common.materialize(old.union(merged.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")[0]


def _joined(docs: DataFrame, words: int, candidates: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """Components (node, root) after all candidates (a, b, bits) between different components have been confirmed or refused."""
    from pyspark.sql import Window

    many, spent = 1, []
    while True:
        open_pairs = _label(_label(candidates, roots, "a", "la"), roots, "b", "lb").filter("la <> lb")
        ends = [F.least("la", "lb"), F.greatest("la", "lb")]
        ranked = open_pairs.withColumn("nth", F.row_number().over(Window.partitionBy(*ends).orderBy("bits", "a", "b")))
        ranked, at = common.materialize(ranked.select("a", "b", "bits", (F.col("nth") <= many).alias("now")), "open")
        spent.append(at)
        now = ranked.filter("now")
        if now.isEmpty():
            for path in spent:
                common.drop(docs.sparkSession, path)
            return roots
        roots = _contracted(roots, confirmed(docs, words, now))
        candidates = ranked.filter("NOT now").select("a", "b", "bits")
        many *= 8


def _shared(docs: DataFrame, words: int, ids: DataFrame, groups: int) -> DataFrame:
    """k1, shared: how many shingles of a set other sets among the documents with these ids have too (or more, never less).

    A shingle that several sets of a chunk have is counted there and goes on once, so a very common one costs a number for each
    chunk. Others are dealt out by their hash, packed.
    """

    def send(_, found):
        import numpy as np
        import pyarrow as pa

        names, first = np.unique(np.array([_name(s) for s in found if len(s)], np.int64), return_index=True)
        found = [s for s in found if len(s)]
        sizes = np.array([len(found[i]) for i in first], np.int64)
        if not sizes.sum():
            return
        every, of = np.concatenate([found[i] for i in first]), np.repeat(np.arange(len(names)), sizes)
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        fresh = np.append(True, every[1:] != every[:-1])
        several = np.diff(np.append(np.flatnonzero(fresh), len(every)))[np.cumsum(fresh) - 1] > 1
        rows = [(-1, np.bincount(of[several], minlength=len(names)).astype(np.int64).tobytes(), names.tobytes())]
        keep = fresh  # once for each shingle; 0 as the name of those that several sets have
        every, owner = every[keep], np.where(several[keep], 0, names[of[keep]])
        group = (Shingles.mix(every) % np.uint64(groups)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(group[by])) + 1):
            rows.append((int(group[own[0]]), every[own].tobytes(), owner[own].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["at", "values", "names"])

    def counted(table):
        import numpy as np
        import pyarrow as pa

        every = np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint64)
        owner = np.frombuffer(b"".join(table.column("names").to_pylist()), np.int64)
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        # Several owners, or one that stands for several.
        some = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) | (np.add.reduceat((owner == 0).astype(np.int64), first) > 0)
        hit = np.repeat(some, np.diff(np.append(first, len(every)))) & (owner != 0)
        names, n = np.unique(owner[hit], return_counts=True)
        return pa.table({"k1": pa.array(names, pa.int64()), "n": pa.array(n, pa.int64())})

    def local(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for n, names in zip(batch.column("values").to_pylist(), batch.column("names").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(names, np.int64)), pa.array(np.frombuffer(n, np.int64))], ["k1", "n"])

    sent = _per_set(docs, words, ids, send, "at int, values binary, names binary")
    sent, _ = common.materialize(sent, "shared")
    dealt = sent.filter("at >= 0").groupBy("at").applyInArrow(counted, "k1 long, n long")
    return dealt.union(sent.filter("at < 0").mapInArrow(local, "k1 long, n long")).groupBy("k1").agg(F.sum("n").alias("shared"))


def _longer_bands(docs: DataFrame, words: int, ids: DataFrame, level: int) -> DataFrame:
    """key, id: the longer bands of the documents with these ids, and perhaps of some more."""
    rows, bands = LONGER[level - 1]

    def make(found_ids, found):
        import numpy as np
        import pyarrow as pa

        draw = np.random.default_rng(1000 + level)
        n = bands * rows
        a, b = draw.integers(1, 1 << 63, (n, 1), np.uint64) | np.uint64(1), draw.integers(0, 1 << 63, (n, 1), np.uint64)
        weights = draw.integers(1, 1 << 63, (1, rows), np.uint64) | np.uint64(1)
        salt = draw.integers(0, 1 << 63, bands, np.uint64)
        kept, keys = [], []
        for doc_id, own in zip(found_ids, found, strict=True):
            if len(own):
                least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(own), 128):
                    least = np.minimum(least, (a * own[None, at : at + 128] + b).min(axis=1))
                kept.append(doc_id)
                keys.append(Shingles.mix((least.reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
        yield pa.RecordBatch.from_pydict({"id": pa.array(kept, pa.int64()), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return _per_set(docs, words, ids, make, "id long, keys array<long>").select(F.explode("keys").alias("key"), "id").distinct()


def _compared(docs: DataFrame, words: int, rows: DataFrame) -> DataFrame:
    """Links (a, b) that join the components (own) of the members of each bucket (key, id, k1, own, sketch), found in its task."""
    every = _sets(docs, words, rows.select("id")).withColumnRenamed("doc_id", "id").dropDuplicates(["id", "k1"])
    rows = rows.join(every, ["id", "k1"]).select("key", "id", "own", "sketch", "set").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from planestack.llm.packed import ragged

        for _, held in common.runs(batches, "key", ["id", "own", "sketch", "set"]):
            ids, own = held["id"].astype(np.int64), held["own"].astype(np.int64)
            sets = [np.frombuffer(s, np.uint64) for s in held["set"]]
            n = np.array([len(s) for s in sets])
            bits = np.frombuffer(b"".join(held["sketch"]), np.uint64).reshape(len(ids), -1)
            known, flat = np.unique(np.concatenate(sets), return_inverse=True)
            starts = np.cumsum(n) - n
            mark = np.zeros(len(known), np.int32)
            out = ([], [])
            for i in range(len(ids) - 1):
                later = np.arange(i + 1, len(ids))
                fits = later[(own[later] != own[i]) & (PART * np.minimum(n[later], n[i]) >= LEAST * np.maximum(n[later], n[i]))]
                fits = fits[np.bitwise_count(bits[fits] ^ bits[i]).sum(axis=1, dtype=np.int64) <= MOST_BITS]
                if not len(fits):
                    continue
                mine = flat[starts[i] : starts[i] + n[i]]
                mark[mine] = 1
                shared = np.add.reduceat(mark[flat[ragged(starts[fits], n[fits])]], np.cumsum(n[fits]) - n[fits])
                mark[mine] = 0
                for j in fits[PART * shared >= LEAST * (n[fits] + n[i] - shared)]:
                    if own[i] != own[j]:
                        out[0].append(ids[i])
                        out[1].append(ids[j])
                        own[own == own[j]] = own[i]
            if out[0]:
                yield pa.RecordBatch.from_pydict({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return rows.mapInArrow(run, "a long, b long").distinct()


def _rest(docs: DataFrame, words: int, firsts: DataFrame, buckets: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """Components after the members of buckets (key, id) that hold several components have been compared (steps 4 and 5)."""
    spark, spent = docs.sparkSession, []

    def written(df: DataFrame, tag: str) -> DataFrame:
        df, at = common.materialize(df, tag)
        spent.append(at)
        return df

    several = lambda rows: rows.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.min("n").alias("least"), F.sum(F.greatest(F.lit(1), F.floor(F.col("n") / LONG))).alias("weight"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    for level in range(len(LONGER) + 1):
        members = firsts.select(F.col("doc_id").alias("id"), "k1", "n", "sketch")
        rows = _label(buckets, roots, "id", "own").join(members.drop("sketch"), "id")
        rows = written(rows, "members")
        # Of two members, one was the other's centre.
        held = several(rows).filter("size > 2") if level == 0 else several(rows)
        # Buckets with the same members, as copies have in many bands, count once.
        same = rows.join(held.select("key"), "key").groupBy("key").agg(F.bit_xor(F.xxhash64("id", "k1")).alias("x"), F.bit_xor(F.xxhash64("k1", "id", F.lit(1))).alias("y"))
        once = same.groupBy("x", "y").agg(F.min("key").alias("key")).select("key")
        rows = written(rows.join(once, "key"), "members")
        size = rows.select("id", "k1", "n").distinct().agg(F.sum("n")).first()[0]
        if not size:
            break
        shared = written(_shared(docs, words, rows.select("id"), max(8, size // COUNTED)), "counts")
        rows = rows.join(shared, "k1", "left").join(several(rows).select("key", "least"), "key")
        able = (PART + LEAST) * F.coalesce("shared", F.lit(0)) >= LEAST * (F.col("n") + F.col("least"))
        rows = written(rows.filter(able).select("key", "id", "k1", "own", "n"), "able")
        rows = rows.join(several(rows).select("key", "weight"), "key")
        small = rows if level == len(LONGER) else rows.filter(F.col("weight") <= BLOCK)
        small = small.select("key", "id", "k1", "own").join(members.select("id", "k1", "sketch"), ["id", "k1"])
        if not small.isEmpty():
            roots = _contracted(roots, _compared(docs, words, written(small, "small")))
        if level == len(LONGER):
            break
        large = rows.filter(F.col("weight") > BLOCK).select("id").distinct()
        if large.isEmpty():
            break
        large = written(large, "large")
        buckets = written(_longer_bands(docs, words, large, level + 1).join(large, "id"), "bands")
    for path in spent:
        common.drop(spark, path)
    return roots


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    spark = docs.sparkSession
    rows, _ = common.materialize(sketches(docs, words), "sketches")
    linked = rows.filter("n > 0 AND doc_id IS NOT NULL")
    # Written out, so that the join below stands on plain exchanges and a set that very many documents share can be split.
    classes, classes_at = common.materialize(linked.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("class")), "sets")
    is_first = F.col("doc_id") == F.col("class")
    of_class = linked.join(classes, ["k1", "k2", "n"]).select("doc_id", "class", "k1", "n", F.when(is_first, F.col("bands")).alias("bands"), F.when(is_first, F.col("sketch")).alias("sketch"))
    of_class, _ = common.materialize(of_class, "classes")
    # An id may stand on rows with several sets: its classes are one document.
    twice = of_class.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("doc_id", "a")
    same_id, same_id_at = common.materialize(of_class.select("doc_id", F.col("class").alias("b")).join(twice, "doc_id").filter("a <> b").select("a", "b").distinct(), "ids")
    roots = None if same_id.isEmpty() else _contracted(None, same_id)
    firsts = of_class.filter("doc_id = class").dropDuplicates(["doc_id", "k1"])
    odd = firsts.select("doc_id", "sketch")
    members = firsts.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id")).distinct()
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met, met_at = common.materialize(members.join(sizes, "key"), "met")
    score = met.groupBy("id").agg(F.sum("size").alias("score"))
    centres = met.join(score, "id").groupBy("key").agg(F.max(F.struct("score", F.xxhash64("id"), "id"))["id"].alias("centre"))
    buckets, buckets_at = common.materialize(met.join(centres, "key").select("key", "id", "centre"), "buckets")
    pairs = buckets.filter("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    candidates, candidates_at = common.materialize(_screened(pairs, odd), "candidates")
    candidates = candidates.groupBy("a", "b").agg(F.min("bits").alias("bits"))
    roots = _joined(docs, words, candidates, roots)
    roots = _rest(docs, words, firsts, buckets.select("key", "id"), roots)
    own = _label(of_class.select("doc_id", "class").distinct(), roots, "class", "root").groupBy("doc_id").agg(F.min("root").alias("root"))
    for path in (classes_at, same_id_at, met_at, buckets_at, candidates_at):
        common.drop(spark, path)
    result = rows.select("doc_id", "n").join(own, "doc_id", "left")
    return result.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("root", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs without the documents that aren't the first of their component; all columns unchanged."""
    dropped = near_duplicates(docs, words).filter("NOT kept").select("doc_id").distinct()
    return common.unboxed(common.boxed(docs).join(dropped, F.col("row.doc_id") == F.col("doc_id"), "left_anti"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over shingles of four words, as the query's contract has them."""
    return near_duplicates(common.documents(spark, sf_dir), 4)
