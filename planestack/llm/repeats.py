"""Repeated byte strings across documents, found by merging Burrows-Wheeler transforms of shards.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller id. The strings (windows) of all
documents are brought together as follows.

1. The windows of a document are cut into runs with the same minimizer (the smallest hash of their 20-byte grams), so equal
   windows share their minimizer wherever they stand. Within a block of documents equal runs are put together first; the block
   sends the minimizer, a hash of the run and the smallest id once for each different run, however often it repeats there.
2. For each minimizer, equal runs count once, with their smallest id; a copy with a larger id is covered whole. A minimizer that
   occurs in one document only, or in equal runs only, needs no more. Nor does a run that no other one resembles beside the
   smallest gram: a window of 50 bytes has 15 bytes before or after it, whose hashes are sent along. The more text there is, the
   more runs have a gram in common by chance, but not what is beside it. Blocks learn this from one code for each run they sent.
3. The first copies of different runs under one minimizer are sent as bytes, dealt out by minimizer (if a minimizer has very
   many, by window, so that they spread: each different one of a block once, and those that stand alone aren't merged). A task splits its runs into shards, sorts each shard's rotations,
   and merges the transforms by interleave refinement for 50 rounds, which give the common prefixes of neighbours; intervals of
   rotations with a common prefix of 50 bytes are the equal windows, and those with a smaller id in their interval are covered.
4. Each block puts its covered windows together and cuts them out.

Runs that are equal as a whole are told by 96 bits of hash (their minimizer's and their own, over mixed 8-byte grams), so that
their bytes needn't move; which windows different runs have in common is decided on the bytes, by the merged transforms.

Every step is a shuffle of packed rows; texts move once, by block. Nothing is capped or sampled.

Defined results: a null text is empty; a null doc_id counts as larger than any other; rows with the same id count as one
document. Further columns are left out.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.llm import bwt, common
from planestack.llm.packed import pack, ragged, unpack

LENGTH, GRAM = 50, 20
#: Bytes beside the smallest gram that are looked at: one of the two sides of it in a window has so many.
SIDE = (LENGTH - GRAM) // 2
#: Mark of a run whose smallest gram is there more than once: no place of it tells what a window holds beside it.
ANY_SIDE = 0
#: Bytes of text for a block, for one look at it, and for a bucket of minimizers.
BLOCK, PIECE, BUCKET = 4 << 20, 1 << 20, 12 << 20
#: Different runs of a minimizer over which its windows are dealt out one by one.
HOT = 4096
#: Bytes merged at once, and bytes of a shard.
MERGED, SHARD = 1 << 20, 1 << 17
LAST = (1 << 63) - 1


@cache
def _powers(n: int):
    """Powers of the base and of its inverse, made once in a worker."""
    import numpy as np

    base = 0xD1342543DE82EF95
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, np.uint64(b)))) for b in (base, pow(base, -1, 1 << 64)))


class Runs:
    """The runs of windows of a block of documents, always in the same order."""

    def __init__(self) -> None:
        self.powers, self.inverses = _powers(PIECE + LENGTH)

    @staticmethod
    def mix(h):
        import numpy as np

        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))

    @classmethod
    def eights(cls, data):
        """A mixed number for every eight bytes that follow each other (along the last axis)."""
        import numpy as np

        wide = data.astype(np.uint64)
        for k in (1, 2, 4):
            wide = wide[..., :-k] | wide[..., k:] << np.uint64(8 * k)
        return cls.mix(wide)

    def __call__(self, texts: list[bytes], sided: bool = False):
        """(data, offsets of texts, start, windows, minimizer, hash, text number) with an entry for each run; sided: and its sides."""
        import numpy as np

        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        found = []
        # Stretches of at most PIECE bytes; one that ends within a text is taken up again LENGTH - 1 bytes earlier.
        at = 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            inside = int(np.searchsorted(offsets, end, "left"))
            if offsets[inside] != end and offsets[inside - 1] > at:
                end = int(offsets[inside - 1])
            found.append(self._piece(data[at:end], np.unique(np.clip(offsets, at, end)) - at, at, sided))
            at = end if end == len(data) or end in offsets else end - LENGTH + 1
        start, windows, minimizer, name, sides = (np.concatenate(c) if found else np.empty(0, np.int64) for c in (zip(*found, strict=True) if found else [()] * 5))
        number = np.searchsorted(offsets, start, "right") - 1
        out = data, offsets, start.astype(np.int64), windows.astype(np.int64), minimizer.astype(np.uint64), name.astype(np.uint64), number
        return (*out, sides.astype(np.uint64)) if sided else out

    def _piece(self, data, edges, at: int, sided: bool):
        import numpy as np

        n, w = len(data), LENGTH - GRAM + 1
        if n < LENGTH:
            return tuple(np.empty(0, np.int64) for _ in range(5))
        eights = self.eights(data)
        sums = np.cumsum(np.append(np.uint64(0), eights * self.powers[: len(eights)]))
        own = GRAM - 7  # eights of a gram
        grams = least = self.mix((sums[own:] - sums[:-own]) * self.inverses[: n - GRAM + 1])
        reach = 1
        while 2 * reach <= w:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < w:
            least = np.minimum(least[: len(least) - (w - reach)], least[w - reach :])
        whole = np.ones(n - LENGTH + 1, bool)  # windows within one text
        for e in edges[1:-1].tolist():
            whole[max(0, e - LENGTH + 1) : e] = False
        fresh = np.append(True, (least[1:] != least[:-1]) | ~whole[:-1])
        starts = np.flatnonzero(fresh & whole)
        ends = np.flatnonzero(whole & np.append((least[1:] != least[:-1]) | ~whole[1:], True)) + 1
        last = ends + LENGTH - 8
        name = self.mix((sums[last] - sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))
        sides = self._sides(grams, least, sums, starts, ends - starts) if sided else np.zeros(len(starts), np.uint64)
        return starts + at, ends - starts, least[starts], name, sides

    def _sides(self, grams, least, sums, starts, windows):
        """For each run: 16 bits of hash of its smallest gram with the SIDE bytes before it, and 16 bits of it with those after it
        (each 0 if that leaves the run); ANY_SIDE if the gram is there more than once.

        A window that two runs have in common holds the gram in one place, with SIDE bytes before or after it at least.
        """
        import numpy as np

        # Places of grams that are the smallest of a window: in the windows that hold them, the largest of the minima is theirs.
        w = LENGTH - GRAM + 1
        most = np.pad(least, w - 1)
        reach = 1
        while 2 * reach <= w:
            most = np.maximum(most[:-reach], most[reach:])
            reach *= 2
        if reach < w:
            most = np.maximum(most[: len(most) - (w - reach)], most[w - reach :])
        places = np.flatnonzero(grams == most)
        low = np.searchsorted(places, starts)
        near = np.searchsorted(places, starts + windows + LENGTH - GRAM) - low
        at, run = places[ragged(low, near)], np.repeat(np.arange(len(starts)), near)
        own = grams[at] == least[starts][run]
        at, run = at[own], run[own]
        place = np.empty(len(starts), np.int64)
        place[run] = at
        n = GRAM + SIDE - 7  # eights of the gram and a side
        told = []
        for begin, inside in ((place - SIDE, place - SIDE >= starts), (place, place + SIDE + GRAM <= starts + windows + LENGTH - 1)):
            b = np.where(inside, begin, 0)
            h = self.mix((sums[np.where(inside, b + n, 0)] - sums[b]) * self.inverses[b]) >> np.uint64(48)
            told.append(np.where(inside, np.maximum(h, np.uint64(1)), np.uint64(0)))
        return np.where(np.bincount(run, minlength=len(starts)) > 1, np.uint64(ANY_SIDE), told[0] << np.uint64(16) | told[1])


def _documents(table) -> tuple[list, list[bytes]]:
    """Ids and texts of a block in a fixed order."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
    return [r[0] for r in rows], [r[1] or b"" for r in rows]


def _order(ids: list):
    import numpy as np

    return np.array([LAST if i is None else i for i in ids], np.int64)


def _by_bucket(bucket):
    """(bucket, indices) of each bucket that occurs, in the order of the runs."""
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        yield int(bucket[own[0]]), own


def _high(minimizer, buckets: int):
    import numpy as np

    return ((minimizer >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


_SENT = "block int, kind int, bucket int, ids binary, minimizers binary, names binary, lengths binary, data binary"
_REPLY = "block int, kind int, bucket int, codes binary"


def _different(minimizer, name, of):
    """(runs, which, first, several) of a block: a run for each different one, in order of bucket-free hash; which of them each
    run is; the smallest id of each; whether it stands under several ids."""
    import numpy as np

    order = np.lexsort((of, name, minimizer))
    m, s, d = minimizer[order], name[order], of[order]
    start = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (s[1:] != s[:-1]))) if len(order) else np.empty(0, np.int64)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
    first = d[start]
    return order[start], which, first, d[np.append(start[1:], len(order)) - 1] != first if len(start) else np.empty(0, bool)


def _announced(blocks: DataFrame, buckets: int) -> DataFrame:
    """Step 1: minimizer, hash, smallest id and whether there are more ids of the different runs, a row for each block and bucket."""

    def send(table):
        import pyarrow as pa

        ids, texts = _documents(table)
        _, _, _, _, minimizer, name, number, sides = Runs()(texts, sided=True)
        runs, _, first, several = _different(minimizer, name, _order(ids)[number])
        minimizer, name, sides = minimizer[runs], name[runs], sides[runs]
        rows = [(table.column("block")[0].as_py(), 1, b, pack(_steps(first[own])), pack(minimizer[own], 4), pack(name[own]), pack(several[own], 1), pack(sides[own], 4)) for b, own in _by_bucket(_high(minimizer, buckets))]
        return _table(rows, _SENT, pa)

    return blocks.groupBy("block").applyInArrow(send, _SENT)


def _steps(ids):
    """Ids, mostly ascending, as differences."""
    import numpy as np

    return np.diff(ids, prepend=0).astype(np.int64).view(np.uint64)


def _from_steps(data: bytes):
    import numpy as np

    return np.cumsum(unpack(data).view(np.int64))


def _table(rows: list, schema: str, pa):
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _answered(sent: DataFrame) -> DataFrame:
    """Step 2: a code for each run: 0 nothing, 1 covered whole, 2 to be merged, 3 to be merged window by window.

    In a block, only the copies with its smallest id are told by the code; those with larger ones are covered whole anyway.
    """

    def answer(table):
        import numpy as np
        import pyarrow as pa

        ids = [_from_steps(x) for x in table.column("ids").to_pylist()]
        sizes = np.array([len(i) for i in ids])
        of = np.concatenate(ids)
        minimizer = np.concatenate([unpack(x, 4) for x in table.column("minimizers").to_pylist()])
        name = np.concatenate([unpack(x) for x in table.column("names").to_pylist()])
        more = np.concatenate([unpack(x, 1) for x in table.column("lengths").to_pylist()]) > 0
        sides = np.concatenate([unpack(x, 4) for x in table.column("data").to_pylist()]).astype(np.uint64)
        order = np.lexsort((of, name, minimizer))
        m, s, d = minimizer[order], name[order], of[order]
        new_m = np.append(True, m[1:] != m[:-1])
        new_s = new_m | np.append(True, s[1:] != s[:-1])
        first_m, first_s = np.flatnonzero(new_m), np.flatnonzero(new_s)
        of_m, of_s = np.cumsum(new_m) - 1, np.cumsum(new_s) - 1
        near = _beside(of_m[first_s], sides[order][first_s])
        different = np.bincount(of_m[first_s][near], minlength=len(first_m))[of_m]
        several = ((np.minimum.reduceat(d, first_m) != np.maximum.reduceat(d, first_m)) | (np.add.reduceat(more[order].astype(np.int64), first_m) > 0))[of_m]
        copied = d[first_s][of_s] < d
        codes = np.where(copied, 1, np.where(near[of_s] & several, np.where(different > HOT, 3, 2), 0)).astype(np.uint8)
        back = np.empty(len(codes), np.uint8)
        back[order] = codes
        rows = [(b, 1, k, pack(c, 1)) for b, k, c in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(back, np.cumsum(sizes)[:-1]), strict=True)]
        return _table(rows, _REPLY, pa)

    return sent.groupBy("bucket").applyInArrow(answer, _REPLY)


def _beside(of, sides):
    """Which of the different runs (each with the number of its minimizer, ascending) may have a window in common with another one of
    that minimizer: one of its sides is the other's too, or one of them tells no side.
    """
    import numpy as np

    out = (np.bincount(of, weights=sides == ANY_SIDE) > 0)[of] & (np.bincount(of)[of] > 1) if len(of) else np.zeros(0, bool)
    for side in (sides >> np.uint64(16), sides & np.uint64(0xFFFF)):
        key = of.astype(np.uint64) << np.uint64(16) | side
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twin = np.append(False, same) | np.append(same, False) if len(of) else np.zeros(0, bool)
        out[order[twin & (side[order] > 0)]] = True
    return out


def _codes(replies, minimizer, name, of, buckets: int):
    """The codes of a block's runs, put in place from its replies."""
    import numpy as np

    by = {b: c for b, k, c in zip(replies.column("bucket").to_pylist(), replies.column("kind").to_pylist(), replies.column("codes").to_pylist(), strict=True) if k == 1}
    runs, which, first, _ = _different(minimizer, name, of)
    codes = np.zeros(len(runs), np.uint8)
    for b, own in _by_bucket(_high(minimizer[runs], buckets)):
        codes[own] = unpack(by[b], 1)
    return np.where(of > first[which], 1, codes[which]).astype(np.uint8) if len(of) else codes


def _to_merge(codes, start, windows, data):
    """(start, windows, runs, hash, single, first) of what a block sends as bytes: runs with code 2, and (with its hash) each different
    window of those with 3. single: all windows of those; first: for each, which of the sent ones it equals (the block's first copy).
    """
    import numpy as np

    runs, hot = np.flatnonzero(codes == 2), np.flatnonzero(codes == 3)
    single = np.sort(ragged(start[hot], windows[hot]))
    h = _hashed(data, single)
    _, at, which = np.unique(h, return_index=True, return_inverse=True)
    copy = at[which]
    for a in range(0, len(single), 8192):  # equal hashes are believed only if the bytes are equal
        own, other = single[a : a + 8192, None] + np.arange(LENGTH), single[copy[a : a + 8192], None] + np.arange(LENGTH)
        differs = (data[own] != data[other]).any(axis=1)
        copy[a : a + 8192][differs] = np.flatnonzero(differs) + a
    sent, first = np.unique(copy, return_inverse=True)
    return np.concatenate([start[runs], single[sent]]), np.concatenate([windows[runs], np.ones(len(sent), np.int64)]), runs, h[sent], single, first


def _shipped(blocks: DataFrame, replies: DataFrame, buckets: int, targets: int) -> DataFrame:
    """Step 3, sending: the bytes of the runs that are to be merged."""

    def send(left, right):
        import numpy as np
        import pyarrow as pa

        ids, texts = _documents(left)
        make = Runs()
        data, offsets, start, windows, minimizer, name, number = make(texts)
        codes = _codes(right, minimizer, name, _order(ids)[number], buckets)
        at, many, runs, hashes, _, _ = _to_merge(codes, start, windows, data)
        target = _target(minimizer[runs], hashes, targets)
        of = _order(ids)[np.searchsorted(offsets, at, "right") - 1]
        rows = []
        for b, own in _by_bucket(target):
            lengths = many[own] + LENGTH - 1
            rows.append((left.column("block")[0].as_py(), 2, b, pack(_steps(of[own])), None, pack(own >= len(runs), 1), pack(lengths, 4), _squeezed(data[ragged(at[own], lengths)])))
        return _table(rows, _SENT, pa)

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(send, _SENT)


def _target(minimizer, hashes, targets: int):
    """Where each piece is merged: by minimizer, or by the hash of the window for single ones."""
    import numpy as np

    return (Runs.mix(np.concatenate([minimizer, hashes])) % np.uint64(targets)).astype(np.int64)


def _hashed(data, at):
    """A number for each window that starts at these places."""
    import numpy as np

    out = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), 8192):
        window = data[at[a : a + 8192][:, None] + np.arange(LENGTH)].astype(np.uint64)
        h = np.zeros(len(window), np.uint64)
        for k in range(LENGTH):
            h = (h + window[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out[a : a + 8192] = h
    return out


def _squeezed(data) -> bytes:
    import zstandard

    return zstandard.compress(data.tobytes(), 1)


def covered_windows(data, lengths, of):
    """For each byte of the pieces (concatenated in data): is it the start of a window that a piece with a smaller id has too?"""
    import numpy as np

    n = len(lengths)
    symbols = np.zeros(len(data) + n, np.uint16)  # 0 ends each piece
    ends = np.cumsum(lengths + 1)
    place = ragged(ends - lengths - 1, lengths)
    symbols[place] = data.astype(np.uint16) + 1
    cuts = [0]
    for e in ends.tolist():
        if e - cuts[-1] >= SHARD:
            cuts.append(e)
    if cuts[-1] != len(symbols):
        cuts.append(len(symbols))
    if len(cuts) == 2 and n > 1:
        cuts.insert(1, int(ends[n // 2 - 1]))
    shards = [symbols[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    orders = [bwt.sorted_rotations(s, LENGTH) for s in shards]
    where = np.concatenate([o + a for o, a in zip(orders, cuts, strict=False)])
    whole = np.zeros(len(symbols), bool)
    whole[ragged(ends - lengths - 1, lengths - LENGTH + 1)] = True
    owner = np.full(len(symbols), LAST, np.int64)
    owner[place] = np.repeat(of, lengths)
    ranks, _, prefix = bwt.merge(shards, orders, LENGTH, whole[where], 2)
    at = where[ranks]
    mine = np.where(whole[at], owner[at], LAST)
    fresh = prefix < LENGTH  # a repeated interval goes on while neighbours have LENGTH bytes in common
    starts = np.flatnonzero(fresh)
    least = np.minimum.reduceat(mine, starts)[np.cumsum(fresh) - 1]
    out = np.zeros(len(symbols), bool)
    out[at] = whole[at] & (least < owner[at])
    return out[place]


def _merged(sent: DataFrame) -> DataFrame:
    """Step 3, merging: for each byte that was sent, whether a covered window starts there."""

    def run(table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        ids = [_from_steps(x) for x in table.column("ids").to_pylist()]
        lengths = [unpack(x, 4).astype(np.int64) for x in table.column("lengths").to_pylist()]
        raw = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in table.column("data").to_pylist()]
        sizes = np.array([len(r) for r in raw])
        data, length, of = np.concatenate(raw), np.concatenate(lengths), np.concatenate(ids)
        single = np.concatenate([unpack(x, 1) for x in table.column("names").to_pylist()]) > 0
        starts = np.cumsum(length) - length
        left = np.flatnonzero(~single | _twins(data, starts, single))
        # Parts of bounded size: pieces with the same minimizer stay together, as their smallest grams are equal.
        part = [left[own] for own in _parts(data[ragged(starts[left], length[left])], length[left])] if len(left) else []
        out = np.zeros(len(data), bool)
        for own in part:
            at = ragged(starts[own], length[own])
            out[at] = covered_windows(data[at], length[own], of[own])
        rows = [(b, 2, k, _squeezed(np.packbits(c))) for b, k, c in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), np.split(out, np.cumsum(sizes)[:-1]), strict=True)]
        return _table(rows, _REPLY, pa)

    return sent.groupBy("bucket").applyInArrow(run, _REPLY)


def _twins(data, starts, single):
    """Which single windows may be there twice: those dealt out one by one meet only each other, and most of them stand alone."""
    import numpy as np

    out, at = np.zeros(len(single), bool), np.flatnonzero(single)
    _, which, often = np.unique(_hashed(data, starts[at]), return_inverse=True, return_counts=True)
    out[at] = often[which] > 1
    return out


def _parts(data, length):
    """Sets of pieces of about MERGED bytes; pieces with a window in common fall into one set."""
    import numpy as np

    if len(data) <= MERGED:
        return [np.arange(len(length))]
    w = LENGTH - GRAM + 1
    make = Runs()
    starts = np.cumsum(length) - length
    least = np.empty(len(length), np.uint64)
    # The smallest gram of a piece's first window is the minimizer of all its windows.
    for a in range(0, len(length), 4096):
        eights = Runs.eights(data[starts[a : a + 4096][:, None] + np.arange(LENGTH)])
        sums = np.cumsum(np.hstack([np.zeros((len(eights), 1), np.uint64), eights * make.powers[: LENGTH - 7]]), axis=1)
        least[a : a + 4096] = Runs.mix((sums[:, GRAM - 7 :] - sums[:, : 7 - GRAM]) * make.inverses[:w]).min(axis=1)
    key = (Runs.mix(least) >> np.uint64(20)) % np.uint64(-(-len(data) // MERGED) * 2)
    return [own for _, own in _by_bucket(key.astype(np.int64))]


def _cut(blocks: DataFrame, replies: DataFrame, buckets: int, targets: int) -> DataFrame:
    """Step 4: doc_id, n_bytes, spans (start, end) and kept (the remaining bytes) of every row."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa
        import zstandard

        ids, texts = _documents(left)
        data, offsets, start, windows, minimizer, name, number = Runs()(texts)
        codes = _codes(right, minimizer, name, _order(ids)[number], buckets)
        change = np.zeros(len(data) + 1, np.int64)
        whole = codes == 1
        np.add.at(change, start[whole], 1)
        np.add.at(change, start[whole] + windows[whole] + LENGTH - 1, -1)
        at, many, runs, hashes, single, first = _to_merge(codes, start, windows, data)
        target = _target(minimizer[runs], hashes, targets)
        covered = np.zeros(len(at), bool)  # of the single windows that were sent
        by = {b: c for b, k, c in zip(right.column("bucket").to_pylist(), right.column("kind").to_pylist(), right.column("codes").to_pylist(), strict=True) if k == 2}
        for b, own in _by_bucket(target):
            lengths = many[own] + LENGTH - 1
            bits = np.unpackbits(np.frombuffer(zstandard.decompress(by[b]), np.uint8))[: int(lengths.sum())].astype(bool)
            alone = own >= len(runs)
            covered[own[alone]] = bits[(np.cumsum(lengths) - lengths)[alone]]
            hits = ragged(at[own], lengths)[bits & np.repeat(~alone, lengths)]
            np.add.at(change, hits, 1)
            np.add.at(change, hits + LENGTH, -1)
        of = np.searchsorted(offsets, single, "right") - 1
        sent = np.searchsorted(offsets, at[len(runs) :], "right") - 1
        order = _order(ids)
        hits = single[covered[len(runs) :][first] | (order[of] > order[sent][first])] if len(single) else single
        np.add.at(change, hits, 1)
        np.add.at(change, hits + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = ([], [], [], [])
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            out[0].append(ids[i])
            out[1].append(b - a)
            out[2].append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
            out[3].append(data[a:b][~own].tobytes())
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans, kept of every row of docs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, buckets = max(1, -(-size // BLOCK)), max(16, -(-size // BUCKET))
    targets = max(32, -(-size // BUCKET))
    blocks = docs.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n_blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    replies = _answered(_announced(blocks, buckets))
    merged = _merged(_shipped(blocks, replies, buckets, targets))
    return _cut(blocks, replies.unionByName(merged), buckets, targets)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_repeats(common.documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
