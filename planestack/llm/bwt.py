"""Burrows-Wheeler transforms of shards, merged by interleave refinement (after Holt and McMillan, Bioinformatics 2014).

A shard is a cyclic text over small numbers. Its rotations are sorted once, on their first symbols. To merge shards, the order
of all rotations is described by the sequence of shard numbers alone (the interleave). Each round reads the merged transform
through the interleave and deals it out stably by symbol, which gives the interleave that is right for one symbol more. Where a
round first tells two neighbours apart, their common prefix ends: prefixes and intervals of repeats come from the rounds, with
no suffix sorted anew.
"""

from __future__ import annotations

import numpy as np


def sorted_rotations(symbols: np.ndarray, length: int) -> np.ndarray:
    """Start positions of the rotations of a cyclic text, sorted by their first `length` symbols or more."""
    n = len(symbols)
    bits = max(1, int(symbols.max()).bit_length()) if n else 1
    fit = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(min(fit, length)):
        key = (key << bits) | np.roll(symbols, -i).astype(np.int64)
    have = min(fit, length)
    while True:
        order = np.argsort(key)  # ties may fall either way: they agree in all symbols that count
        if have >= length:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        if rank.max(initial=0) == n - 1:
            return order
        key = rank * n + np.roll(rank, -have)
        have *= 2


def merge(shards: list[np.ndarray], orders: list[np.ndarray], length: int, marked: np.ndarray | None = None, step: int = 1):
    """(place, group, prefix) after rounds over the shards' transforms that reach `length` symbols.

    place: for each merged rank, its index in the concatenated shards' orders; group: number of the interval of rotations that
    agree in their first `length` symbols; prefix: common symbols with the rank before (`length` if that many or more), rounded
    down to a multiple of step. step: symbols that a round goes on by, 1 or 2 (transforms then hold pairs of symbols; at most
    256 different symbols, and an even length).
    marked: which rotations count (in the order of the concatenated orders); if no interval holds two of them, the rounds end
    early: group tells every rank apart, and prefixes are those of the rounds that were made.
    """
    sizes = np.array([len(s) for s in shards])
    n = int(sizes.sum())
    alphabet = np.unique(np.concatenate(shards))
    coded = [np.searchsorted(alphabet, s) for s in shards]
    if step == 2 and (len(alphabet) > 256 or length % 2):
        step = 1
    kind = np.uint8 if len(alphabet) <= 256 and step == 1 else np.uint16
    before = [c[o - 1] if step == 1 else c[o - 2] * len(alphabet) + c[o - 1] for c, o in zip(coded, orders, strict=True)]
    transforms = np.concatenate(before).astype(kind)
    number = np.uint8 if len(shards) <= 256 else np.uint16
    interleave = np.repeat(np.arange(len(shards)), sizes).astype(number)
    group = np.zeros(n, np.int32)
    prefix = np.full(n, length, np.uint8)
    prefix[:1] = 0
    known = np.zeros(max(0, n - 1), bool)  # neighbours that have been told apart
    read = np.empty(n, kind)
    place = np.argsort(interleave, kind="stable")
    for turn in range(length // step):
        read[place] = transforms
        dealt = np.argsort(read, kind="stable")
        symbols, groups = read[dealt], group[dealt]
        apart = (symbols[1:] != symbols[:-1]) | (groups[1:] != groups[:-1])
        interleave = interleave[dealt]
        np.cumsum(apart, out=group[1:])
        fresh = np.flatnonzero(apart & ~known)  # told apart in this round: their common prefix ends here
        prefix[1:][fresh] = turn * step
        known[fresh] = True
        place = np.argsort(interleave, kind="stable")
        if marked is not None and turn % 6 == 5:
            held = np.empty(n, bool)
            held[place] = marked
            if np.bincount(group[held], minlength=1).max(initial=0) < 2:
                group = np.arange(n, dtype=np.int32)
                prefix[1:][~known] = (turn + 1) * step
                break
    back = np.empty(n, np.int64)
    back[place] = np.arange(n)
    return back, group, prefix
