"""What the driver gets to plan, to send and to hold stays small: few jobs, and compressed bitmaps."""

import numpy as np

from planestack.llm import mixing, near_dedup


def cells(spark):
    rows = [(s, lang, t, 7 * i + 3 * j + k + 1, 1) for i, s in enumerate(["a", "b", None]) for j, lang in enumerate(["en", "es", None]) for k, t in enumerate(["prose", "table"]) if (i, j, k) != (1, 1, 1)]
    return mixing.with_targets(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long"), mixing.TEMPER)


def weights(rows):
    return {(r.source, r.lang, r.topic): r.weight for r in rows.collect()}


def test_few_cells_are_raked_in_few_jobs(spark):
    given, _ = mixing.common.materialize(cells(spark), "cells")
    context = spark.sparkContext
    context.setJobGroup("rake", "rake")
    try:
        mixing.rake(given)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(context.statusTracker().getJobIdsForGroup("rake"))
    assert mixing.ROUNDS <= jobs <= 6 * mixing.ROUNDS, jobs


def test_cells_few_or_many_are_raked_alike(spark, monkeypatch):
    few = weights(mixing.rake(cells(spark)))
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    many = weights(mixing.rake(cells(spark)))
    assert len(few) == 17 and few.keys() == many.keys()
    assert all(abs(few[k] - many[k]) <= 1e-12 * many[k] for k in many)


def test_bitmaps_of_ids_come_compressed(spark, monkeypatch):
    ids = spark.range(0, 70_000, 7)
    got, frame = [], type(ids)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.extend(out := collect(self)) or out)
    bits = near_dedup._filter(ids)
    assert sum(len(r["bits"]) for r in got) < near_dedup.FILTER_BITS // 64
    at = (near_dedup.Shingles.mix(np.arange(0, 70_000, 7).view(np.uint64)) % np.uint64(near_dedup.FILTER_BITS)).astype(np.int64)
    want = np.zeros(near_dedup.FILTER_BITS, bool)
    want[at] = True
    assert (np.packbits(want) == bits).all()
