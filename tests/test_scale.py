"""Steps that must not grow into a few tasks: what a plan deals out, and how many rounds a job takes."""

import glob

from planestack import dims
from planestack.operators import masks, propagate, refine, tiles
from planestack.plans import base, registry, walks
from planestack.sources import images, reports, scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_crops_are_not_dealt_out_by_class(spark):
    for name in ("class_semi_join", "reverse_index", "crop_catalog"):
        told = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
        assert "hashpartitioning(cls_name" not in told, name


def test_repeated_orders_and_lines_are_one_crop(spark, tmp_path):
    orders = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a")]
    lines = [(1, 0), (1, 0), (1, 7), (1, 2), (2, 6), (None, 0), (3, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in registry.queries()["class_semi_join"](spark, str(tmp_path)).select("organelle_key", "dataset", "crop_id").collect()]
    classes = {("a", "crop1"): {"mito_mem", "hchrom"}, ("b", "crop1"): {"mito_mem", "hchrom"}, ("a", "crop2"): {"np_out"}}
    want = {(k, d, c) for k, names in dims.FINE_CLASSES.items() for (d, c), have in classes.items() if have & set(names)}
    assert len(got) == len(set(got)) and set(got) == want


def test_propagation_takes_rounds_by_stretch_not_by_volume(spark, monkeypatch):
    written = []
    whole = scratch.materialize
    monkeypatch.setattr(scratch, "materialize", lambda df, tag: written.append(tag) or whole(df, tag))
    on, off = bytes([1, 1]), bytes([0, 0])
    frames = spark.createDataFrame([(v, f, [1.0, -1.0 if f % 10 == 3 else 1.0]) for v in (1, 2) for f in range(200)], "vol long, frame long, tile array<double>")
    seeds = spark.createDataFrame([(1, f, on) for f in range(5, 200, 10)] + [(2, 100, on), (2, 101, off)], "vol long, frame long, mask binary")
    few = propagate.propagated(frames.filter("vol = 1"), seeds, "fading", span=8).collect()
    assert len(written) <= 10  # 25 ranges of 8 frames, each way
    assert len(few) == 200
    got = {(r.vol, r.frame): r.mask for r in propagate.propagated(frames, seeds, "fading", span=8).collect()}
    for f in range(200):
        seed = max((s for s in range(5, 200, 10) if s <= f), default=None)
        left = b"\x01\x00" if (any(g % 10 == 3 for g in range(seed + 1, f + 1)) if seed is not None else f <= 3) else on
        assert got[(1, f)] == left
    assert got[(2, 101)] == off and (2, 102) not in got and got[(2, 94)] == on and got[(2, 93)] == got[(2, 0)] == b"\x01\x00"


def test_slices_of_one_file_are_dealt_out(spark, tmp_path):
    rows = [(i, [0.2] * 4, 0.0, -1, "first") for i in range(40)]
    spark.createDataFrame(rows, "run long, tile array<double>, offset double, fails int, prompt string").coalesce(1).write.parquet(f"{tmp_path}/s")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    found = refine.refine(spark.read.parquet(f"{tmp_path}/s"), "cut", "dice")
    assert found.history.count() == 40 and spark.conf.get(name) == before
    assert len(glob.glob(f"{found.paths[0].removeprefix('file://')}/part-*.parquet")) > 1


def test_joined_tiles_are_dealt_out_by_count(spark, monkeypatch):
    monkeypatch.setattr(tiles, "PIXELS", 4)
    mask = spark.createDataFrame([(i, y, 3) for i in (1, 2) for y in range(8)] + [(2, 0, 7)], "img_id long, y long, x long")
    found = masks.tiled_components(mask, 4, 8)
    assert "REPARTITION_BY_NUM" in plan(found)
    assert {tuple(r) for r in found.collect()} == {(i, y, 3, 3) for i in (1, 2) for y in range(8)} | {(2, 0, 7, 7)}


def test_many_images_are_labelled_and_encoded_together(spark):
    mask = spark.createDataFrame([(i, y, x) for i in range(-5, 300) for y, x in [(0, 0), (1, 1), (3, 7), (4, 0)]] + [(None, 0, 0)], "img_id long, y int, x int")
    for size in (3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = masks.components(mask, True, 8)
            assert "FlatMapGroups" not in plan(found)
            got = sorted(tuple(r) for r in found.collect())
            pngs = {r.img_id: images.decode_png(bytes(r.content)) for r in images.png_of(masks.relabelled(found), 8, 8).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == sorted((i, y, x, f) for i in range(-5, 300) for y, x, f in [(0, 0, 0), (1, 1, 0), (3, 7, 31), (4, 0, 32)])
        assert len(pngs) == 305 and all((p[0, 0], p[1, 1], p[3, 7], p[4, 0], int((p > 0).sum())) == (1, 1, 2, 3, 4) for p in pngs.values())


def test_small_files_are_read_many_to_a_task(spark, monkeypatch):
    read = walks._read_back
    monkeypatch.setattr(walks, "_read_back", lambda *a: (lambda d: seen.append(d.rdd.getNumPartitions()) or d)(read(*a)))
    seen = []
    assert registry.queries()["mask_png_files"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen[0] <= spark.sparkContext.defaultParallelism


def test_written_files_are_not_listed_by_the_driver(spark, monkeypatch, tmp_path):
    from pyspark.sql import DataFrameReader

    asked = []
    load = DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, name: asked.append(name) or load(self, name))
    for name in ("stack_summaries", "mask_png_files"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert "binaryFile" not in asked
    files = spark.createDataFrame([("a/1.json", "é"), ("a/2.json", ""), ("b/3.json", "x" * 9)], "name string, content string")
    reports.save(files, str(tmp_path / "f"))
    more = files.unionByName(spark.createDataFrame([("c/none.json", None)], "name string, content string"))
    assert {(r.name, r.t) for r in base.read_back(more, str(tmp_path / "f"), "t").collect()} == {("a/1.json", "é"), ("a/2.json", ""), ("b/3.json", "x" * 9), ("c/none.json", None)}
    assert {bytes(r.b) for r in base.read_back(files, str(tmp_path / "f"), "b", text=False).collect()} == {"é".encode(), b"", b"x" * 9}
