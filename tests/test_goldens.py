"""Literal cases of regions, sizes, colours, replies and masks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from planestack.functions import geometry, pixels, replies
from planestack.operators import masks, refine, volume
from planestack.sources import images, zarr


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_roi(spark):
    r = one(spark, geometry.parse_roi(F.lit("[500:1000,500:1000,1000:11000]")).alias("r")).r
    assert (r.offset, r.shape) == ([500, 500, 1000], [500, 500, 10000])
    with pytest.raises(Exception, match="not a region"):
        one(spark, geometry.parse_roi(F.lit("1-2,3:4,5:6")))


def test_strides_and_even_samples(spark):
    assert (geometry.stride(40, 8), geometry.stride(20, 8)) == (5, 2)
    for n, m, want in ((10, 4, [0, 3, 6, 9]), (11, 4, [0, 3, 6, 10]), (5, 1, [0])):
        assert sorted(r[0] for r in volume.even_indices(spark, n, m).collect()) == want


def test_nearest_sampled_takes_the_lower_of_two(spark):
    rows = volume.nearest_sampled(spark.range(6).withColumnRenamed("id", "index"), spark.createDataFrame([(0,), (4,)], "index long"))
    assert {r["index"]: r["source"] for r in rows.collect()} == {0: 0, 1: 0, 2: 0, 3: 4, 4: 4, 5: 4}


def test_votes(spark):
    mask = lambda *p: spark.createDataFrame(p, "z long, y long, x long")
    a, b, c = mask((0, 0, 0), (0, 0, 1)), mask((0, 0, 0)), mask((0, 0, 2))
    assert {tuple(r) for r in volume.majority([a, b, c]).collect()} == {(0, 0, 0)}
    assert {tuple(r) for r in volume.majority([a, c]).collect()} == {(0, 0, 0), (0, 0, 1), (0, 0, 2)}


def test_pixels(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    r = one(
        spark,
        pixels.normalized(*lit(2750.0, 2500.0, 3000.0)).alias("a"),
        pixels.normalized(*lit(9.0, 7.0, 7.0)).alias("b"),
        pixels.target_score(lit(200, 30, 50), (255, 0, 0)).alias("c"),
        pixels.target_score(lit(255, 255, 0), (255, 0, 0)).alias("d"),
        pixels.marker_score(lit(100, 100, 100), lit(220, 90, 105), (255, 0, 0)).alias("e"),
        pixels.marker_score(lit(0, 0, 0), lit(3, 4, 0), (255, 255, 255)).alias("f"),
        geometry.padded_square(*lit(7, 4)).alias("g"),
        geometry.fitted(*lit(1024, 768)).alias("h"),
        geometry.generated_size(*lit(800, 600)).alias("i"),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (0.5, 1.0, 150, 0, 110, 0)
    assert (tuple(r.g), tuple(r.h), tuple(r.i)) == ((7, 0, 1), (1008, 756), (1024, 768))


def test_steps(spark):
    r = one(
        spark,
        F.round(refine.stepped(F.lit(3.5), F.lit(1), 1.0, 30.0), 6).alias("a"),
        refine.stepped(F.lit(0.99), F.lit(1), 0.3, 1.0).alias("b"),
        refine.stepped(F.lit(28), F.lit(1), 15, 50, whole=True).alias("c"),
    )
    assert tuple(r) == (3.675, 1.0, 29)


@pytest.mark.parametrize(
    "text, w, h, want",
    [
        ('<points coords="1 0 523 412"/>', 200, 100, [(104, 41)]),
        ('<points coords="1 1 677 717 2 680 752"', 1000, 1000, [(677, 717), (680, 752)]),
        ('<points coords="1 523 412"/>', 200, 100, [(104, 41)]),
        ('<points coords="1 0 52 412"/>', 100, 100, []),
        ('1 677 717 2 680 752">label</points>', 1000, 1000, [(677, 717), (680, 752)]),
        ('<point x="56.2" y="32.7" alt="a">', 100, 100, [(56, 32)]),
        ('<points x1="10.0" y1="20.0" x2="30" y2="40" alt="a">', 200, 100, [(20, 20), (60, 40)]),
    ],
)
def test_pointing(spark, text, w, h, want):
    got = one(spark, replies.coordinates(F.lit(text), F.lit(w), F.lit(h)).alias("p")).p
    assert [(p.x, p.y) for p in got] == want


def test_tuples(spark):
    got = one(spark, replies.tuples(F.lit("A: (10, 65), (15, 60)\nB: (1, 2)"), F.lit(100), F.lit(100)).alias("p")).p
    assert [tuple(p) for p in got] == [(10, 65, 0), (15, 60, 0), (1, 2, 1)]
    assert [tuple(p) for p in one(spark, replies.tuples(F.lit("none"), F.lit(9), F.lit(5)).alias("p")).p] == [(4, 2, 0)]


@pytest.mark.parametrize(
    "text, score, issues, prompt",
    [
        ('{"score":0.9,"detailed_scores":{"tp_rate":0.8,"dice_score":0.6}}', 0.6, [], None),
        ('{"score":0.9,"detailed_scores":{"tp_rate":0.8}}', 0.5, [], None),
        ('{"score": 0.72, "issues": ["a", "b"], "refined_prompt": "x', 0.72, ["a", "b"], None),
        ('ok {"a": {"b": "}{"}, "score": 0.3, "refined_prompt": "q"} {"score": 1}', 0.3, [], "q"),
        ("no json here", 0.5, [replies.DEFAULT_ISSUE], None),
    ],
)
def test_evaluations(spark, text, score, issues, prompt):
    rows = spark.createDataFrame([(text,)], "t string").withColumn("o", replies.json_of(F.col("t")))
    r = rows.select(replies.evaluation(F.col("t"), F.col("o")).alias("r")).first().r
    assert (r.score, r.issues, r.refined_prompt) == (score, issues, prompt)


def test_disks():
    assert (len(masks.disk(2)), len(masks.disk(3))) == (13, 29)


def _grown(grid, r, low):
    out = np.empty_like(grid)
    for y in range(grid.shape[0]):
        for x in range(grid.shape[1]):
            near = [grid[y + a, x + b] for a, b in masks.disk(r) if 0 <= y + a < grid.shape[0] and 0 <= x + b < grid.shape[1]]
            out[y, x] = min(near) if low else max(near)
    return out


def test_morphology_against_arrays(spark):
    draw = np.random.default_rng(5)
    grids = [draw.random((11, 9)) < 0.7 for _ in range(12)]
    mask = spark.createDataFrame([(i, int(y), int(x)) for i, g in enumerate(grids) for y, x in zip(*np.nonzero(g), strict=True)], "img_id long, y long, x long")
    for r in (2, 3):
        for f, low in ((masks.opening, True), (masks.closing, False)):
            got = {tuple(p) for p in f(mask, r, 11, 9).collect()}
            want = {(i, int(y), int(x)) for i, g in enumerate(grids) for y, x in zip(*np.nonzero(_grown(_grown(g, r, low), r, not low)), strict=True)}
            assert got == want
            before = {tuple(p) for p in mask.collect()}
            assert got <= before if low else got >= before


def test_tiles_join_to_the_same_components(spark):
    draw = np.random.default_rng(6)
    grid = draw.random((40, 33)) < 0.55
    mask = spark.createDataFrame([(7, int(y), int(x)) for y, x in zip(*np.nonzero(grid), strict=True)], "img_id long, y long, x long")
    for eight in (True, False):
        whole = {tuple(r) for r in masks.components(mask, eight, 33).collect()}
        assert {tuple(r) for r in masks.tiled_components(mask, 8, 33, eight).collect()} == whole


def test_volume_chunks(spark, tmp_path):
    root = str(tmp_path / "v.zarr")
    rows = spark.createDataFrame([(0, 0, 0, 7), (129, 9, 9, 8)], "z long, y long, x long, v long")
    zarr.write_volume(rows, root, (130, 10, 10))
    files = sorted(str(p.relative_to(tmp_path / "v.zarr" / "s0")) for p in (tmp_path / "v.zarr" / "s0").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert files == ["0/0/0", "1/0/0"]
    got = zarr.read_volume(spark, root)
    assert got.count() == 13_000 and {tuple(r) for r in got.filter("v > 0").collect()} == {(0, 0, 0, 7.0), (129, 9, 9, 8.0)}
    with pytest.raises(ValueError, match="outside"):
        zarr.read_volume(spark, root, roi=[(500, 600), (0, 1), (0, 1)])


def test_png():
    draw = np.random.default_rng(1)
    for shape, kind in (((5, 7), np.uint8), ((6, 3), np.uint16), ((4, 5, 3), np.uint8)):
        p = draw.integers(0, np.iinfo(kind).max, shape).astype(kind)
        assert (images.decode_png(images.encode_png(p)) == p).all()


def test_sinc_weights_add_up():
    for out, into in ((5, 8), (16, 8), (8, 8)):
        assert np.allclose(images.windowed_sinc(out, into).sum(axis=1), 1)
    assert np.allclose(images.windowed_sinc(8, 8), np.eye(8))


def test_images_of_a_folder(spark, tmp_path):
    grey, colour = np.arange(6, dtype=np.uint8).reshape(2, 3), np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    (tmp_path / "a.PNG").write_bytes(images.encode_png(grey))
    (tmp_path / "b.png").write_bytes(images.encode_png(colour))
    (tmp_path / "c.txt").write_text("no image")
    found = images.listed(spark, str(tmp_path))
    assert found.count() == 2
    rows = {(r.path[-5:], r.y, r.x): (r.r, r.g, r.b) for r in images.pixels_of(found).collect()}
    assert rows[("a.PNG", 1, 2)] == (5, 5, 5) and rows[("b.png", 1, 0)] == (6, 7, 8) and len(rows) == 10


def test_settings(tmp_path):
    from planestack import config

    (tmp_path / "c.yaml").write_text("z-step: 4\nlora:\n  rank: 8\n  lr-decay: 0.5\n")
    file = config.load(str(tmp_path / "c.yaml"))
    assert file == {"z_step": 4, "lora_rank": 8, "lora_lr_decay": 0.5}
    assert config.merged({"z_step": 1, "roi": None}, file, {"z_step": 2, "lora_rank": None}) == {"z_step": 2, "roi": None, "lora_rank": 8, "lora_lr_decay": 0.5}


def test_multiscale_metadata_without_translation(spark):
    from planestack.operators import catalog

    js = '{"multiscales":[{"datasets":[{"path":"s0","coordinateTransformations":[{"scale":[4.0,2.0,2.0]}]}]}]}'
    r = catalog.scales(spark.createDataFrame([("v", js)], "path string, json string")).first()
    assert (r.scale, r.resolution, r.offset) == ("s0", [4.0, 2.0, 2.0], [0.0, 0.0, 0.0])


def test_components_of_paths_stars_and_rings(spark):
    from planestack.operators import graph

    draw = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(30)] + [(700 + i, 700 + (i + 1) % 9) for i in range(9)]
    edges += [(int(a), int(b)) for a, b in draw.integers(1000, 1200, (120, 2))] + [(3, 3)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tiles_give_what_the_whole_image_gives(spark):
    from planestack.operators import tiles

    draw = np.random.default_rng(8)
    grids = {1: draw.random((37, 45)) < 0.6, 2: draw.random((37, 45)) < 0.75, 3: np.zeros((37, 45), bool), 4: np.ones((37, 45), bool), 5: draw.random((37, 45)) < 0.3}
    rows = [(i, int(y), int(x)) for i, g in grids.items() for y, x in zip(*np.nonzero(g), strict=True)]
    mask = spark.createDataFrame([*rows, rows[0], (1, None, 3), (None, 1, 1), (1, -1, 0), (2, 37, 0)], "img_id long, y long, x long").repartition(3)
    images = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5)], "img_id long")
    steps = [*tiles.smoothed(2), ("invert", 0), *tiles.smoothed(3)]
    collected = lambda df: sorted(map(tuple, df.collect()))
    for s in (tiles.smoothed(2), tiles.smoothed(3), steps, [("erode", 1)], []):
        whole = collected(tiles.instances(mask, s, 37, 45, 4, images=images))
        assert collected(tiles.morphed(mask, s, 37, 45, images, tile=8)) == collected(tiles.morphed(mask, s, 37, 45, images))
        assert collected(tiles.instances(mask, s, 37, 45, 4, images=images, tile=16)) == whole
        assert collected(tiles.instances(mask, s, 37, 45, 4, False, images, 7)) == collected(tiles.instances(mask, s, 37, 45, 4, False, images))
    assert {r[0] for r in collected(tiles.morphed(mask, [("invert", 0)], 37, 45, images))} == {1, 2, 3, 5}
    assert collected(tiles.instances(mask.limit(0), steps, 37, 45, 4)) == []


def test_nearest_sampled_in_buckets(spark, monkeypatch):
    from planestack.operators import volume

    monkeypatch.setattr(volume, "BUCKET", 4)
    draw = np.random.default_rng(2)
    for n, sampled in ((150, [0, 7, 8, 90]), (150, [149]), (90, []), (70, sorted(draw.choice(70, 20, False).tolist())), (1, [0])):
        frame = lambda v: spark.createDataFrame([(i,) for i in v], "index long")
        found = volume.nearest_sampled(frame(range(-3, n)), frame(sampled))
        got = {r["index"]: r["source"] for r in found.collect()}
        assert got == {i: min(sampled, key=lambda s: (abs(s - i), s)) if sampled else None for i in range(-3, n)}
        assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
