"""Formats, walks and windows over files; percentiles and propagation on awkward input."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from planestack.operators import catalog, normalize, propagate
from planestack.sources import formats, images, reports, stores, windows, zarr


@pytest.fixture(scope="module")
def volume(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store") / "v.zarr")
    rows = spark.range(300 * 2 * 130).selectExpr("id div 260 AS z", "id div 130 % 2 AS y", "id % 130 AS x", "id % 251 AS v")
    zarr.write_volume(rows, root, (300, 2, 130))
    formats.register(spark)
    return root


def test_bounds_prune_chunks(spark, volume):
    read = lambda: spark.read.format("volume").load(volume)
    assert read().rdd.getNumPartitions() == 6
    near = read().filter("z >= 256 AND x < 100")
    assert near.rdd.getNumPartitions() == 1 and near.count() == 44 * 2 * 100
    assert "v" in near.columns and near.agg(F.min("z"), F.max("x")).first() == (256, 99)
    at = {(r.z, r.y, r.x): r.v for r in read().filter("z = 130 AND y > 0 AND x IN (3, 129) AND v >= 0").collect()}
    assert at == {(130, 1, x): float((130 * 260 + 130 + x) % 251) for x in (3, 129)}
    assert read().filter("z < 0").count() == 0 and read().filter("z > 10 AND z < 5").count() == 0
    assert spark.read.format("volume").option("stride", 100).load(volume).select("z").distinct().count() == 3


def test_files_are_whole_and_can_be_written_again(spark, tmp_path):
    root = str(tmp_path / "out")
    formats.register(spark)
    rows = spark.createDataFrame([(f"a/{i % 3}/f{i}", b"x" * i) for i in range(20)] + [("empty", None)], "name string, content binary").repartition(4)
    for _ in range(2):
        rows.write.format("files").mode("append").save(root)
    found = sorted(p.relative_to(root).as_posix() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert found == sorted([f"a/{i % 3}/f{i}" for i in range(20)] + ["empty", "_SUCCESS"])
    assert (tmp_path / "out/a/1/f7").read_bytes() == b"x" * 7 and (tmp_path / "out/_SUCCESS").read_text() == "21"
    rows.limit(1).write.format("files").mode("overwrite").save(root)
    assert sum(p.is_file() for p in (tmp_path / "out").rglob("*")) == 2
    with pytest.raises(Exception, match="not a file name"):
        spark.createDataFrame([("../x", b"")], "name string, content binary").write.format("files").mode("append").save(root)
    with pytest.raises(Exception, match="name and a content"):
        spark.createDataFrame([("x",)], "name string").write.format("files").mode("append").save(root)


def test_run_metadata_and_missing_images(spark, tmp_path):
    reports.save(reports.run_metadata(spark, {"roi": None, "z": 4}, ["run", "--z", "4"], "z: 4\n"), str(tmp_path / "run"))
    assert json.loads((tmp_path / "run/args.json").read_text()) == {"roi": None, "z": 4}
    assert (tmp_path / "run/command.txt").read_text() == "run --z 4\n" and (tmp_path / "run/config.yaml").read_text() == "z: 4\n"
    with pytest.raises(ValueError, match="no images"):
        images.listed(spark, str(tmp_path / "run"))


def test_folders_that_are_not_there(spark, tmp_path):
    (tmp_path / "d" / "sub").mkdir(parents=True)
    (tmp_path / "d" / "f.txt").write_text("é")
    rows = spark.createDataFrame([(1, str(tmp_path / "d")), (2, str(tmp_path / "none")), (3, None)], "k int, path string")
    got = {(r.k, r["name"], r.is_dir) for r in stores.children(rows).collect()}
    assert got == {(1, "sub", True), (1, "f.txt", False)}
    texts = {r.k: r.t for r in stores.contents(rows, F.concat("path", F.lit("/f.txt")), "t").collect()}
    assert texts == {1: "é", 2: None, 3: None}
    targets = spark.createDataFrame([("mito_mem",)], "cls_name string")
    assert catalog.discover(spark, str(tmp_path / "d"), targets).count() == 0


def test_metadata_that_cannot_be_used(spark, tmp_path):
    scale = lambda p, y, moved=True: {"path": p, "coordinateTransformations": [{"type": "scale", "scale": [8.0, y, y]}] + ([{"type": "translation", "translation": [0.0, 0.0, 0.0]}] if moved else [])}
    made = {"good": [scale("s1", 8.0), scale("s0", 4.0), scale("s2", 4.0)], "lame": [scale("s0", 4.0), scale("s1", 8.0, False)], "lacks": [scale("s0", 4.0), scale("s9", 8.0)], "none": []}
    for name, scales in made.items():
        for s in ("s0", "s1", "s2"):
            (tmp_path / name / s).mkdir(parents=True)
            (tmp_path / name / s / ".zarray").write_text(json.dumps({"shape": [4, 5, 6], "chunks": [4, 5, 6]}))
        (tmp_path / name / ".zattrs").write_text(json.dumps({"multiscales": [{"datasets": scales}]}))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / ".zattrs").write_text("{")
    rows = spark.createDataFrame([(n, str(tmp_path / n)) for n in (*made, "broken", "absent")], "k string, path string")
    got = catalog.finest_of(rows, ["k"], "path").collect()
    assert [(r.k, r.scale, r.shape) for r in got] == [("good", "s0", [4, 5, 6])]


def test_windows_across_chunks(spark, volume):
    array = json.dumps(json.loads(open(f"{volume}/s0/.zarray").read()))
    store = (volume, "s0", [4.0, 1.0, 2.0], [0.0, 0.0, 10.0], [300, 2, 130], array)
    rows = [("a", 5, True, [512.0, 0.0, 10.0], [40.0, 2.0, 260.0], 0.0, 0.0), ("b", 0, False, [0.0] * 3, [1.0] * 3, 1.0, 260.0), ("c", 0, True, [9000.0, 50.0, 260.0], [4.0, 9.0, 400.0], 0.0, 0.0)]
    kind = "path string, scale string, resolution array<double>, offset array<double>, shape array<long>, array string"
    frame = spark.createDataFrame([(*r, [4.0, 1.0, 2.0], store) for r in rows], f"window string, z_index int, small boolean, origin array<double>, extent array<double>, at_y double, at_x double, raw_resolution array<double>, raw struct<{kind.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>")
    got = {}
    for r in windows.raw(frame, 2).collect():
        got.setdefault(r.window, {})[r.y, r.x] = r.v
    value = lambda z, y, x: float((z * 260 + y * 130 + x) % 251)
    assert got["a"] == {(y, x): value(133, y, x) for y in range(2) for x in range(130)}
    assert got["b"] == {(y, x): value(0, y, 125 + x) for y in range(2) for x in range(2)}
    assert got["c"] == {(0, x): value(299, 1, 125 + x) for x in range(5)}


@pytest.mark.parametrize("bins", [4096, 3])
def test_percentiles_of_awkward_values(spark, monkeypatch, bins):
    monkeypatch.setattr(normalize, "BINS", bins)
    draw = np.random.default_rng(6)
    groups = {"one": [5.0], "same": [2.5] * 40, "two": [1.0, 2.0], "wide": [-1e300, 1e300, 0.0, 1e-300], "many": draw.normal(0, 1, 3000).tolist(), "steep": [2.0**-k for k in range(200)], None: [1, 2, 3, 4]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("one", float("inf"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    got = {r.k: r.p for r in normalize.percentiles(df, "k", "v", shares).collect()}
    assert got.pop("none") is None and set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.percentile(np.array(vs, float), [100 * s for s in shares]).tolist(), rel=1e-12, abs=1e-15), k
    assert normalize.percentiles(df.limit(0), "k", "v", shares).count() == 0


def test_propagation_hands_over_between_ranges(spark):
    draw = np.random.default_rng(1)
    frames = spark.createDataFrame([(v, f, draw.normal(0.2, 0.25, 6).tolist()) for v in (1, 2) for f in range(-3, 40) if (v, f) != (2, 11)] + [(None, 1, [0.0] * 6)], "vol long, frame long, tile array<double>")
    seeds = spark.createDataFrame([(1, 5, b"\1\1\1\1\1\1"), (1, 30, b"\0\0\1\1\0\0"), (2, 20, b"\1\1\1\1\1\1"), (2, 99, b"\1"), (1, 5, b"\1\1\1\1\1\1")], "vol long, frame long, mask binary")
    whole = sorted(map(tuple, propagate.propagated(frames, seeds, "fading", 1000).collect()))
    assert len(whole) > 6
    for span in (1, 7):
        assert sorted(map(tuple, propagate.propagated(frames, seeds, "fading", span).collect())) == whole
    assert propagate.propagated(frames.limit(0), seeds, "fading").count() == 0
