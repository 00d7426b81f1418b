"""Queries over stores of files: walks that build catalogs, windows of crops, formats with pruning, and file sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planestack.operators import catalog, masks
from planestack.plans import runs
from planestack.plans.base import FILES, GREY, grey, mask, parts, query, read_back, table
from planestack.plans.images import EIGHT
from planestack.sources import formats, images, scratch, windows, zarr



def _folder(spark, name: str) -> str:
    return f"{scratch.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _array(n):
    return F.concat(F.lit('{"shape": ['), n, F.lit(", "), n, F.lit(", "), n, F.lit('], "chunks": [64, 64, 64], "dtype": "|u1", "compressor": null, "fill_value": 0, "order": "C", "filters": null, "zarr_format": 2}'))


def _scale(name: str, res: list, offset: list | None):
    listed = lambda values: F.concat(F.lit("["), F.array_join(F.array(*[v.cast("string") for v in values]), ", "), F.lit("]"))
    moved = F.concat(F.lit(', {"type": "translation", "translation": '), listed(offset), F.lit("}")) if offset else F.lit("")
    return F.concat(F.lit(f'{{"path": "{name}", "coordinateTransformations": [{{"type": "scale", "scale": '), listed(res), F.lit("}"), moved, F.lit("]}"))


def _attrs(*scales):
    return F.concat(F.lit('{"multiscales": [{"datasets": ['), F.concat_ws(", ", *scales), F.lit("]}]}"))


_KINDS = ["mito_mem", "er_lum", "pm", "other"]


def crop_store(spark, sf) -> str:
    """A tree of metadata files: nations as datasets, suppliers as their crops, with up to four classes of two scales each.

    Some datasets have no raw store, some suppliers' folders aren't crops, some classes lack a translation.
    """
    root = _folder(spark, "store")
    n, s = F.col("n_nationkey"), F.col("s_suppkey")
    ds = F.concat(F.lit("ds"), n.cast("string"))
    base = F.concat(ds, F.lit("/"), ds, F.lit(".zarr/recon-1/"))
    file = lambda *parts, content: F.struct(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]).alias("name"), content.cast("binary").alias("content"))
    four = [F.lit(4.0)] * 3
    em = lambda name: [file(base, f"em/{name}/.zattrs", content=_attrs(_scale("s0", four, [F.lit(0.0)] * 3))), file(base, f"em/{name}/s0/.zarray", content=_array(F.lit("512")))]
    none = F.array().cast("array<struct<name:string,content:binary>>")
    raw = F.concat(F.when((n % 3 != 1) & (n % 7 != 6), F.array(*em("fibsem-uint8"))).otherwise(none), F.when((n % 3 != 0) & (n % 7 != 6), F.array(*em("fibsem-uint16"))).otherwise(none))
    nations = table(spark, sf, "nation").select(F.explode(raw).alias("f"))
    crop = F.concat(F.when(s % 10 == 9, F.lit("old")).otherwise(F.lit("crop")), s.cast("string"))
    files = none
    for k, kind in enumerate(_KINDS):
        at = [base, "labels/groundtruth/", crop, f"/{kind}/"]
        size = lambda scale: [F.lit(8.0 * scale), F.lit((4.0 + k) * scale), F.lit((4.0 + k) * scale)]  # noqa: B023, E731
        moved = [s.cast("double"), (s * 2).cast("double"), (s * 3 + k).cast("double")]
        fine, coarse = _scale("s0", size(1), moved), _scale("s1", size(2), moved)
        lame = _attrs(_scale("s0", size(1), None), coarse)
        attrs = F.when((s + k) % 11 == 10, lame).when(s % 5 == 4, _attrs(coarse, fine)).otherwise(_attrs(fine, coarse))
        own = F.array(file(*at, ".zattrs", content=attrs), file(*at, "s0/.zarray", content=_array((s % 40 + 10).cast("string"))), file(*at, "s1/.zarray", content=_array((s % 40 + 5).cast("string"))))
        files = F.concat(files, F.when((s + k) % (k + 2) == 0, own).otherwise(none))
    crops = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == n).select(F.explode(files).alias("f"))
    formats.register(spark)
    nations.unionByName(crops).select("f.name", "f.content").write.format("files").mode("append").save(root)
    return root


_FOUND = """k AS (SELECT 'ds' || s_nationkey AS dataset, 'crop' || s_suppkey AS crop_id, s_suppkey AS s, s_nationkey AS n, k, (['mito_mem', 'er_lum', 'pm'])[k + 1] AS cls FROM supplier, range(3) r(k)
    WHERE s_suppkey % 10 <> 9 AND (s_suppkey + k) % (k + 2) = 0 AND (s_suppkey + k) % 11 <> 10 AND s_nationkey % 7 <> 6 AND s_nationkey <> 3),
found AS (SELECT dataset, crop_id, string_agg(cls, ',' ORDER BY cls) AS annotated, CASE WHEN n % 3 = 1 THEN 'fibsem-uint16' ELSE 'fibsem-uint8' END AS raw, arg_min(s * 3 + k, cls)::DOUBLE AS origin_x, arg_min((s % 40 + 10) * (4.0 + k), cls)::DOUBLE AS extent_x
    FROM k GROUP BY dataset, crop_id, n, s HAVING (s % 40 + 10) * 8 / 4.0 >= 16 AND arg_min((s % 40 + 10) * (4.0 + k), cls) / 4.0 >= 16)"""


def _catalog(spark, root):
    targets = spark.createDataFrame([(c,) for c in _KINDS[:3]], "cls_name string")
    return catalog.discover(spark, root, targets, skip=["ds3"])


@query(f"WITH {_FOUND} SELECT * FROM found")
def discover_crops(spark, sf):
    """A store of metadata is written, walked, and read as a catalog."""
    c = _catalog(spark, crop_store(spark, sf))
    return c.select("dataset", "crop_id", F.array_join("annotated", ",").alias("annotated"), F.element_at(F.split("raw.path", "/"), -1).alias("raw"), F.col("origin")[2].alias("origin_x"), F.col("extent")[2].alias("extent_x"))


@query(f"WITH {_FOUND} SELECT dataset, crop_id, coalesce(lo, 0.0)::DOUBLE AS min, coalesce(hi, 255.0)::DOUBLE AS max FROM found LEFT JOIN (SELECT 'ds' || n_nationkey AS dataset, n_nationkey::DOUBLE AS lo, n_nationkey * 2.0 AS hi FROM nation WHERE n_regionkey < 3) USING (dataset)")
def catalog_cached(spark, sf):
    """A catalog that is cached under other norms, and read from the cache with those of now."""
    root, folder = crop_store(spark, sf), _folder(spark, "cache")
    told = {"data_root": "store", "target_classes": _KINDS[:3], "skip_datasets": ["ds3"], "include_datasets": None, "min_crop_voxels": 16}
    norms = table(spark, sf, "nation").select(F.concat(F.lit("ds"), F.col("n_nationkey").cast("string")).alias("dataset"), F.col("n_nationkey").cast("double").alias("min"), (F.col("n_nationkey") * 2.0).alias("max"), "n_regionkey")
    catalog.cached(spark, folder, told, lambda: _catalog(spark, root).select("dataset", "crop_id"), norms.limit(0))

    def again():
        raise ValueError("the cache is there")

    return catalog.cached(spark, folder, told, again, norms.filter("n_regionkey < 3")).select("dataset", "crop_id", "min", "max")


def crop_windows(spark, sf):
    """Each slice of a volume as a window of a small or a large crop, over a raw store and two label stores on coarser grids."""
    depth = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    root, rows = _folder(spark, "crop"), grey(spark, sf)
    zarr.write_volume(rows.select("z", "y", "x", F.col("g").alias("v")), f"{root}/raw", (depth, 8, 8), resolution=(4.0, 2.0, 2.0), offset=(40.0, 0.0, 0.0))
    coarse = lambda at: rows.filter(f"z % 2 = {at} AND y % 2 = 0 AND x % 2 = {at}").select(F.expr("z div 2").alias("z"), F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), F.when(F.col("g") > 180, 255).when(F.col("g") > 140, F.col("g") - 140).otherwise(0).alias("v"))
    for k in (0, 1):
        zarr.write_volume(coarse(k), f"{root}/label{k}", (-(-depth // 2), 4, 4), resolution=(8.0, 4.0, 4.0), offset=(40.0, 0.0, 0.0))
    paths = spark.createDataFrame([("raw", f"{root}/raw"), ("label0", f"{root}/label0"), ("label1", f"{root}/label1")], "name string, path string")
    found = catalog.finest_of(paths, ["name"], "path")
    of = {r["name"]: r for r in found.collect()}  # three rows
    shape = "struct<path:string,scale:string,resolution:array<double>,offset:array<double>,shape:array<bigint>,array:string>"
    store = lambda r: F.from_json(F.lit(__import__("json").dumps({c: r[c] for c in ("path", "scale", "resolution", "offset", "shape", "array")})), shape)
    n = F.col("vec_id")
    doubles = lambda *v: F.array(*[x.cast("double") if not isinstance(x, float) else F.lit(x) for x in v])
    e = table(spark, sf, "embeddings").select(
        n.alias("window"), n.alias("z_index"), (n % 2 == 0).alias("small"), doubles(40.0, (n % 3) * 2.0, 2.0).alias("origin"), doubles(F.lit(4.0 * depth), 8.0 + 0 * n, 12.0 + 0 * n).alias("extent"),
        doubles(4.0, 2.0, 2.0).alias("raw_resolution"), ((n % 9) * 2.0).alias("at_y"), ((n % 5) * 1.5).alias("at_x"), store(of["raw"]).alias("raw"), F.array(store(of["label0"]), store(of["label1"])).alias("classes"),
    )
    return e


_BOX = """b AS (SELECT vec_id AS w, vec_id % 2 = 0 AS small, (vec_id % 3) AS oy, CASE WHEN vec_id % 2 = 0 THEN vec_id % 3 ELSE least(vec_id % 9, 4) END AS y0, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE least(round_even((vec_id % 5) * 1.5::DOUBLE / 2, 0)::BIGINT, 4) END AS x0 FROM embeddings),
box AS (SELECT *, least(y0 + 4, 8) AS y1, CASE WHEN small THEN least(x0 + 6, 8) ELSE x0 + 4 END AS x1 FROM b)"""


@query(f'WITH {GREY}, {_BOX} SELECT w AS "window", y - y0 AS y, x - x0 AS x, g::DOUBLE AS v FROM box JOIN grey ON z = w AND y >= y0 AND y < y1 AND x >= x0 AND x < x1')
def raw_window(spark, sf):
    """Windows of four raw voxels a side (or of a small crop's extent), read from the chunks they touch."""
    return windows.raw(crop_windows(spark, sf), 4)


_LABEL = """lab AS (SELECT k, z // 2 AS z, y // 2 AS y, x // 2 AS x FROM grey, range(2) r(k) WHERE z % 2 = k AND y % 2 = 0 AND x % 2 = k AND g > 140 AND g <= 180),
lb AS (SELECT *, (SELECT max(vec_id) // 2 FROM embeddings) AS last, CASE WHEN small THEN least(round_even(oy / 2.0::DOUBLE, 0)::BIGINT, 3) ELSE least(round_even((w % 9) * 2.0::DOUBLE / 4, 0)::BIGINT, 2) END AS ly0, CASE WHEN small THEN round_even(0.5::DOUBLE, 0)::BIGINT ELSE least(round_even((w % 5) * 1.5::DOUBLE / 4, 0)::BIGINT, 2) END AS lx0 FROM box),
lw AS (SELECT *, least(ly0 + 2, 4) - ly0 AS lh, CASE WHEN small THEN least(lx0 + 3, 4) - lx0 ELSE 2 END AS lw, y1 - y0 AS h, x1 - x0 AS wd FROM lb),
yy AS (SELECT w, unnest(range(h)) AS y, h, lh FROM lw), xx AS (SELECT w, unnest(range(wd)) AS x, wd, lw AS lw_ FROM lw),
ym AS (SELECT w, y, CASE WHEN h <= 1 THEN 0 ELSE floor(y * ((lh - 1) / (h - 1)::DOUBLE) + 0.5)::BIGINT END AS sy FROM yy), xm AS (SELECT w, x, CASE WHEN wd <= 1 THEN 0 ELSE floor(x * ((lw_ - 1) / (wd - 1)::DOUBLE) + 0.5)::BIGINT END AS sx FROM xx)"""


@query(
    f"""WITH {GREY}, {_BOX}, {_LABEL} SELECT DISTINCT lw.w AS "window", ym.y, xm.x FROM lw JOIN lab ON lab.z = least(round_even(lw.w / 2.0::DOUBLE, 0)::BIGINT, last) AND lab.y >= ly0 AND lab.y < ly0 + lh AND lab.x >= lx0 AND lab.x < lx0 + lw.lw
JOIN ym ON ym.w = lw.w AND sy = lab.y - ly0 JOIN xm ON xm.w = lw.w AND sx = lab.x - lx0"""
)
def label_window(spark, sf):
    """Two label classes on grids half as fine, put together on the raw windows' pixels."""
    return windows.labels(crop_windows(spark, sf), 4)


@query(f"WITH {GREY} SELECT z, y, x, g::DOUBLE AS v FROM grey WHERE z >= 130 AND z < 300 AND z % 2 = 0 AND y IN (1, 4) AND x <= 5 AND g > 100")
def volume_format(spark, sf):
    """A volume through spark.read: bounds on its axes prune chunks and voxels."""
    depth = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    root = _folder(spark, "volume")
    zarr.write_volume(grey(spark, sf).select("z", "y", "x", F.col("g").alias("v")), root, (depth, 8, 8))
    formats.register(spark)
    v = spark.read.format("volume").option("stride", 2).load(root)
    return v.filter("z >= 130 AND z < 300 AND y IN (1, 4) AND x <= 5 AND v > 100")


def _pixels(files):
    """name, y, x, label of PNG files (name, content)."""

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                p = images.decode_png(content)
                y, x = np.nonzero(p)
                yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(y), pa.string()), "y": y, "x": x, "label": p[y, x].astype(np.int64)})

    return files.mapInArrow(decode, "name string, y long, x long, label long")


def _read_back(files, root):
    """name, content of the files."""
    return read_back(files, root, "content", text=False)


@query(f"{EIGHT}, n AS (SELECT DISTINCT img_id, first FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY first) AS label FROM n) SELECT img_id, y, x, label FROM c JOIN k USING (img_id, first)")
def mask_png_files(spark, sf):
    """Instance masks as PNG files in folders of ten, written by tasks and decoded again."""
    found = masks.relabelled(masks.components(mask(spark, sf), True, 8))
    name = F.concat(F.expr("img_id div 10").cast("string"), F.lit("/z"), F.format_string("%04d", "img_id"), F.lit(".png"))
    root = _folder(spark, "masks")
    formats.register(spark)
    files, _ = scratch.materialize(images.png_of(found, 8, 8).select(name.alias("name"), "content"), "pngs")
    files = files.repartition(parts(spark, files.count(), FILES))
    for _ in range(2):  # a second run leaves the same files
        files.write.format("files").mode("append").save(root)
    return _pixels(_read_back(files, root)).select(F.regexp_extract("name", r"z(\d+)\.png", 1).cast("long").alias("img_id"), "y", "x", "label")


@query(f"{runs._LOOP} SELECT run, i, len(list_filter(e, lambda x: x > c)) AS foreground FROM loop WHERE ok AND len(list_filter(e, lambda x: x > c)) > 0")
def iteration_files(spark, sf):
    """The mask of each iteration of the refinement loop as a PNG file in the iteration's folder, counted when read back."""
    h = runs.refined_slices(spark, sf).history.filter("error IS NULL")

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            content = [images.encode_png(np.frombuffer(m, np.uint8).reshape(8, 8) * 255) for m in batch.column("image").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(content, pa.binary())], ["name", "content"])

    name = F.concat(F.lit("iteration_"), F.format_string("%02d", "i"), F.lit("/mask_"), F.col("run").cast("string"), F.lit(".png"))
    root = _folder(spark, "iterations")
    formats.register(spark)
    files = h.select(name.alias("name"), "image")
    files.mapInArrow(encode, "name string, content binary").write.format("files").mode("append").save(root)
    found = _pixels(_read_back(files, root)).select(F.regexp_extract("name", r"mask_(\d+)\.png", 1).cast("long").alias("run"), F.regexp_extract("name", r"iteration_(\d+)", 1).cast("int").alias("i"))
    return found.groupBy("run", "i").agg(F.count(F.lit(1)).alias("foreground"))
