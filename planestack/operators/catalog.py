"""The crop catalog: listings and scale metadata joined to crops, classes and norms."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.operators import normalize
from planestack.sources import scratch, stores

SMALL = 1024


def scales(attrs: DataFrame) -> DataFrame:
    """path, ordinal, scale, resolution, offset of each scale in multiscale metadata (path, json).

    The first transformation is the scale and the second the translation, by position; without one the offset is 0.
    """
    schema = "multiscales array<struct<datasets:array<struct<path:string,coordinateTransformations:array<struct<scale:array<double>,translation:array<double>>>>>>>"
    rows = attrs.withColumn("a", F.from_json("json", schema)).select("path", F.posexplode(F.col("a.multiscales")[0]["datasets"]).alias("ordinal", "d"))
    t = F.col("d.coordinateTransformations")
    return rows.select("path", "ordinal", F.col("d.path").alias("scale"), F.get(t, F.lit(0))["scale"].alias("resolution"), F.coalesce(F.get(t, F.lit(1))["translation"], F.array(*[F.lit(0.0)] * 3)).alias("offset"))


def finest(scale_rows: DataFrame, group: list[str], res: str = "res", ordinal: str = "ordinal") -> DataFrame:
    """The row with the smallest resolution value in each group, the first of equals."""
    names = [c for c in scale_rows.columns if c not in group]
    best = scale_rows.groupBy(*group).agg(F.min_by(F.struct(*names), F.struct(res, ordinal)).alias("b"))
    return best.select(*group, *[F.col(f"b.{c}").alias(c) for c in names])


def closest(scale_rows: DataFrame, group: list[str], target: float, most: float = 2.0, res: str = "res", ordinal: str = "ordinal") -> DataFrame:
    """The row whose resolution is closest to the target, within a ratio, the first of equals."""
    ratio = F.greatest(F.col(res) / target, F.lit(target) / F.col(res))
    return finest(scale_rows.filter(ratio <= most).withColumn("_d", F.abs(F.col(res) - target)), group, "_d", ordinal).drop("_d")


def raw_store(listing: DataFrame, group: list[str]) -> DataFrame:
    """The 8-bit store of each group (group, name) if there is one, else the 16-bit one; groups without either are left out."""
    first = listing.filter(F.col("name").isin("fibsem-uint8", "fibsem-uint16")).groupBy(*group).agg(F.max_by("name", F.col("name") == "fibsem-uint8").alias("store"))
    return first


def crops(classes: DataFrame, raw: DataFrame, targets: DataFrame, least: float = 16.0) -> DataFrame:
    """Crops with the classes that are targets: dataset, crop_id, annotated (sorted), origin, extent.

    classes: dataset, crop_id, cls_name, resolution, offset, shape (finest scales); raw: dataset, resolution; targets: cls_name.
    The bounding box is that of the first class by name. Crops under `least` raw voxels along any axis are left out. Targets and
    raw stores (a row for each class, for each dataset) are sent to all tasks, as their few keys would not spread the crops.
    """
    c = classes.filter(F.col("crop_id").startswith("crop")).join(F.broadcast(targets), "cls_name", "left_semi")
    boxed = c.groupBy("dataset", "crop_id").agg(
        F.sort_array(F.collect_set("cls_name")).alias("annotated"),  # a crop has as many classes as there are targets at most
        F.min_by(F.struct("offset", "resolution", "shape"), "cls_name").alias("ref"),
    )
    extent = F.zip_with("ref.shape", "ref.resolution", lambda n, r: n * r)
    rows = boxed.select("dataset", "crop_id", "annotated", F.col("ref.offset").alias("origin"), extent.alias("extent"))
    rows = rows.join(F.broadcast(raw.select("dataset", F.col("resolution").alias("_r"))), "dataset")
    return rows.filter(F.forall(F.zip_with("extent", "_r", lambda e, r: e / r), lambda n: n >= least)).drop("_r")


def is_small(extent: Column, resolution: Column) -> Column:
    """All of a crop's rows and columns number under SMALL."""
    return (extent[1] / resolution[1] < SMALL) & (extent[2] / resolution[2] < SMALL)


def by_organelle(crop_classes: DataFrame, bridge: DataFrame, partitions: int | None = None) -> DataFrame:
    """organelle_key, dataset, crop_id of the crops with any of an organelle's classes (crop_classes: dataset, crop_id, cls_name).

    The bridge has a row for each fine class and is sent to all tasks, as a shuffle by class would have a few keys for all crops.
    partitions: by crop, into as many as the caller knows to fit; otherwise they are the session's.
    """
    rows = crop_classes.join(F.broadcast(bridge.select("organelle_key", "cls_name")), "cls_name").select("organelle_key", "dataset", "crop_id")
    return (rows.repartition(partitions, "dataset", "crop_id") if partitions else rows).distinct()


def cache_key(arguments: Column) -> Column:
    """Name of a cached catalog: the first twelve hex digits of the md5 of its arguments as JSON."""
    return F.substring(F.md5(F.to_json(arguments).cast("binary")), 1, 12)


def effective(cli: Column, config: Column, default) -> Column:
    """An explicit command-line value, else the config's, else the default."""
    return F.coalesce(cli, config, F.lit(default))


def finest_of(groups: DataFrame, keys: list[str], path: str) -> DataFrame:
    """keys, path, scale, resolution, offset, shape, array of the finest scale of each multiscale group (keys, path).

    All metadata are read by tasks. A group without readable metadata, or with a scale that lacks a translation or an array, is
    left out. array: the scale's own description as JSON.
    """
    schema = "multiscales array<struct<datasets:array<struct<path:string,coordinateTransformations:array<struct<scale:array<double>,translation:array<double>>>>>>>"
    rows = stores.contents(groups.select(*keys, F.col(path).alias("path")).repartition("path"), F.concat("path", F.lit("/.zattrs")), "_attrs")
    rows = rows.withColumn("_d", F.from_json("_attrs", schema)["multiscales"][0]["datasets"]).drop("_attrs")
    t = lambda d, i: F.get(d["coordinateTransformations"], F.lit(i))
    whole = F.forall("_d", lambda d: t(d, 0)["scale"].isNotNull() & t(d, 1)["translation"].isNotNull())
    each = rows.filter((F.size("_d") > 0) & whole).withColumn("_n", F.size("_d")).select("*", F.posexplode("_d").alias("ordinal", "_s")).drop("_d")
    each = stores.contents(each, F.concat("path", F.lit("/"), F.col("_s.path"), F.lit("/.zarray")), "array")
    each = each.withColumn("shape", F.from_json("array", "shape array<bigint>")["shape"])
    fields = F.struct(F.col("_s.path").alias("scale"), t(F.col("_s"), 0)["scale"].alias("resolution"), t(F.col("_s"), 1)["translation"].alias("offset"), "shape", "array")
    best = each.groupBy(*keys, "path", "_n").agg(F.min_by(fields, F.struct(t(F.col("_s"), 0)["scale"][1], F.col("ordinal"))).alias("b"), F.count("shape").alias("have"))
    return best.filter("have = _n").select(*keys, "path", "b.*")


def discover(spark: SparkSession, root: str, targets: DataFrame, include: list[str] | None = None, skip: list[str] | None = None, least: float = 16.0) -> DataFrame:
    """dataset, crop_id, raw (path, scale, resolution, offset, shape, array), classes (array of the same with cls_name), annotated,
    origin, extent of every crop under a root that has a target class (cls_name) and `least` raw voxels along each axis.

    The tree is walked by tasks: datasets that are skipped or lack a raw store aren't listed below, nor are folders that aren't
    crops; metadata are read for target classes alone. The box is that of the first class by name.
    """
    top = spark.range(1).select(F.lit(root).alias("path"))
    datasets = stores.children(top).filter("is_dir").select(F.col("name").alias("dataset"))
    if include is not None:
        datasets = datasets.filter(F.col("dataset").isin(include))
    if skip:
        datasets = datasets.filter(~F.col("dataset").isin(skip))
    of = lambda below: F.concat(F.lit(f"{root}/"), F.col("dataset"), F.lit("/"), F.col("dataset"), F.lit(f".zarr/recon-1/{below}"))
    em = stores.children(datasets.withColumn("path", of("em"))).filter("is_dir")
    raw = raw_store(em, ["dataset", "path"]).withColumn("path", F.concat("path", F.lit("/"), "store"))
    raw = finest_of(raw, ["dataset"], "path").select("dataset", F.struct("path", "scale", "resolution", "offset", "shape", "array").alias("raw"))
    raw, _ = scratch.materialize(raw, "raw-stores")
    crop_dirs = stores.children(raw.select("dataset", of("labels/groundtruth").alias("path"))).filter(F.col("is_dir") & F.col("name").startswith("crop"))
    crop_dirs = crop_dirs.select("dataset", F.col("name").alias("crop_id"), F.concat("path", F.lit("/"), "name").alias("path"))
    classes = stores.children(crop_dirs).filter("is_dir").withColumnRenamed("name", "cls_name").join(targets.select("cls_name").distinct(), "cls_name", "left_semi")
    classes = finest_of(classes.withColumn("path", F.concat("path", F.lit("/"), "cls_name")), ["dataset", "crop_id", "cls_name"], "path")
    info = F.struct("cls_name", "path", "scale", "resolution", "offset", "shape", "array")
    found = classes.groupBy("dataset", "crop_id").agg(F.sort_array(F.collect_list(info)).alias("classes"))  # as many as there are targets at most
    first = F.col("classes")[0]
    extent = F.zip_with(first["shape"], first["resolution"], lambda n, r: n * r)
    found = found.withColumns({"annotated": F.transform("classes", lambda c: c["cls_name"]), "origin": first["offset"], "extent": extent}).join(raw, "dataset")
    return found.filter(F.forall(F.zip_with("extent", "raw.resolution", lambda e, r: e / r), lambda n: n >= least))


def cached(spark: SparkSession, folder: str, arguments: dict, build, norms: DataFrame) -> DataFrame:
    """A catalog (with dataset) from the cache of its arguments, or built and kept there; with the norms of now, whatever it was built with.

    The cache's name is that of cache_key over the arguments in order of their names. A cache counts once it is whole.
    """
    text = json.dumps({k: sorted(v) if isinstance(v, (set, list, tuple)) else v for k, v in arguments.items()}, sort_keys=True)
    key = spark.range(1).select(F.substring(F.md5(F.lit(text).cast("binary")), 1, 12)).first()[0]
    path = f"{folder}/crops_cache_{key}"
    fs, at = scratch._hadoop(spark, f"{path}/_SUCCESS")
    if not fs.exists(at):
        build().write.mode("overwrite").parquet(path)
    return normalize.with_norms(spark.read.parquet(path), norms, "dataset")
