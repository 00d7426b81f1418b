"""Queries that go through sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planestack.operators import masks, normalize, refine
from planestack.plans.base import GREY, HISTORY, VOX, grey, history, mask, query, table, voxels
from planestack.plans.images import EIGHT
from planestack.sources import images, reports, scratch, zarr
from planestack.streaming import history as streams


@query(f"WITH {GREY} SELECT z, y, x, g::DOUBLE AS v FROM grey WHERE z >= 40 AND z < 290 AND (z - 40) % 3 = 0 AND y >= 2 AND y < 7 AND x < 5")
def zarr_region(spark, sf):
    """A volume is written in chunks, and a region of it read back at a stride."""
    rows = grey(spark, sf)
    depth = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    root = f"{scratch.shared_dir(spark)}/volume-{uuid.uuid4().hex}"
    zarr.write_volume(rows.select("z", "y", "x", F.col("g").alias("v")), root, (depth, 8, 8), resolution=(4.0, 2.0, 2.0), offset=(100.0, 0.0, 0.0))
    return zarr.read_volume(spark, root, roi=[(260.0, 1259.0), (4.0, 13.5), (0.0, 10.0)], stride=3)


@query(f"WITH {GREY} SELECT z, y, x, CASE WHEN z BETWEEN 128 AND 255 THEN 0.0 ELSE g END::DOUBLE AS v FROM grey")
def zarr_sparse(spark, sf):
    """A volume whose chunk from slice 128 on isn't stored: it reads as the fill value."""
    rows = grey(spark, sf).filter("z NOT BETWEEN 128 AND 255")
    depth = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    root = f"{scratch.shared_dir(spark)}/volume-{uuid.uuid4().hex}"
    zarr.write_volume(rows.select("z", "y", "x", F.col("g").alias("v")), root, (depth, 8, 8), sparse=True)
    return zarr.read_volume(spark, root)


@query(f"WITH {GREY} SELECT z, y, x, g::DOUBLE AS v FROM grey WHERE z BETWEEN 3 AND 98 AND (z - 3) % 5 = 0")
def zarr_slice_index(spark, sf):
    """Twenty slices by index, every fifth from the fourth on."""
    depth = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    root = f"{scratch.shared_dir(spark)}/volume-{uuid.uuid4().hex}"
    zarr.write_volume(grey(spark, sf).select("z", "y", "x", F.col("g").alias("v")), root, (depth, 8, 8))
    return zarr.read_slices(spark, root, 3, 20, 5)


@query("SELECT axis, n, voxel, origin, first, size FROM (SELECT unnest(['z', 'y', 'x']) AS axis, unnest([max(vec_id) + 1, 8, 8])::BIGINT AS n, unnest([4.0, 2.0, 2.0])::DOUBLE AS voxel, unnest([100.0, 0.0, 0.0])::DOUBLE AS origin, unnest([40, 2, 0])::BIGINT AS first, unnest([60, 5, 5])::BIGINT AS size FROM embeddings)")
def zarr_info(spark, sf):
    """Shape, voxel size, offset and a region's voxels, a row for each axis."""
    depth = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    root = f"{scratch.shared_dir(spark)}/volume-{uuid.uuid4().hex}"
    zarr.write_volume(grey(spark, sf).limit(0).select("z", "y", "x", F.col("g").alias("v")), root, (depth, 8, 8), resolution=(4.0, 2.0, 2.0), offset=(100.0, 0.0, 0.0), sparse=True)
    row = zarr.info(spark, root, roi=[(260.0, 499.0), (4.0, 13.5), (0.0, 10.0)])
    each = row.select(F.explode(F.arrays_zip(F.array(*[F.lit(a) for a in "zyx"]).alias("axis"), "shape", "voxel_size", "offset", "begin", "size")).alias("a"))
    return each.select("a.axis", F.col("a.shape").alias("n"), F.col("a.voxel_size").alias("voxel"), F.col("a.offset").alias("origin"), F.col("a.begin").alias("first"), "a.size")


@query(f"{EIGHT}, n AS (SELECT DISTINCT img_id, first FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY first) AS label FROM n) SELECT img_id, y, x, label FROM c JOIN k USING (img_id, first)")
def png_roundtrip(spark, sf):
    """Labelled masks as 16-bit PNG files, decoded again."""
    found = masks.relabelled(masks.components(mask(spark, sf), True, 8))

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for img_id, content in zip(batch.column("img_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                p = images.decode_png(content)
                y, x = np.nonzero(p)
                yield pa.RecordBatch.from_pydict({"img_id": np.full(len(y), img_id, np.int64), "y": y, "x": x, "label": p[y, x].astype(np.int64)})

    return images.png_of(found, 8, 8).mapInArrow(decode, "img_id long, y long, x long, label long")


@query(f"WITH {VOX} SELECT z, y, x, round(v, 6) AS v FROM vox")
def sinc_resize_identity(spark, sf):
    """Resampling to the same size changes nothing."""
    return images.resampled(voxels(spark, sf), (8, 8)).select("z", "y", "x", F.round("v", 6).alias("v"))


@query(
    f"""WITH {HISTORY}, h AS (SELECT run, i, score, max(score) OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING) AS best FROM history)
SELECT run, i, score, best, score < best - 0.1::DOUBLE AS reverted FROM h"""
)
def evaluation_report(spark, sf):
    """The JSON of evaluations, parsed again."""
    lines = reports.evaluation_json(refine.annotated(history(spark, sf)))
    shape = "run long, i long, evaluation struct<score:double,best:double,reverted:boolean>"
    r = lines.select(F.from_json("value", shape).alias("r"))
    return r.select("r.run", "r.i", "r.evaluation.score", "r.evaluation.best", "r.evaluation.reverted")


@query(f"WITH {VOX} SELECT label::VARCHAR AS dataset, round(quantile_cont(v, 0.01), 1) AS min, round(quantile_cont(v, 0.99), 1) AS max FROM vox GROUP BY label")
def norms_csv(spark, sf):
    """Norms written as CSV and read again."""
    path = f"{scratch.shared_dir(spark)}/norms-{uuid.uuid4().hex}"
    reports.write_norms(normalize.auto_norms(voxels(spark, sf), "label", "v").withColumnRenamed("label", "dataset"), path)
    return spark.read.schema("dataset string, min double, max double, inverted string, set_norm string").option("header", True).csv(path).select("dataset", "min", "max")


@query(
    f"""WITH {HISTORY}, f AS (SELECT run, min(i) FILTER (score >= 95) AS stop FROM history GROUP BY run), s AS (SELECT history.*, stop FROM history JOIN f USING (run) WHERE stop IS NULL OR i <= stop)
SELECT run, count(*) AS iterations, bool_or(stop IS NOT NULL) AS converged, max(score) AS best, arg_min(i, struct_pack(a := -score, b := i)) AS best_i FROM s GROUP BY run"""
)
def stream_early_stop(spark, sf):
    """Early stop as a stream over all events that are there, its updates gathered in a table."""
    folder = f"{scratch.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    scores = spark.readStream.schema(schema).parquet(f"{sf}/events.parque*").select(F.col("user_id").alias("run"), "ts", "event_id", F.col("value").alias("score"))

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    job = streams.early_stop(scores, 95.0).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    names = ["iterations", "converged", "best", "best_i"]
    last = spark.read.parquet(f"{folder}/out").groupBy("run").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return last.select("run", *[F.col(f"s.{n}").alias(n) for n in names])


@query(f"WITH {HISTORY} SELECT run, count(*) AS iterations, max(score) AS best, round(avg(score), 6) AS mean FROM history GROUP BY run")
def run_summaries(spark, sf):
    """The JSON of whole runs, parsed again."""
    lines = reports.run_summary(history(spark, sf))
    r = lines.select(F.from_json("value", "run long, iterations long, best double, mean double").alias("r"))
    return r.select("r.run", "r.iterations", "r.best", F.round("r.mean", 6).alias("mean"))
