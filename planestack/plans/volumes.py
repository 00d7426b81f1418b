"""Queries on volumes and refinement histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planestack import dims
from planestack.functions import geometry
from planestack.operators import refine, volume
from planestack.plans.base import HISTORY, VOX, history, query, table, voxels


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z >= 100 AND z < 200 AND y >= 2 AND y < 6 AND x >= 1 AND x < 7")
def roi_crop(spark, sf):
    return geometry.box(voxels(spark, sf), z=(100, 200), y=(2, 6), x=(1, 7)).select("z", "y", "x", "v")


@query(
    """SELECT p_partkey, greatest(floor((b - 16) / 7.5::DOUBLE)::BIGINT, 0) AS first, least(ceil((b + w - 16) / 7.5::DOUBLE)::BIGINT, 200) AS last
FROM (SELECT p_partkey, p_partkey % 1000 AS b, p_size::BIGINT AS w FROM part)"""
)
def roi_snap_grow(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 1000).alias("b"), F.col("p_size").cast("long").alias("w"))
    s = geometry.snapped(F.col("b"), F.col("b") + F.col("w"), F.lit(7.5), F.lit(16), F.lit(200).cast("long"))
    return p.select("p_partkey", s["first"].alias("first"), s["last"].alias("last"))


@query("SELECT p_partkey, [o, o + 5, o + 10]::BIGINT[]::VARCHAR AS off, [w, w + 1, w + 2]::BIGINT[]::VARCHAR AS shape FROM (SELECT p_partkey, p_partkey % 50 AS o, p_size::BIGINT AS w FROM part)")
def roi_parse(spark, sf):
    p = table(spark, sf, "part")
    o, w = F.col("p_partkey") % 50, F.col("p_size").cast("long")
    text = F.concat(F.lit("["), F.concat_ws(",", *[F.concat_ws(":", (o + 5 * k).cast("string"), (o + 5 * k + w + k).cast("string")) for k in range(3)]), F.lit("]"))
    r = geometry.parse_roi(text)
    show = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, lambda n: n.cast("string")), ", "), F.lit("]"))
    return p.select("p_partkey", show(r["offset"]).alias("off"), show(r["shape"]).alias("shape"))


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE z % 5 = 0")
def zstride(spark, sf):
    return volume.strided(voxels(spark, sf), geometry.stride(40, 8)).select("z", "y", "x", "v")


@query(
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT DISTINCT user_id, CASE WHEN k = least(7, n) - 1 THEN n - 1 ELSE floor(k * ((n - 1) / (least(7, n) - 1)::DOUBLE))::BIGINT END AS index
FROM n, range(7) t(k) WHERE k < least(7, n) AND n > 1"""
)
def even_sample(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    m = F.least(F.lit(7), F.col("n"))
    rows = n.select("user_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), m - 1)).alias("k"))
    return rows.select("user_id", geometry.even_index(F.col("k"), F.col("n"), m).alias("index")).distinct()


_EVEN8 = "(SELECT DISTINCT CASE WHEN k = m - 1 THEN 7 ELSE floor(k * (7 / (m - 1)::DOUBLE))::BIGINT END AS index FROM range(8) t(k), (SELECT least(8, (max(vec_id) // 50) + 1) AS m FROM embeddings) WHERE k < m)"


@query(
    f"""WITH {VOX} SELECT 'xy' AS plane, z AS index, y AS row, x AS col, v FROM vox WHERE z % 50 = 0
UNION ALL SELECT 'xz', y, z, x, v FROM vox JOIN {_EVEN8} i ON y = i.index UNION ALL SELECT 'yz', x, z, y, v FROM vox JOIN {_EVEN8} i ON x = i.index"""
)
def ortho_planes(spark, sf):
    return volume.ortho_planes(voxels(spark, sf), 50)


@query(
    """WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), i AS (SELECT unnest(range(n)) AS i FROM n), s AS (SELECT i AS s FROM i WHERE i % 7 = 0)
SELECT i AS index, arg_min(s, struct_pack(d := abs(i - s), s := s)) AS source FROM i, s WHERE abs(i - s) <= 7 GROUP BY i"""
)
def nearest_slice(spark, sf):
    n = table(spark, sf, "embeddings").agg(F.max("vec_id") + 1).first()[0]
    return volume.nearest_sampled(spark.range(n).withColumnRenamed("id", "index"), spark.range(0, n, 7).withColumnRenamed("id", "index"))


@query(
    f"""WITH {VOX}, m AS (SELECT z AS s, y, x FROM vox WHERE z % 7 = 0 AND v > 0.1::DOUBLE), i AS (SELECT DISTINCT z FROM vox), s AS (SELECT z AS s FROM i WHERE z % 7 = 0),
b AS (SELECT i.z, arg_min(s.s, struct_pack(d := abs(i.z - s.s), s := s.s)) AS s FROM i, s WHERE abs(i.z - s.s) <= 7 GROUP BY i.z) SELECT b.z, y, x FROM m JOIN b USING (s)"""
)
def nearest_slice_fill(spark, sf):
    v = voxels(spark, sf)
    nz = volume.extent(v)[0]
    slices = v.filter("z % 7 = 0 AND v > 0.1").select(F.col("z").alias("index"), F.col("y").alias("row"), F.col("x").alias("col"))
    # Every seventh slice has some foreground or stands empty: its positions are given by the stride, not by the mask.
    axis = spark.range(0, nz, 7).withColumnRenamed("id", "index")
    source = volume.nearest_sampled(spark.range(nz).withColumnRenamed("id", "index"), axis).withColumnRenamed("index", "z")
    return slices.join(source, F.col("index") == F.col("source")).select("z", F.col("row").alias("y"), F.col("col").alias("x"))


def _thresholds(spark, sf):
    v = voxels(spark, sf)
    return [v.filter(c) for c in ("v > 0.1", "v * y > 0.5", "v * x > 0.4")]


@query(f"WITH {VOX} SELECT z, y, x FROM vox WHERE (v > 0.1::DOUBLE)::INT + (v * y > 0.5::DOUBLE)::INT + (v * x > 0.4::DOUBLE)::INT >= 2")
def majority_vote(spark, sf):
    return volume.majority(_thresholds(spark, sf))


@query(f"WITH {VOX} SELECT z, y, x FROM vox WHERE v > 0.1::DOUBLE OR v * y > 0.5::DOUBLE")
def majority_vote_two(spark, sf):
    return volume.majority(_thresholds(spark, sf)[:2])


@query(
    f"""WITH {VOX} SELECT z, y, x, least(greatest(round_even((y * 16 + 3 - 1) / 12.0::DOUBLE, 0), 0.0::DOUBLE), 9.0::DOUBLE)::BIGINT AS to_y,
    least(greatest(round_even((x * 16 - 5 - 1) / 12.0::DOUBLE, 0), 0.0::DOUBLE), 9.0::DOUBLE)::BIGINT AS to_x FROM vox"""
)
def world_voxel(spark, sf):
    to = lambda c, shift: geometry.voxel_of(F.col(c) * 16 + shift, F.lit(1), F.lit(12.0), F.lit(10.0))
    return voxels(spark, sf).select("z", "y", "x", to("y", 3).alias("to_y"), to("x", -5).alias("to_x"))


@query(
    f"""WITH {VOX}, a AS (SELECT z, y, x, v, least(greatest(round_even(y * 4 / 8.0::DOUBLE, 0), 0.0::DOUBLE), 3.0::DOUBLE)::BIGINT AS ly, least(greatest(round_even(x * 4 / 8.0::DOUBLE, 0), 0.0::DOUBLE), 3.0::DOUBLE)::BIGINT AS lx FROM vox),
l AS (SELECT z, y, x, v > 0.1::DOUBLE AS label FROM vox WHERE y < 4 AND x < 4) SELECT a.z, a.y, a.x, a.v, l.label FROM a JOIN l ON a.z = l.z AND a.ly = l.y AND a.lx = l.x"""
)
def raw_label_join(spark, sf):
    v = voxels(spark, sf)
    at = lambda c: geometry.voxel_of(F.col(c) * 4, F.lit(0), F.lit(8.0), F.lit(4.0))
    label = v.filter("y < 4 AND x < 4").select("z", F.col("y").alias("ly"), F.col("x").alias("lx"), (F.col("v") > 0.1).alias("label"))
    return v.drop("label").withColumns({"ly": at("y"), "lx": at("x")}).join(label, ["z", "ly", "lx"]).select("z", "y", "x", "v", "label")


@query(f"WITH {VOX} SELECT z, y, x, v FROM vox WHERE y % 2 = 0 AND x % 2 = 0")
def strided_pixels(spark, sf):
    step = max(1, int((2_000_000 / 500_000) ** 0.5))
    return voxels(spark, sf).filter((F.col("y") % step == 0) & (F.col("x") % step == 0)).select("z", "y", "x", "v")


@query(f"WITH {VOX}, m AS (SELECT label, list(z ORDER BY z) AS l FROM (SELECT DISTINCT label, z FROM vox) GROUP BY label) SELECT label, l[len(l) // 2 + 1] AS middle FROM m")
def middle_slice(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("z")).distinct()
    rank, n = F.row_number().over(Window.partitionBy("label").orderBy("z")), F.count(F.lit(1)).over(Window.partitionBy("label"))
    return rows.withColumns({"r": rank, "n": n}).filter("r = n div 2 + 1").select("label", F.col("z").alias("middle"))


@query("SELECT user_id, arg_min(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")
def first_claim(spark, sf):
    e = table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return volume.first_claim(e, ["user_id"], "o", "event_type")


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")
def last_writer(spark, sf):
    e = table(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return volume.last_writer(e, ["user_id"], "o", "event_type")


@query(
    """WITH f AS (SELECT user_id, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1), r AS (SELECT user_id, max(value) AS value FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT coalesce(f.user_id, r.user_id) AS user_id, coalesce(f.value, r.value) AS value FROM f FULL JOIN r ON f.user_id = r.user_id"""
)
def propagation_merge(spark, sf):
    e = table(spark, sf, "events")
    top = lambda c: e.filter(c).groupBy("user_id").agg(F.max("value").alias("value"))
    return volume.merged(top("event_type = 'view'"), top("event_type <> 'view'"), ["user_id"], "value")


@query(
    """WITH o AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id) AS top, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events)
SELECT user_id, event_id, value FROM o WHERE value >= 60 OR (top < 60 AND rn = 1)"""
)
def confidence_union(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value", F.col("event_id").alias("ordinal"))
    return volume.confident_union(e, "user_id", "value", 60.0).select("user_id", "event_id", "value")


@query(
    f"""WITH {HISTORY} SELECT run, i, score, round(coalesce(score - lag(score) OVER w, 0), 6) AS delta, max(score) OVER s AS best, score < max(score) OVER s - 0.1::DOUBLE AS reverted
FROM history WINDOW w AS (PARTITION BY run ORDER BY i), s AS (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING)"""
)
def score_history(spark, sf):
    return refine.annotated(history(spark, sf)).select("run", "i", "score", F.round("delta", 6).alias("delta"), "best", "reverted")


@query(
    f"""WITH {HISTORY}, f AS (SELECT run, min(i) FILTER (score >= 95) AS stop FROM history GROUP BY run), s AS (SELECT history.*, stop FROM history JOIN f USING (run) WHERE stop IS NULL OR i <= stop)
SELECT run, count(*) AS iterations, bool_or(stop IS NOT NULL) AS converged, max(score) AS best, arg_min(i, struct_pack(a := -score, b := i)) AS best_i FROM s GROUP BY run"""
)
def early_stop(spark, sf):
    return refine.stopped(history(spark, sf), 95.0)


@query(f"WITH {HISTORY} SELECT run, count(*) AS slices, round(avg(score), 6) AS mean_score, count(*) FILTER (score >= 50) AS good FROM history GROUP BY run")
def slice_summary(spark, sf):
    return history(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("slices"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("score") >= 50).alias("good"))


@query(
    f"""WITH {HISTORY} SELECT run, i, round(least(greatest(s + s * 0.05::DOUBLE * d, 0.3::DOUBLE), 1.0::DOUBLE), 9) AS strength, round_even(least(greatest(n + n * 0.05::DOUBLE * d, 15.0::DOUBLE), 50.0::DOUBLE), 0)::BIGINT AS steps
FROM (SELECT run, i, score / 100 AS s, 15 + i % 36 AS n, CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS d FROM history)"""
)
def param_step(spark, sf):
    t = dims.TUNABLE["flux"]
    d = F.when(F.col("i") % 2 == 0, 1).otherwise(-1)
    return history(spark, sf).select(
        "run", "i",
        F.round(refine.stepped(F.col("score") / 100, d, *t["strength"]), 9).alias("strength"),
        refine.stepped(15 + F.col("i") % 36, d, *t["num_inference_steps"], whole=True).alias("steps"),
    )


@query(f"WITH {HISTORY} SELECT run, i, (['oval', 'circle', 'organelle'])[(i + 1) % 3 + 1] AS prompt FROM history")
def cyclic_prompt(spark, sf):
    prompts = F.array(*[F.lit(p) for p in dims.SYNONYMS["mito"][:3]])
    return history(spark, sf).select("run", "i", refine.next_prompt(F.col("i"), prompts).alias("prompt"))


@query(
    "SELECT event_id, CASE WHEN n <> 28 THEN n ELSE 50 END AS num_inference_steps, CASE WHEN g <> 3.5 THEN g ELSE 1.5 END AS guidance_scale FROM (SELECT event_id, 20 + event_id % 10 AS n, (event_id % 8 / 2.0)::DOUBLE AS g FROM events)"
)
def sentinel_defaults(spark, sf):
    p = table(spark, sf, "events").select("event_id", (20 + F.col("event_id") % 10).alias("num_inference_steps"), (F.col("event_id") % 8 / 2.0).alias("guidance_scale"), F.lit(0.75).alias("strength"))
    return refine.with_defaults(p, "glm").select("event_id", F.col("num_inference_steps").cast("long").alias("num_inference_steps"), "guidance_scale")


@query("SELECT event_id, round(sg * sg * 0.25::DOUBLE, 9) AS loss, sg FROM (SELECT event_id, round(1 / (1 + exp(-(value / 50 - 1))), 9) AS sg FROM events)")
def flow_loss(spark, sf):
    sigma = F.round(1 / (1 + F.exp(-(F.col("value") / 50 - 1))), 9)
    return table(spark, sf, "events").select("event_id", sigma.alias("sg")).select("event_id", F.round(F.col("sg") * F.col("sg") * 0.25, 9).alias("loss"), "sg")


@query("SELECT t.t AS t, h.h AS h, w.w AS w, l.l AS l FROM range(1) t(t), range(6) h(h), range(9) w(w), range(1) l(l)")
def position_ids(spark, sf):
    one = lambda n, c: spark.range(n).withColumnRenamed("id", c)
    return one(1, "t").crossJoin(one(6, "h")).crossJoin(one(9, "w")).crossJoin(one(1, "l"))  # fixed sizes: 54 rows
