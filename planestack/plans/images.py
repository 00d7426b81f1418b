"""Queries on pixels and masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planestack import dims
from planestack.functions import geometry, pixels
from planestack.operators import masks, normalize
from planestack.plans.base import GREY, MASK, RGB, VOX, grey, mask, query, rgb, table, voxels

RED, ORANGE = (255, 0, 0), (255, 128, 0)


@query(f"WITH {VOX} SELECT label, round(quantile_cont(v, 0.01), 1) AS min, round(quantile_cont(v, 0.99), 1) AS max FROM vox GROUP BY label")
def auto_norms(spark, sf):
    return normalize.auto_norms(voxels(spark, sf), "label", "v")


@query("SELECT l_returnflag AS dataset, round(quantile_cont(l_extendedprice, 0.01), 1) AS min, round(quantile_cont(l_extendedprice, 0.99), 1) AS max FROM lineitem GROUP BY 1")
def auto_norms_prices(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset"), "l_extendedprice")
    return normalize.auto_norms(rows, "dataset", "l_extendedprice")


@query(
    f"""WITH {VOX}, n AS (SELECT label, round(quantile_cont(v, 0.01), 1) AS lo, round(quantile_cont(v, 0.99), 1) AS hi FROM vox GROUP BY label)
SELECT z, y, x, label, round(least(greatest((v - lo) / CASE WHEN hi - lo = 0 THEN 1.0 ELSE hi - lo END, 0.0), 1.0), 6) AS v FROM vox JOIN n USING (label)"""
)
def normalize_pixels(spark, sf):
    rows = voxels(spark, sf)
    out = normalize.normalize(rows, normalize.auto_norms(rows, "label", "v"), "label", "v")
    return out.select("z", "y", "x", "label", F.round("v", 6).alias("v"))


@query(
    f"""WITH {VOX}, w AS (SELECT z, y, x, round(v * 1000)::BIGINT AS w FROM vox), n AS (SELECT z, quantile_cont(w, 0.01) AS lo, quantile_cont(w, 0.99) AS hi FROM w GROUP BY z)
SELECT w.z, y, x, trunc((least(greatest(w, lo), CASE WHEN hi <= lo THEN lo + 1 ELSE hi END) - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo) * 255 + 1e-9)::INTEGER AS u8 FROM w JOIN n ON w.z = n.z"""
)
def percentile_uint8(spark, sf):
    rows = voxels(spark, sf).select("z", "y", "x", F.round(F.col("v") * 1000).cast("long").alias("w"))
    p = rows.groupBy("z").agg(F.percentile("w", F.array(F.lit(0.01), F.lit(0.99))).alias("p"))
    low, high = F.col("p")[0], F.col("p")[1]
    top = F.when(high <= low, low + 1).otherwise(high)
    return rows.join(p, "z").select("z", "y", "x", ((pixels.clip(F.col("w").cast("double"), low, top) - low) / (top - low) * 255 + 1e-9).cast("int").alias("u8"))


@query(
    f"""WITH {VOX}, n AS (SELECT z, min(v) AS lo, max(v) AS hi FROM vox GROUP BY z)
SELECT vox.z, y, x, CASE WHEN hi > lo THEN trunc(round((v - lo) / (hi - lo) * 255, 6))::BIGINT ELSE 0 END AS g FROM vox JOIN n ON vox.z = n.z"""
)
def minmax_stretch(spark, sf):
    rows = voxels(spark, sf)
    n = rows.groupBy("z").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.round((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255, 6).cast("long")
    return rows.join(n, "z").select("z", "y", "x", F.when(F.col("hi") > F.col("lo"), scaled).otherwise(0).alias("g"))


@query(
    f"""WITH {RGB} SELECT img_id, y, x, least(greatest(r - greatest(g, b), 0), 255)::INTEGER AS red, least(greatest(least(r, g) - b, 0), 255)::INTEGER AS orange,
    (least(greatest(r - greatest(g, b), 0), 255) > 30) AS is_red FROM rgb"""
)
def color_score(spark, sf):
    c = [F.col("r"), F.col("g"), F.col("b")]
    red = pixels.target_score(c, RED)
    return rgb(spark, sf).select("img_id", "y", "x", red.alias("red"), pixels.target_score(c, ORANGE).alias("orange"), (red > 30).alias("is_red"))


@query(f"WITH {RGB} SELECT img_id, y, x, greatest(r, g, b) - least(r, g, b) AS saturation, greatest(r, g, b) - least(r, g, b) > 30 AS saturated FROM rgb")
def saturation(spark, sf):
    s = pixels.saturation([F.col("r"), F.col("g"), F.col("b")])
    return rgb(spark, sf).select("img_id", "y", "x", s.alias("saturation"), (s > 30).alias("saturated"))


@query(f"WITH {RGB} SELECT img_id, y, x, ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16)::BIGINT AS luma, ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) > 127 AS bright, NOT ((r * 19595 + g * 38470 + b * 7471 + 32768) >> 16) > 127 AS inverse FROM rgb")
def luma_threshold(spark, sf):
    v = pixels.luma(F.col("r"), F.col("g"), F.col("b")).cast("long")
    return rgb(spark, sf).select("img_id", "y", "x", v.alias("luma"), (v > 127).alias("bright"), (~(v > 127)).alias("inverse"))


@query(
    f"""WITH {RGB}, m AS (SELECT a.img_id, a.y, a.x, a.r AS r0, a.g AS g0, a.b AS b0, b.r, b.g, b.b FROM rgb a JOIN rgb b ON b.img_id = a.img_id + 1 AND a.y = b.y AND a.x = b.x)
SELECT img_id, y, x, (r - r0 - greatest(abs(g - g0), abs(b - b0)))::DOUBLE AS score, (r - r0 - greatest(abs(g - g0), abs(b - b0))) > 30 AS marked FROM m"""
)
def marker_score(spark, sf):
    a = rgb(spark, sf)
    b = a.select((F.col("img_id") - 1).alias("img_id"), "y", "x", F.col("r").alias("r1"), F.col("g").alias("g1"), F.col("b").alias("b1"))
    s = pixels.marker_score([F.col(c) for c in ("r", "g", "b")], [F.col(c) for c in ("r1", "g1", "b1")], RED)
    return a.join(b, ["img_id", "y", "x"]).select("img_id", "y", "x", s.alias("score"), (s > 30).alias("marked"))


@query(
    f"""WITH {RGB}, s AS (SELECT a.img_id, a.y, a.x, (b.r - a.r - greatest(abs(b.g - a.g), abs(b.b - a.b))) > -60 AS hit FROM rgb a JOIN rgb b ON b.img_id = a.img_id + 1 AND a.y = b.y AND a.x = b.x),
m AS (SELECT img_id, y, x FROM s WHERE hit), r AS (WITH RECURSIVE w(img_id, y, x, f) AS (SELECT img_id, y, x, y * 8 + x FROM m UNION
SELECT m.img_id, m.y, m.x, w.f FROM w JOIN m ON m.img_id = w.img_id AND abs(m.y - w.y) + abs(m.x - w.x) = 1 WHERE w.f < m.y * 8 + m.x) SELECT * FROM w),
c AS (SELECT img_id, y, x, min(f) AS f FROM r GROUP BY ALL)
SELECT img_id, trunc(avg(y))::BIGINT AS y, trunc(avg(x))::BIGINT AS x, count(*) AS area FROM c GROUP BY img_id, f HAVING count(*) BETWEEN 5 AND 2000"""
)
def marker_points(spark, sf):
    return masks.markers(marker_score(spark, sf), -60, 8)


@query(f"WITH {RGB} SELECT img_id, y, x, trunc(r * 0.5::DOUBLE + 255 * 0.5::DOUBLE)::INTEGER AS r, trunc(g * 0.5::DOUBLE)::INTEGER AS g, trunc(b * 0.5::DOUBLE)::INTEGER AS b FROM rgb")
def overlay_blend(spark, sf):
    one = lambda c, t: pixels.blended(F.col(c), F.lit(float(t)), 0.5).alias(c)
    return rgb(spark, sf).select("img_id", "y", "x", one("r", 255), one("g", 0), one("b", 0))


@query(f"WITH {GREY} SELECT z, y, x, CASE WHEN v > 0.1::DOUBLE THEN trunc(round(g * 0.6::DOUBLE + 255 * 0.4::DOUBLE, 6))::BIGINT ELSE g END AS r, CASE WHEN v > 0.1::DOUBLE THEN trunc(round(g * 0.6::DOUBLE, 6))::BIGINT ELSE g END AS gb FROM grey")
def mask_overlay(spark, sf):
    on = F.col("v") > 0.1
    return grey(spark, sf).select(
        "z", "y", "x",
        F.when(on, F.round(F.col("g") * 0.6 + 255 * 0.4, 6).cast("long")).otherwise(F.col("g")).alias("r"),
        F.when(on, F.round(F.col("g") * 0.6, 6).cast("long")).otherwise(F.col("g")).alias("gb"),
    )


_PALETTE = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(dims.INSTANCE_COLORS))


@query(
    f"""WITH {GREY}, l AS (SELECT z, y, x, g // 16 AS label FROM grey WHERE g // 16 > 0), d AS (SELECT z, y, x, label, (dense_rank() OVER (PARTITION BY z ORDER BY label) - 1) % 12 AS slot FROM l),
p(slot, r, g, b) AS (VALUES {_PALETTE}) SELECT z, y, x, label, r, g, b FROM d JOIN p USING (slot)"""
)
def palette(spark, sf):
    rows = grey(spark, sf).select("z", "y", "x", F.expr("g div 16").alias("label")).filter("label > 0")
    slots = rows.select("z", "label").distinct().withColumn("slot", (F.dense_rank().over(Window.partitionBy("z").orderBy("label")) - 1) % 12)
    colors = dims.palette(spark)  # twelve rows
    return rows.join(slots, ["z", "label"]).join(F.broadcast(colors), "slot").select("z", "y", "x", "label", F.col("pr").alias("r"), F.col("pg").alias("g"), F.col("pb").alias("b"))


@query(f"WITH {VOX} SELECT z, count(*) FILTER (v > 0.1::DOUBLE) / count(*)::DOUBLE AS fraction FROM vox GROUP BY z HAVING count(*) FILTER (v > 0.1::DOUBLE) / count(*)::DOUBLE >= 0.2")
def mask_fraction_filter(spark, sf):
    n = voxels(spark, sf).groupBy("z").agg((F.count_if(F.col("v") > 0.1) / F.count(F.lit(1))).alias("fraction"))
    return n.filter("fraction >= 0.2")


def _components_sql(near: str) -> str:
    return f"""WITH RECURSIVE {MASK}, w(img_id, y, x, f) AS (SELECT img_id, y, x, y * 8 + x FROM mask UNION
    SELECT m.img_id, m.y, m.x, w.f FROM w JOIN mask m ON m.img_id = w.img_id AND {near} WHERE w.f < m.y * 8 + m.x),
    c AS (SELECT img_id, y, x, min(f) AS first FROM w GROUP BY ALL)"""


EIGHT, FOUR = _components_sql("abs(m.y - w.y) <= 1 AND abs(m.x - w.x) <= 1"), _components_sql("abs(m.y - w.y) + abs(m.x - w.x) = 1")


@query(f"{EIGHT} SELECT img_id, y, x, first FROM c")
def components_8(spark, sf):
    return masks.components(mask(spark, sf), True, 8)


@query(f"{FOUR} SELECT img_id, y, x, first FROM c")
def components_4(spark, sf):
    return masks.components(mask(spark, sf), False, 8)


@query(f"{EIGHT} SELECT img_id, y, x, first FROM c")
def tiled_components(spark, sf):
    return masks.tiled_components(mask(spark, sf), 4, 8)


@query(f"{EIGHT} SELECT img_id, first, count(*) AS area, trunc(avg(y))::BIGINT AS cy, trunc(avg(x))::BIGINT AS cx FROM c GROUP BY ALL")
def region_area_centroid(spark, sf):
    return masks.areas(masks.components(mask(spark, sf), True, 8))


@query(f"{EIGHT}, s AS (SELECT img_id, first FROM c GROUP BY ALL HAVING count(*) >= 3), n AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY first) AS label FROM s) SELECT c.img_id, c.y, c.x, n.label FROM c JOIN n USING (img_id, first)")
def small_removal_relabel(spark, sf):
    return masks.relabelled(masks.large_enough(masks.components(mask(spark, sf), True, 8), 3))


def _morph(name: str, of: str, r: int, grow: bool) -> str:
    values = ", ".join(f"({a}, {b})" for a, b in masks.disk(r))
    offsets = f"(VALUES {values}) o(dy, dx)"
    hit = f"SELECT img_id, y + dy AS y, x + dx AS x FROM {of}, {offsets} WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7"
    if grow:
        return f"{name} AS MATERIALIZED (SELECT DISTINCT * FROM ({hit}))"
    need = f"(SELECT g // 8 AS y, g % 8 AS x, count(*) AS need FROM range(64) t(g), {offsets} WHERE g // 8 + dy BETWEEN 0 AND 7 AND g % 8 + dx BETWEEN 0 AND 7 GROUP BY g)"
    return f"{name} AS MATERIALIZED (SELECT h.img_id, h.y, h.x FROM (SELECT img_id, y, x, count(*) AS n FROM ({hit}) GROUP BY ALL) h JOIN {need} USING (y, x) WHERE n = need)"


def _smooth(of: str, r: int, p: str) -> str:
    return ", ".join([_morph(f"{p}1", of, r, False), _morph(f"{p}2", f"{p}1", r, True), _morph(f"{p}3", f"{p}2", r, True), _morph(f"{p}4", f"{p}3", r, False)])


_LOW = MASK.replace("0.1::DOUBLE", "-0.1::DOUBLE")


@query(f"WITH {_LOW}, {_smooth('mask', 2, 's')} SELECT img_id, y, x FROM s4")
def opening_closing(spark, sf):
    return masks.smooth(mask(spark, sf, -0.1), 2, 8, 8)


@query(f"WITH {_LOW}, {_smooth('mask', 3, 's')} SELECT img_id, y, x FROM s4")
def opening_closing_3(spark, sf):
    return masks.closing(masks.opening(mask(spark, sf, -0.1), 3, 8, 8), 3, 8, 8)


def _labels(of: str) -> str:
    return f"""w(img_id, y, x, f) AS (SELECT img_id, y, x, y * 8 + x FROM {of} UNION SELECT m.img_id, m.y, m.x, w.f FROM w JOIN {of} m ON m.img_id = w.img_id
    AND abs(m.y - w.y) <= 1 AND abs(m.x - w.x) <= 1 WHERE w.f < m.y * 8 + m.x), c AS (SELECT img_id, y, x, min(f) AS first FROM w GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY first) AS label FROM (SELECT img_id, first FROM c GROUP BY ALL HAVING count(*) >= 14))"""


@query(f"WITH RECURSIVE {_LOW}, {_smooth('mask', 2, 's')}, {_labels('s4')} SELECT c.img_id, c.y, c.x, k.label FROM c JOIN k USING (img_id, first)")
def instance_mask(spark, sf):
    return masks.instance_mask(mask(spark, sf, -0.1), 8, 8, 14)


@query(f"WITH RECURSIVE {_LOW}, {_smooth('mask', 2, 's')}, {_labels('s4')} SELECT c.img_id, c.y, c.x FROM c JOIN k USING (img_id, first)")
def direct_mask(spark, sf):
    return masks.direct_mask(mask(spark, sf, -0.1), 8, 8, 14)


@query(
    f"""WITH RECURSIVE {MASK}, {_smooth('mask', 2, 's')}, g AS (SELECT DISTINCT z AS img_id, y, x FROM vox), i AS (SELECT * FROM g ANTI JOIN s4 USING (img_id, y, x)), {_smooth('i', 3, 't')},
{_labels('t4')} SELECT c.img_id, c.y, c.x, k.label FROM c JOIN k USING (img_id, first)"""
)
def invert_mask(spark, sf):
    images = table(spark, sf, "embeddings").select(F.col("vec_id").alias("img_id")).distinct()
    return masks.invert_mask(mask(spark, sf), images, 8, 8, 14)


def _mode(name: str, start: str, above: int, after: str, label: str):
    sql = f"WITH RECURSIVE {RGB}, mask AS (SELECT img_id, y, x FROM rgb WHERE {start} > {above}), {_smooth('mask', 2, 's')}, {after} SELECT c.img_id, c.y, c.x, {label} AS label FROM c JOIN k USING (img_id, first)"

    def extract(spark, sf):
        return masks.extracted(rgb(spark, sf), name == "instance", name if name != "instance" else "overlay", RED, 8, 8, above, 14)

    extract.__name__ = f"extract_{name}"
    return query(sql)(extract)


_LUMA, _SATURATION = "((19595 * r + 38470 * g + 7471 * b + 32768) >> 16)", "(greatest(r, g, b) - least(r, g, b))"
_REST = "u AS (SELECT img_id, y, x FROM rgb ANTI JOIN s4 USING (img_id, y, x))"
extract_instance = _mode("instance", _SATURATION, 15, _labels("s4"), "k.label")
extract_direct = _mode("direct", _LUMA, 108, _labels("s4"), "255")
extract_invert = _mode("invert", _LUMA, 108, f"{_REST}, {_smooth('u', 3, 't')}, {_labels('t4')}", "k.label")


@query(f"WITH {RGB} SELECT img_id, y, x, least(r - greatest(g, b), 255) AS label FROM rgb WHERE r > greatest(g, b)")
def extract_semantic(spark, sf):
    return masks.extracted(rgb(spark, sf), False, "overlay", RED, 8, 8)


@query(
    f"""WITH {VOX}, n AS (SELECT z, count(*) FILTER (v > 0.1::DOUBLE AND v > 0.05::DOUBLE) AS tp, count(*) FILTER (v > 0.1::DOUBLE OR v > 0.05::DOUBLE) AS a FROM vox GROUP BY z)
SELECT z AS img_id, 2 * tp / (tp + a)::DOUBLE AS dice FROM n WHERE a > 0"""
)
def dice(spark, sf):
    return masks.dice(mask(spark, sf, 0.1), mask(spark, sf, 0.05))


@query(f'WITH {GREY} SELECT z // 3 AS img_id, y, x, max(g) AS "value", max(g) > 140 AS "any" FROM grey GROUP BY ALL')
def mask_union(spark, sf):
    """Three slices in turn as the objects of an image, put together."""
    objects = grey(spark, sf).select(F.expr("z div 3").alias("img_id"), "y", "x", "g")
    return masks.union_of(objects, "g", 140)


@query(f"WITH {GREY} SELECT z, y, x, g / 127.5::DOUBLE - 1 AS t FROM grey")
def tensor_scale(spark, sf):
    return grey(spark, sf).select("z", "y", "x", pixels.signed(F.col("g")).alias("t"))


@query(f"WITH {GREY} SELECT z, y, x, g AS label FROM grey WHERE g > 0 AND g <> 255")
def valid_labels(spark, sf):
    return grey(spark, sf).filter(pixels.valid_label(F.col("g"))).select("z", "y", "x", F.col("g").alias("label"))


@query(
    f"""WITH {GREY}, m AS (SELECT z, avg(g) + 10 AS m FROM grey GROUP BY z)
SELECT grey.z, y, x, round(pow(least(greatest((g + 10 - m) * 1.1::DOUBLE + m, 0), 255) / 255, 0.9::DOUBLE) * 255, 4) AS g FROM grey JOIN m USING (z)"""
)
def augment_intensity(spark, sf):
    rows = grey(spark, sf)
    means = rows.groupBy("z").agg(F.avg("g").alias("m"))
    return rows.join(means, "z").select("z", "y", "x", F.round(pixels.augmented(F.col("g"), F.col("m"), 10.0, 1.1, 0.9), 4).alias("g"))


@query(f"WITH {RGB} SELECT img_id, y, x, CASE WHEN r // 8 = g // 8 AND g // 8 = b // 8 THEN least(r + 20, 255) ELSE r END AS r FROM rgb")
def augment_grey_only(spark, sf):
    same = (F.expr("r div 8") == F.expr("g div 8")) & (F.expr("g div 8") == F.expr("b div 8"))
    return rgb(spark, sf).select("img_id", "y", "x", F.when(same, F.least(F.col("r") + 20, F.lit(255))).otherwise(F.col("r")).alias("r"))


@query(f"WITH {VOX} SELECT z, 7 - x AS y, y AS x, v, y AS flip_y, 7 - x AS flip_x FROM vox")
def flip_rot(spark, sf):
    y, x = geometry.turned(F.col("y"), F.col("x"), 8, 1)
    return voxels(spark, sf).select("z", y.alias("y"), x.alias("x"), "v", F.col("y").alias("flip_y"), (7 - F.col("x")).alias("flip_x"))


@query(f"WITH {VOX} SELECT z, o.i AS y, p.i AS x, v FROM vox, range(5) o(i), range(12) p(i) WHERE vox.y = floor((o.i + 0.5::DOUBLE) * (8 / 5::DOUBLE))::BIGINT AND vox.x = floor((p.i + 0.5::DOUBLE) * (8 / 12::DOUBLE))::BIGINT")
def nearest_resize(spark, sf):
    ys = spark.range(5).select(F.col("id").alias("oy"), geometry.nearest_source(F.col("id"), 5, 8).alias("y"))
    xs = spark.range(12).select(F.col("id").alias("ox"), geometry.nearest_source(F.col("id"), 12, 8).alias("x"))
    return voxels(spark, sf).join(F.broadcast(ys), "y").join(F.broadcast(xs), "x").select("z", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")  # index maps: 5 and 12 rows


@query(f"WITH {VOX} SELECT z, o.i AS y, p.i AS x, v FROM vox, range(5) o(i), range(12) p(i) WHERE vox.y = floor(o.i * (7 / 4::DOUBLE) + 0.5::DOUBLE)::BIGINT AND vox.x = floor(p.i * (7 / 11::DOUBLE) + 0.5::DOUBLE)::BIGINT")
def zoom_resample(spark, sf):
    ys = spark.range(5).select(F.col("id").alias("oy"), geometry.zoom_source(F.col("id"), 5, 8).alias("y"))
    xs = spark.range(12).select(F.col("id").alias("ox"), geometry.zoom_source(F.col("id"), 12, 8).alias("x"))
    return voxels(spark, sf).join(F.broadcast(ys), "y").join(F.broadcast(xs), "x").select("z", F.col("oy").alias("y"), F.col("ox").alias("x"), "v")  # index maps: 5 and 12 rows


@query(
    """SELECT p_partkey, greatest(w, h) AS size, (greatest(w, h) - w) // 2 AS left_pad, (greatest(w, h) - h) // 2 AS top_pad,
    round_even(((greatest(w, h) - w) // 2) * 1024 / greatest(w, h)::DOUBLE, 0)::BIGINT AS back_left FROM (SELECT p_partkey, p_size::BIGINT AS w, p_partkey % 37 + 1 AS h FROM part)"""
)
def pad_unpad(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("w"), (F.col("p_partkey") % 37 + 1).alias("h"))
    s = geometry.padded_square(F.col("w"), F.col("h"))
    return p.select("p_partkey", s["size"].alias("size"), s["left"].alias("left_pad"), s["top"].alias("top_pad"), F.rint(s["left"] * 1024 / s["size"]).cast("long").alias("back_left"))


@query(
    """SELECT p_partkey, greatest(trunc(trunc(w * s) / 28)::BIGINT * 28, 28) AS vw, greatest(trunc(trunc(h * s) / 28)::BIGINT * 28, 28) AS vh,
    CASE WHEN w >= h THEN 1024 ELSE greatest(round_even(1024 * w / h::DOUBLE / 32, 0)::BIGINT * 32, 32) END AS gw,
    CASE WHEN w >= h THEN greatest(round_even(1024 * h / w::DOUBLE / 32, 0)::BIGINT * 32, 32) ELSE 1024 END AS gh
    FROM (SELECT *, least(1.0::DOUBLE, 1008 / greatest(w, h)::DOUBLE) AS s FROM (SELECT p_partkey, p_size::BIGINT * 30 AS w, p_partkey % 1900 + 1 AS h FROM part))"""
)
def model_sizes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size").cast("long") * 30).alias("w"), (F.col("p_partkey") % 1900 + 1).alias("h"))
    a, b = geometry.fitted(F.col("w"), F.col("h")), geometry.generated_size(F.col("w"), F.col("h"))
    return p.select("p_partkey", a["w"].alias("vw"), a["h"].alias("vh"), b["w"].alias("gw"), b["h"].alias("gh"))


@query(f"WITH {VOX} SELECT z, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, count(*) AS n, count(DISTINCT round(v * 10)::BIGINT) AS levels FROM vox GROUP BY z")
def image_stats(spark, sf):
    v = F.col("v")
    return voxels(spark, sf).groupBy("z").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg(v), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.countDistinct(F.round(v * 10).cast("long")).alias("levels"))
