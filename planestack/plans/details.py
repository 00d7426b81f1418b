"""Queries on prompts of every kind, draws, augmentation, conversions, and the documents that a run leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from planestack import dims, models
from planestack.functions import geometry, pixels, replies
from planestack.operators import masks, normalize, orchestrate, sampling, volume
from planestack.plans import runs
from planestack.plans.base import GREY, RGB, VOX, grey, query, read_back, rgb, table, voxels
from planestack.sources import reports, scratch

_ORG = "org(organelle_key, name, color_name) AS (VALUES " + ", ".join(f"('{o[0]}', '{o[1]}', '{o[2]}')" for o in dims.ORGANELLES) + ")"


def _body(kind: str) -> str:
    return "'" + dims.BODIES[kind].replace("{name}", "' || name || '").replace("{color_name}", "' || color_name || '") + "'"


_KINDS = ["semantic", "direct", "invert", "instance", "instance_direct"]


@query(
    f"WITH {_ORG} "
    + " UNION ALL ".join(
        f"SELECT organelle_key, n_nationkey, '{k}' AS kind, '{dims.PREAMBLE} The image resolution is ' || round_even(n_nationkey + 0.5, 0)::BIGINT || 'nm/px. In EM, ' || name || ' appear as: ' || lower(n_name) || ' ' || {_body(k)} AS prompt FROM org, nation"
        for k in _KINDS
    )
)
def prompt_kinds(spark, sf):
    """Prompts of every kind, with a resolution and a description."""
    rows = table(spark, sf, "nation").crossJoin(F.broadcast(dims.organelles(spark)))  # eleven rows
    out = None
    for kind in _KINDS:
        prompt = replies.prompt(kind, F.col("name"), F.col("color_name"), F.col("n_nationkey") + 0.5, F.lower("n_name"))
        own = rows.select("organelle_key", "n_nationkey", F.lit(kind).alias("kind"), prompt.alias("prompt"))
        out = own if out is None else out.unionByName(own)
    return out


_UNIT = "(('0x' || substr(md5('{s}-' || {k}), 1, 7))::BIGINT / 268435456.0::DOUBLE)"


def _unit(seed: str, key: str) -> str:
    return _UNIT.format(s=seed, k=key)


def _normal(seed: str, key: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_unit(seed + '-u', key)})) * cos(2 * pi() * {_unit(seed + '-v', key)}))"


@query(f"SELECT o_orderkey, round(1 / (1 + exp(-{_normal('sigma', 'o_orderkey')})), 6) AS sigma FROM orders")
def noise_levels(spark, sf):
    """A noise level for each order, normal before it is squeezed to between 0 and 1."""
    return table(spark, sf, "orders").select("o_orderkey", F.round(sampling.logit_normal(sampling.normal("sigma", "o_orderkey")), 6).alias("sigma"))


@query(
    f"""WITH c AS (SELECT o_orderpriority AS g, o_orderkey AS crop_id, 1 + o_orderkey % 30 AS depth, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k FROM orders), n AS (SELECT g, count(*) AS n FROM c GROUP BY g),
s AS (SELECT event_id, (['1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW', 'none'])[event_id % 5 + 1] AS g FROM events)
SELECT s.event_id, s.g, c.crop_id, floor({_unit('p-z', 's.event_id')} * c.depth)::BIGINT AS z_index FROM s JOIN n USING (g) JOIN c ON c.g = s.g AND c.k = floor({_unit('p-crop', 's.event_id')} * n.n)"""
)
def crop_draws(spark, sf):
    """A crop and a slice of it for each event, among the orders of the priority that it stands for."""
    kinds = F.array(*[F.lit(k) for k in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "none")])
    samples = table(spark, sf, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("g"))
    crops = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("crop_id"), (1 + F.col("o_orderkey") % 30).alias("depth"))
    return sampling.placed(samples, crops, "g", "event_id")


_AUG = {"b": (-20.0, 20.0), "c": (0.8, 1.2), "g": (0.8, 1.2), "n": (0.0, 5.0)}


@query(
    f"""WITH {GREY}, p AS (SELECT *, avg(g) OVER (PARTITION BY z) AS mean, """
    + ", ".join(f"{lo}::DOUBLE + {_unit('a-' + k, 'z')} * {round(hi - lo, 6)}::DOUBLE AS d{k}" for k, (lo, hi) in _AUG.items())
    + f""", {_normal('noise', "z || '-' || y || '-' || x")} AS e FROM grey),
l AS (SELECT *, least(greatest((g + db - (mean + db)) * dc + (mean + db), 0.0::DOUBLE), 255.0::DOUBLE) AS l FROM p)
SELECT z, y, x, round(least(greatest(pow(l / 255, dg) * 255 + dn * e, 0.0::DOUBLE), 255.0::DOUBLE), 3) AS v FROM l"""
)
def augment_noise(spark, sf):
    """Brightness, contrast about the mean, gamma and noise, drawn for each slice; noise for each pixel."""
    from pyspark.sql import Window

    rows = grey(spark, sf).withColumns({"mean": F.avg("g").over(Window.partitionBy("z")), **sampling.intensity("a", "z")})
    lit = pixels.augmented(F.col("g").cast("double"), F.col("mean"), F.col("brightness"), F.col("contrast"), F.col("gamma"))
    out = pixels.clip(lit + F.col("noise") * sampling.normal("noise", "z", "y", "x"), 0.0, 255.0)
    return rows.select("z", "y", "x", F.round(out, 3).alias("v"))


_AT = lambda s: f"(CASE WHEN {s} * (n - 1) = floor({s} * (n - 1)) THEN q[1 + ({s} * (n - 1))::BIGINT] ELSE (ceil((n - 1) * {s}) - (n - 1) * {s}) * q[1 + floor((n - 1) * {s})::BIGINT] + ((n - 1) * {s} - floor((n - 1) * {s})) * q[1 + ceil((n - 1) * {s})::BIGINT] END)"


@query(
    f"""WITH {VOX}, w AS (SELECT z, y, x, round(v * 1000)::DOUBLE AS w FROM vox), s AS (SELECT z, list_sort(list(w)) AS q, count(*) AS n FROM w GROUP BY z), n AS (SELECT z, {_AT('0.01::DOUBLE')} AS lo, {_AT('0.99::DOUBLE')} AS hi FROM s)
SELECT w.z, y, x, CASE WHEN w.z % 2 = 1 THEN w::INTEGER % 256 ELSE trunc((least(greatest(w, lo), CASE WHEN hi <= lo THEN lo + 1 ELSE hi END) - lo) / (CASE WHEN hi <= lo THEN lo + 1 ELSE hi END - lo) * 255)::INTEGER END AS u8 FROM w JOIN n ON w.z = n.z"""
)
def uint8_conversion(spark, sf):
    """Wide slices stretched between their percentiles; every other slice has 8 bits already and passes through."""
    rows = voxels(spark, sf).select("z", "y", "x", F.round(F.col("v") * 1000).alias("w"))
    wide = normalize.to_uint8(rows.filter("z % 2 = 0"), "z", "w")
    done = normalize.to_uint8(rows.filter("z % 2 = 1").withColumn("w", F.col("w") % 256), "z", "w", eight_bit=True)
    return wide.unionByName(done).select("z", "y", "x", "u8")


@query(
    """SELECT p_partkey, round_even(l * k, 0)::BIGINT AS "left", round_even(t * k, 0)::BIGINT AS top, round_even((l + w) * k, 0)::BIGINT AS "right", round_even((t + h) * k, 0)::BIGINT AS bottom
FROM (SELECT *, (s - w) // 2 AS l, (s - h) // 2 AS t, 1024.0::DOUBLE / s AS k FROM (SELECT p_partkey, p_size::BIGINT AS w, p_partkey % 37 + 1 AS h, greatest(p_size, p_partkey % 37 + 1) AS s FROM part))"""
)
def unpad_box(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", geometry.unpadded_box(F.col("p_size").cast("long"), F.col("p_partkey") % 37 + 1, 1024).alias("b"))
    return p.select("p_partkey", "b.left", "b.top", "b.right", "b.bottom")


@query(f"WITH {VOX} SELECT z, y - 1 AS y, x, v FROM vox WHERE y BETWEEN 1 AND 6")
def unpad_pixels(spark, sf):
    """Slices that show an image of 16 by 12 pixels, centred in a square, at half its size."""
    return geometry.unpadded(voxels(spark, sf).select("z", "y", "x", "v"), 16, 12, 8)


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'sam3' WHEN 1 THEN 'flux' WHEN 2 THEN 'glm' WHEN 3 THEN 'qwen' WHEN 4 THEN 'gemini' ELSE 'flux' END AS backend FROM events")
def backend_names(spark, sf):
    known = F.array(*[F.lit(c) for c in (*models.BACKENDS, "Other")])
    return table(spark, sf, "events").select("event_id", models.backend_name(F.element_at(known, (F.col("event_id") % 6 + 1).cast("int"))).alias("backend"))


@query(
    """WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM embeddings), e AS (SELECT DISTINCT CASE WHEN i = 39 THEN n - 1 ELSE floor(i * ((n - 1) / 39.0::DOUBLE))::BIGINT END AS k FROM range(40) r(i), (SELECT count(*) AS n FROM embeddings))
SELECT s.vec_id AS "index", CASE WHEN e.k IS NULL OR vec_id % 4 = 3 THEN '' WHEN vec_id % 4 = 2 THEN (trunc((100 + vec_id % 800) / 1000.0::DOUBLE * 64)::INTEGER) || ',32,1,0;' || '48,16,1,1' ELSE (trunc((100 + vec_id % 800) / 1000.0::DOUBLE * 64)::INTEGER) || ',32,1,0' END AS points FROM s LEFT JOIN e ON e.k = s.k"""
)
def sampled_points(spark, sf):
    """A model is asked about forty slices spread evenly, and points to the marks that it is told of; the others have no points."""
    n = F.col("vec_id")
    first, second = F.concat(F.lit("mark "), (100 + n % 800).cast("string"), F.lit(" 500")), F.lit(" mark 750 250")
    prompt = F.when(n % 4 == 3, F.lit("nothing")).when(n % 4 == 2, F.concat(first, second)).otherwise(first)
    found = orchestrate.points_per_slice(table(spark, sf, "embeddings").select(n.alias("index"), prompt.alias("prompt")), "marks", 64, 64, 40)
    said = F.transform("points", lambda p: F.concat_ws(",", *[p[c].cast("string") for c in ("x", "y", "label", "instance")]))
    return found.select("index", F.array_join(said, ";").alias("points"))


_PALETTE = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(dims.INSTANCE_COLORS))


@query(
    f"""WITH {RGB}, l AS (SELECT z AS img_id, y, x, g // 24 AS label FROM grey WHERE g // 24 > 3), d AS (SELECT *, (dense_rank() OVER (PARTITION BY img_id ORDER BY label) - 1) % 12 AS slot FROM l), p(slot, pr, pg, pb) AS (VALUES {_PALETTE}),
c AS (SELECT * FROM d JOIN p USING (slot)) SELECT rgb.img_id, rgb.y, rgb.x, """
    + ", ".join(f"CASE WHEN p{k} IS NULL THEN {k} ELSE trunc({k} * 0.5::DOUBLE + p{k} * 0.5::DOUBLE)::BIGINT END AS {k}" for k in "rgb")
    + " FROM rgb LEFT JOIN c ON c.img_id = rgb.img_id AND c.y = rgb.y AND c.x = rgb.x"
)
def instance_overlay(spark, sf):
    """Images with the levels of another slice as their instances, blended in by the colours of their ranks."""
    labels = grey(spark, sf).select(F.col("z").alias("img_id"), "y", "x", F.expr("g div 24").alias("label")).filter("label > 3")
    return masks.instance_overlay(rgb(spark, sf), labels)


@query(
    f"""WITH {VOX}, m AS (SELECT z, y, x FROM vox WHERE v > 0.1::DOUBLE AND z % 5 = 0 AND y < 4 AND x < 4), n AS (SELECT a, arg_min(i, struct_pack(d := abs(a - i), i := i)) AS i FROM (SELECT DISTINCT z AS a FROM vox), (SELECT DISTINCT z AS i FROM m) GROUP BY a),
u AS (SELECT i, floor((i + 0.5) * (4 / 8.0::DOUBLE))::BIGINT AS s FROM range(8) r(i)) SELECT n.a AS z, uy.i AS y, ux.i AS x FROM m JOIN n ON m.z = n.i JOIN u uy ON uy.s = m.y JOIN u ux ON ux.s = m.x"""
)
def rebuilt_volume(spark, sf):
    """Masks of every fifth slice at half size, brought to size; the slices between take the nearest one's."""
    v = voxels(spark, sf)
    depth = v.agg(F.max("z") + 1).first()[0]
    small = v.filter("v > 0.1 AND z % 5 = 0 AND y < 4 AND x < 4").select(F.col("z").alias("index"), F.col("y").alias("row"), F.col("x").alias("col"))
    return volume.rebuilt(small, "xy", {"z": depth, "y": 4, "x": 4}, {"z": depth, "y": 8, "x": 8})


@query(
    """WITH p AS (SELECT l_orderkey % 40 AS z, l_partkey // 50 AS y, l_partkey % 50 AS x, l_quantity::DOUBLE AS v FROM lineitem), n AS (SELECT z, count(*) AS n FROM p GROUP BY z),
s AS (SELECT z, CASE WHEN n > 300 THEN greatest(1, floor(sqrt(n / 300.0::DOUBLE))::INTEGER) ELSE 1 END AS step FROM n) SELECT p.* FROM p JOIN s USING (z) WHERE y % step = 0 AND x % step = 0"""
)
def thinned_slices(spark, sf):
    """Large slices at a step that follows from their size."""
    p = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 40).alias("z"), F.expr("l_partkey div 50").alias("y"), (F.col("l_partkey") % 50).alias("x"), F.col("l_quantity").cast("double").alias("v"))
    return volume.thinned(p, 300)


@query("SELECT user_id, round(avg(sg * (value / 100 - sg) * (value / 100 - sg)), 9) AS loss FROM (SELECT user_id, value, 1 / (1 + exp(-(value / 50 - 1))) AS sg FROM events) GROUP BY user_id")
def weighted_loss(spark, sf):
    """The mean squared error of each user's values, weighted by their noise level."""
    e = table(spark, sf, "events").select("user_id", (F.col("value") / 100).alias("v"), sampling.logit_normal(F.col("value") / 50 - 1).alias("sg"))
    return e.groupBy("user_id").agg(F.round(F.avg(F.col("sg") * (F.col("v") - F.col("sg")) * (F.col("v") - F.col("sg"))), 9).alias("loss"))


def _documents(spark, files):
    root = f"{scratch.shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    reports.save(files, root)
    return read_back(files, root, "json")


@query(
    f"""{runs._LOOP} SELECT run, i, p AS prompt, CASE WHEN old IS NOT NULL THEN (['strength', 'guidance_scale', 'num_inference_steps'])[idx + 1] END AS changed, CASE WHEN ok THEN round(score, 9) ELSE 0.0 END AS score,
CASE WHEN ok THEN CASE WHEN more > 0 THEN 'too much' WHEN more < 0 THEN 'too little' ELSE '' END ELSE 'Generation failed: no image' END AS issues FROM loop"""
)
def evaluation_documents(spark, sf):
    """The document of each iteration of the refinement loop, written as a file and read again."""
    d = _documents(spark, reports.evaluation_documents(runs.refined_slices(spark, sf).history))
    kind = "generation struct<prompt:string,param_change:struct<changed:string>>, evaluation struct<score:double,issues:array<string>>"
    d = d.select(F.regexp_extract("name", r"run_(\d+)", 1).cast("long").alias("run"), F.regexp_extract("name", r"iteration_(\d+)", 1).cast("int").alias("i"), F.from_json("json", kind).alias("d"))
    return d.select("run", "i", "d.generation.prompt", "d.generation.param_change.changed", F.round("d.evaluation.score", 9).alias("score"), F.array_join("d.evaluation.issues", ",").alias("issues"))


@query(
    """SELECT label::VARCHAR AS stack, count(*) AS total_slices, round(avg(vec_id % 100 / 100.0::DOUBLE), 9) AS mean_score, string_agg((vec_id % 100)::VARCHAR, ',' ORDER BY vec_id) AS scores, count(*) FILTER (vec_id % 3 = 0) AS pointed FROM embeddings GROUP BY label"""
)
def stack_summaries(spark, sf):
    """Summaries and points of stacks (labels) of slices, written as files and read again."""
    e, n = table(spark, sf, "embeddings"), F.col("vec_id")
    scores = e.select(F.col("label").alias("stack"), n.alias("index"), (n % 100 / 100).alias("score"))
    one = F.array(F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")))
    points = e.select(F.col("label").alias("stack"), n.alias("index"), F.when(n % 3 == 0, one).otherwise(F.slice(one, 1, 0)).alias("points"))
    d = _documents(spark, reports.stack_summary(scores).unionByName(reports.points_summary(points)))
    d = d.select(F.element_at(F.split("name", "/"), -2).alias("stack"), F.element_at(F.split("name", "/"), -1).alias("file"), "json")
    told = F.from_json("json", "total_slices long, mean_score double, per_slice_scores array<double>")
    summary = d.filter("file = 'zstack_summary.json'").select("stack", told.alias("s"))
    pointed = d.filter("file = 'per_slice_points.json'").select("stack", F.from_json("json", "map<string,array<struct<x:int,y:int>>>").alias("p"))
    hundredths = F.array_join(F.transform("s.per_slice_scores", lambda v: F.rint(v * 100).cast("int").cast("string")), ",")
    rows = summary.join(pointed, "stack")
    return rows.select("stack", "s.total_slices", F.round("s.mean_score", 9).alias("mean_score"), hundredths.alias("scores"), F.size(F.filter(F.map_values("p"), lambda a: F.size(a) > 0)).cast("long").alias("pointed"))
