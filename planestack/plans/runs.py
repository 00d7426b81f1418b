"""Queries that run whole pipelines with stand-in models."""

from __future__ import annotations

from pyspark.sql import functions as F

from planestack import models
from planestack.functions import replies, requests
from planestack.operators import orchestrate, propagate, refine
from planestack.plans.base import VOX, query, table, voxels

_EVEN = "SELECT DISTINCT CASE WHEN k = m - 1 THEN 7 ELSE floor(k * (7 / (m - 1)::DOUBLE))::BIGINT END AS i FROM range(8) t(k), (SELECT least(8, (max(vec_id) // 50) + 1) AS m FROM embeddings) WHERE k < m"


@query(f"WITH {VOX} SELECT z, y, x FROM vox WHERE z % 5 = 0 AND v > 0.1::DOUBLE")
def zstack_run(spark, sf):
    return orchestrate.zstack(voxels(spark, sf), 5, "threshold")


@query(
    f"""WITH {VOX}, m AS MATERIALIZED (SELECT z, y, x FROM vox WHERE v > 0.1::DOUBLE), zs AS (SELECT DISTINCT z AS i FROM vox WHERE z % 50 = 0), es AS ({_EVEN}), az AS (SELECT DISTINCT z AS a FROM vox), a8 AS (SELECT unnest(range(8)) AS a),
nz AS MATERIALIZED (SELECT a, arg_min(i, struct_pack(d := abs(a - i), i := i)) AS i FROM az, zs GROUP BY a), n8 AS (SELECT a, arg_min(i, struct_pack(d := abs(a - i), i := i)) AS i FROM a8, es GROUP BY a),
v AS (SELECT nz.a AS z, y, x FROM m JOIN nz ON m.z = nz.i UNION ALL SELECT z, n8.a, x FROM m JOIN n8 ON m.y = n8.i UNION ALL SELECT z, y, n8.a FROM m JOIN n8 ON m.x = n8.i)
SELECT z, y, x FROM v GROUP BY ALL HAVING count(*) >= 2"""
)
def ortho_run(spark, sf):
    return orchestrate.ortho(voxels(spark, sf), 50, "threshold")


@query("SELECT vec_id AS index, 4 AS x, 4 AS y FROM embeddings")
def point_detection(spark, sf):
    slices = table(spark, sf, "embeddings").select(F.col("vec_id").alias("index"), replies.prompt("direct", F.lit("nucleus"), F.lit("bright blue")).alias("prompt"))
    return orchestrate.detected_points(slices, "echo", 8, 8)


def _dice(after: str) -> str:
    """A slice's overlap with what is over 0.1, for the cut that the parameters give."""
    hit, said, true = "len(list_filter(e, lambda x: x > 0.1::DOUBLE AND x > c))", "len(list_filter(e, lambda x: x > c))", "len(list_filter(e, lambda x: x > 0.1::DOUBLE))"
    cut = "0.1::DOUBLE + off + (g - 3.5::DOUBLE) / 50 + (s - 0.75::DOUBLE) / 10 + (n - 28) / 1000"
    return f"""SELECT *, ok AND score >= 0.95::DOUBLE AS done FROM (
    SELECT *, CASE WHEN {said} + {true} > 0 THEN 2.0::DOUBLE * {hit} / ({said} + {true}) ELSE 1.0::DOUBLE END AS score, {said} - {true} AS more, fails <> i AS ok FROM (SELECT *, {cut} AS c FROM ({after})))"""


_KEEP = "run, e, off, fails, i, g, s, n, p, best, bg, bs, bn, bp, idx, dir, tried, old, prev"
_PICK = lambda cond, yes, no: f"CASE WHEN {cond} THEN {yes} ELSE {no} END"
_CLAMP = lambda v, lo, hi: f"least(greatest({v} + {v} * 0.05::DOUBLE * d2, {lo}::DOUBLE), {hi}::DOUBLE)"
_BETTER = "ok AND (best IS NULL OR score > best)"
_TURN = f"""SELECT run, e, off, fails, i + 1 AS i,
    CASE WHEN NOT ok THEN g WHEN j = 1 THEN {_CLAMP("xg", 1.0, 30.0)} ELSE xg END AS g, CASE WHEN NOT ok THEN s WHEN j = 0 THEN {_CLAMP("xs", 0.3, 1.0)} ELSE xs END AS s,
    CASE WHEN NOT ok THEN n WHEN j = 2 THEN round_even({_CLAMP("xn", 15.0, 50.0)}, 0)::BIGINT ELSE xn END AS n, {_PICK("ok", "xp", "p")} AS p,
    nb AS best, nbg AS bg, nbs AS bs, nbn AS bn, nbp AS bp, j AS idx, d2 AS dir, {_PICK("ok", "d2 = 1", "tried")} AS tried, {_PICK("ok", "o2", "old")} AS old, {_PICK("ok", "score", "prev")} AS prev
FROM (SELECT *, CASE j WHEN 0 THEN ks WHEN 1 THEN kg ELSE kn END AS o2, {_PICK("far", "nbg", "kg")} AS xg, {_PICK("far", "nbs", "ks")} AS xs, {_PICK("far", "nbn", "kn")} AS xn, coalesce(hint, {_PICK("far", "nbp", "p")}) AS xp
FROM (SELECT *, CASE WHEN NOT ok THEN idx WHEN i = 0 THEN 0 WHEN helped OR NOT tried THEN (idx + 1) % 3 ELSE idx END AS j, CASE WHEN NOT ok THEN dir WHEN i = 0 OR helped OR NOT tried THEN 1 ELSE -1 END AS d2,
    {_PICK("back AND idx = 0", "old", "s")} AS ks, {_PICK("back AND idx = 1", "old", "g")} AS kg, {_PICK("back AND idx = 2", "round_even(old, 0)::BIGINT", "n")} AS kn, i > 0 AND score < nb - 0.1::DOUBLE AS far
FROM (SELECT *, i > 0 AND NOT helped AND old IS NOT NULL AS back
FROM (SELECT *, {_PICK(_BETTER, "score", "best")} AS nb, {_PICK(_BETTER, "g", "bg")} AS nbg, {_PICK(_BETTER, "s", "bs")} AS nbs, {_PICK(_BETTER, "n", "bn")} AS nbn, {_PICK(_BETTER, "p", "bp")} AS nbp,
    CASE WHEN score < 0.9::DOUBLE THEN 'again, ' || (i + 1) END AS hint, score - coalesce(prev, 0) > 0 AS helped
FROM loop WHERE NOT done AND i < 4))))"""
_LOOP = f"""WITH RECURSIVE loop AS (
{_dice("""SELECT vec_id AS run, list_transform(embedding, lambda x: x::DOUBLE) AS e, (vec_id % 7 - 3) / 100::DOUBLE AS off, CASE WHEN vec_id % 11 = 5 THEN 1 WHEN vec_id % 13 = 4 THEN 0 ELSE -1 END AS fails, 0 AS i,
    3.5::DOUBLE AS g, 0.75::DOUBLE AS s, 28::BIGINT AS n, 'first' AS p, NULL::DOUBLE AS best, NULL::DOUBLE AS bg, NULL::DOUBLE AS bs, NULL::BIGINT AS bn, NULL::VARCHAR AS bp, 0 AS idx, 1 AS dir, false AS tried, NULL::DOUBLE AS old, NULL::DOUBLE AS prev FROM embeddings""")}
UNION ALL {_dice(_TURN)})"""


def refined_slices(spark, sf):
    """Slices whose foreground a stand-in finds by a cut that starts off by up to 0.03; some have no image in one round."""
    e, n = table(spark, sf, "embeddings"), F.col("vec_id")
    fails = F.when(n % 11 == 5, 1).when(n % 13 == 4, 0).otherwise(-1)
    slices = e.select(n.alias("run"), F.col("embedding").cast("array<double>").alias("tile"), ((n % 7 - 3) / 100).alias("offset"), fails.alias("fails"), F.lit("first").alias("prompt"))
    return refine.refine(slices, "cut", "dice")


@query(
    f"""{_LOOP} SELECT run, i, p AS prompt, round(g, 9) AS guidance_scale, round(s, 9) AS strength, n AS num_inference_steps,
CASE WHEN old IS NOT NULL THEN (['strength', 'guidance_scale', 'num_inference_steps'])[idx + 1] END AS changed, CASE WHEN old IS NOT NULL THEN dir END AS direction,
CASE WHEN ok THEN round(score, 9) END AS score, CASE WHEN ok THEN CASE WHEN more > 0 THEN 'too much' WHEN more < 0 THEN 'too little' ELSE '' END END AS issue, coalesce(done, false) AS accepted FROM loop"""
)
def refine_loop(spark, sf):
    h = refined_slices(spark, sf).history
    nine = lambda c: F.round(c, 9).alias(c)
    return h.select("run", "i", "prompt", nine("guidance_scale"), nine("strength"), "num_inference_steps", "changed", "direction", nine("score"), F.array_join("issues", ",").alias("issue"), "accepted")


@query(
    f"""{_LOOP}, m AS (SELECT * FROM loop WHERE ok) SELECT run, count(*) AS iterations, bool_or(done) AS converged, round(max(score), 9) AS best, arg_min(i, struct_pack(a := -score, b := i)) AS best_i FROM m GROUP BY run"""
)
def refine_outcome(spark, sf):
    return refined_slices(spark, sf).outcome().withColumn("best", F.round("best", 9))


_FIVE = """five AS (SELECT event_id, event_id // 5 AS run, (event_id % 5)::INTEGER AS i, event_type AS p, 1 + event_id % 9 / 4::DOUBLE AS g, CASE WHEN event_id % 3 > 0 THEN (event_id % 8) / 8::DOUBLE END AS s, value / 100 AS score,
CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['too much'] WHEN 2 THEN ['a', 'it''s'] ELSE ['say "x"', 'b'] END AS issues FROM events)"""
_SET = "'prompt=\"' || p || '\", guidance=' || g || CASE WHEN s IS NOT NULL THEN ', strength=' || s ELSE '' END"


@query(
    f"""WITH {_FIVE}, lines AS (SELECT *, '  #' || (i + 1) || ': score=' || printf('%.2f', score) || ', ' || {_SET} || ', issues=[' || array_to_string(list_transform(issues, lambda x: CASE WHEN contains(x, chr(39)) THEN '"' || x || '"' ELSE chr(39) || x || chr(39) END), ', ') || ']' AS line FROM five),
h AS (SELECT a.event_id, string_agg(b.line, chr(10) ORDER BY b.i) AS lines, arg_min(b.i, struct_pack(x := -b.score, y := b.i)) AS bi FROM lines a JOIN lines b ON b.run = a.run AND b.i < a.i GROUP BY a.event_id)
SELECT a.event_id, 'The first image is the original EM. The second image is the nucleus segmentation mask output.' || chr(10) || 'Evaluate the nucleus segmentation quality.' || chr(10) || 'Image resolution: ' || (4 + a.event_id % 5) || ' nm/px.' || chr(10) || 'Generator model: flux.' || chr(10)
|| 'Current prompt: "' || a.p || '"' || chr(10) || 'Current params: guidance_scale=' || a.g || CASE WHEN a.s IS NOT NULL THEN ', strength=' || a.s ELSE '' END || ', num_inference_steps=28' || chr(10) || 'Iteration ' || (a.i + 1) || '.'
|| CASE WHEN h.lines IS NULL THEN '' ELSE chr(10) || chr(10) || 'Previous attempts:' || chr(10) || h.lines || chr(10) || chr(10) || 'BEST so far: #' || (bi + 1) || ' with score=' || printf('%.2f', b.score) || ', prompt="' || b.p || '", guidance=' || b.g || CASE WHEN b.s IS NOT NULL THEN ', strength=' || b.s ELSE '' END || chr(10) || 'Build on what worked best. Do NOT repeat prompts that scored poorly.' END
|| chr(10) || chr(10) || 'Respond with JSON only.' AS request FROM five a LEFT JOIN h ON h.event_id = a.event_id LEFT JOIN five b ON b.run = a.run AND b.i = h.bi"""
)
def evaluate_history(spark, sf):
    """Each event as an attempt of a run of five: its request holds the run's earlier attempts in their order, and the best."""
    from pyspark.sql import Window

    n = F.col("event_id")
    issues = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("too much"))).when(n % 4 == 2, F.array(F.lit("a"), F.lit("it's"))).otherwise(F.array(F.lit('say "x"'), F.lit("b")))
    made = F.struct(F.col("event_type").alias("prompt"), (1 + n % 9 / 4).alias("guidance_scale"), F.when(n % 3 > 0, n % 8 / 8).alias("strength"), F.lit(28).alias("num_inference_steps"))
    rows = table(spark, sf, "events").select("event_id", F.expr("event_id div 5").alias("run"), (n % 5).cast("int").alias("i"), made.alias("params"), (F.col("value") / 100).alias("score"), issues.alias("issues"))
    detailed = F.expr("cast(null as struct<tp_rate:double,fp_rate:double,fn_rate:double,boundary_quality:double,dice_score:double>)")
    attempt = F.struct("params.prompt", "params.guidance_scale", "params.strength", "score", detailed.alias("detailed"), "issues")
    earlier = Window.partitionBy("run").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("history", F.collect_list(attempt).over(earlier))
    return rows.select("event_id", requests.evaluation_request(F.col("params"), F.col("i"), F.col("history"), F.lit("nucleus"), nm=4 + n % 5, model="flux").alias("request"))


@query(
    """WITH k AS (SELECT event_id, event_id % 6 AS k, (event_id % 120)::INTEGER AS x, (event_id % 50)::INTEGER AS y FROM events)
SELECT event_id, 0 AS i, least(x, 99) AS x, y, 1 AS label, 7 AS instance FROM k WHERE k = 0 UNION ALL SELECT event_id, 1, 5, 6, 0, NULL FROM k WHERE k = 0
UNION ALL SELECT event_id, 0, least(x, 99), y, 1, 0 FROM k WHERE k = 1 UNION ALL SELECT event_id, 1, 8, 9, 0, NULL FROM k WHERE k = 1
UNION ALL SELECT event_id, 0, least(x, 99), y, 1, 0 FROM k WHERE k = 2 UNION ALL SELECT event_id, 1, 3, 4, 1, 0 FROM k WHERE k = 2 UNION ALL SELECT event_id, 2, y, 99, 1, 1 FROM k WHERE k = 2
UNION ALL SELECT event_id, 0, 50, 50, 1, 0 FROM k WHERE k IN (3, 4)"""
)
def points_chain(spark, sf):
    """Replies with a list of points, with a list that is cut off, with tuples by line, with nothing, with an empty list, and with a list of no points."""
    n, x, y = F.col("event_id"), (F.col("event_id") % 120).cast("string"), (F.col("event_id") % 50).cast("string")
    whole = F.concat(F.lit('So {"points": [{"x": '), x, F.lit(', "y": '), y, F.lit(', "instance": 7}, {"x": 5, "y": 6, "label": 0}], "reasoning": "{"}'))
    cut = F.concat(F.lit('{"points": [{"x": '), x, F.lit(', "y": '), y, F.lit('}, {"x": 8, "y": 9, "label": 0}, {"x": 1'))
    lines = F.concat(F.lit("A: ("), x, F.lit(", "), y, F.lit("), (3, 4)\nno\nB: ("), y, F.lit(", 700)"))
    text = F.when(n % 6 == 0, whole).when(n % 6 == 1, cut).when(n % 6 == 2, lines).when(n % 6 == 3, F.lit("I see none")).when(n % 6 == 4, F.lit('{"points": []}')).otherwise(F.lit('{"points": [{"x": 1}, 5]}'))
    rows = table(spark, sf, "events").select("event_id", text.alias("text")).withColumn("object", replies.first_object(F.col("text")))
    found = rows.select("event_id", F.posexplode(replies.points(F.col("text"), F.col("object"), F.lit(100), F.lit(100))).alias("i", "p"))
    return found.select("event_id", "i", "p.x", "p.y", "p.label", "p.instance")


@query(
    """SELECT vec_id AS run, least(vec_id % 5 + 1, 3)::INTEGER AS attempts, CASE WHEN vec_id % 5 > 2 THEN 'busy' END AS error, CASE WHEN vec_id % 5 <= 2 THEN 512 END AS bytes FROM embeddings"""
)
def busy_calls(spark, sf):
    """A model that refuses some rows up to four times, asked three times."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("run"), (F.col("vec_id") % 5).alias("busy"), F.col("embedding").cast("array<double>").alias("tile"))
    got = models.called(rows, models.create_painter("often_busy"), ["run", "busy", "tile"], "image", "binary", wait=0.0)
    return got.select("run", F.col("image_attempts").alias("attempts"), F.col("image_error").alias("error"), F.octet_length("image").alias("bytes"))


_TRACK = f"""{VOX}, fr AS (SELECT vec_id AS z, label::BIGINT AS vol, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings),
px AS (SELECT fr.vol, fr.frame, y, x, v, fr.frame % 25 = 10 AS seed FROM fr JOIN vox USING (z)),
fs AS (SELECT *, max(CASE WHEN seed THEN frame END) OVER (PARTITION BY vol, y, x ORDER BY frame) AS s, min(CASE WHEN seed THEN frame END) OVER (PARTITION BY vol, y, x ORDER BY frame DESC) AS t FROM px),
alive AS (SELECT vol, frame, y, x, s IS NOT NULL AND bool_and(CASE WHEN seed THEN v > 0.1::DOUBLE ELSE v > -0.1::DOUBLE END) OVER (PARTITION BY vol, y, x, s ORDER BY frame) AS f,
    t IS NOT NULL AND bool_and(CASE WHEN seed THEN v > 0.1::DOUBLE ELSE v > -0.1::DOUBLE END) OVER (PARTITION BY vol, y, x, t ORDER BY frame DESC) AS r FROM fs),
merged AS (SELECT vol, frame, y, x, CASE WHEN bool_or(f) OVER (PARTITION BY vol, frame) THEN f ELSE r END AS on_ FROM alive)"""


def tracked_frames(spark, sf):
    """frames and seeds: the slices of a label as the frames of a volume; every 25th one, from the eleventh on, is seeded by its foreground."""
    from pyspark.sql import Window

    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("vol"), "vec_id", F.col("embedding").cast("array<double>").alias("tile"))
    frames = e.select("vol", (F.row_number().over(Window.partitionBy("vol").orderBy("vec_id")) - 1).cast("long").alias("frame"), "tile")
    seeds = frames.filter("frame % 25 = 10").withColumn("v", F.transform("tile", lambda v: F.when(v > 0.1, F.lit("01")).otherwise(F.lit("00"))))
    return frames, seeds.select("vol", "frame", F.unhex(F.array_join("v", "")).alias("mask"))


@query(f"WITH {_TRACK} SELECT vol, frame, y, x FROM merged WHERE on_")
def frame_propagation(spark, sf):
    """Masks carried from seeded frames forward and back through their volume; where both passes have one, the forward one counts."""
    frames, seeds = tracked_frames(spark, sf)
    return propagate.pixels_of(propagate.propagated(frames, seeds, "fading", span=64), 8)


@query(f"WITH {_TRACK} SELECT vol, frame, y, x FROM merged WHERE on_ AND frame % 3 = 0")
def zstack_video(spark, sf):
    """A stack of every third slice by the propagating model, seeded at its own frames."""
    frames, seeds = tracked_frames(spark, sf)
    found = orchestrate.stack(frames, "video", tracker="fading", seeds=seeds)
    return propagate.pixels_of(found.filter("frame % 3 = 0"), 8)


@query(
    f"""{_LOOP}, m AS (SELECT * FROM loop WHERE ok AND run % 5 = 0), b AS (SELECT run, arg_min(i, struct_pack(a := -score, b := i)) AS i FROM m GROUP BY run), p AS (SELECT m.run, generate_subscripts(e, 1) - 1 AS k, unnest(e) AS v, c FROM m JOIN b USING (run, i))
SELECT run AS frame, k // 8 AS y, k % 8 AS x FROM p WHERE v > c"""
)
def zstack_per_slice(spark, sf):
    """Every fifth slice refined by itself; its best mask is kept."""
    e, n = table(spark, sf, "embeddings"), F.col("vec_id")
    fails = F.when(n % 11 == 5, 1).when(n % 13 == 4, 0).otherwise(-1)
    slices = e.filter(n % 5 == 0).select(n.alias("frame"), F.col("embedding").cast("array<double>").alias("tile"), ((n % 7 - 3) / 100).alias("offset"), fails.alias("fails"), F.lit("first").alias("prompt"))
    found = orchestrate.stack(slices, "slices", painter="cut", judge="dice")
    return propagate.pixels_of(found, 8, ["frame"])
