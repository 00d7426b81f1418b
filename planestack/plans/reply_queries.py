"""Queries on prompts and model replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from planestack import dims
from planestack.functions import replies
from planestack.plans.base import query, table

_ORG = "org(organelle_key, name, color_name) AS (VALUES " + ", ".join(f"('{o[0]}', '{o[1]}', '{o[2]}')" for o in dims.ORGANELLES) + ")"
_SEM = dims.BODIES["semantic"].replace("{name}", "' || name || '").replace("{color_name}", "' || color_name || '")
_DIR = dims.BODIES["direct"].replace("{name}", "' || name || '")


@query(f"WITH {_ORG} SELECT organelle_key, n_nationkey, '{dims.PREAMBLE} The image resolution is ' || (n_nationkey + 4) || 'nm/px. {_SEM}' AS semantic, '{dims.PREAMBLE} {_DIR}' AS direct FROM org, nation")
def prompt_build(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey").crossJoin(F.broadcast(dims.organelles(spark)))  # eleven rows
    name, color = F.col("name"), F.col("color_name")
    return rows.select("organelle_key", "n_nationkey", replies.prompt("semantic", name, color, F.col("n_nationkey") + 4).alias("semantic"), replies.prompt("direct", name, color).alias("direct"))


_VARIED = " ".join(f"WHEN {i} THEN '{t.replace('{name}', chr(39) + ' || name || ' + chr(39)).replace('{color_name}', chr(39) + ' || color_name || ' + chr(39))}'" for i, t in enumerate(dims.PROMPT_TEMPLATES))


@query(f"WITH {_ORG} SELECT organelle_key, t, '{dims.PREAMBLE} ' || CASE t {_VARIED} END AS prompt FROM org, range(5) r(t)")
def prompt_varied(spark, sf):
    rows = dims.organelles(spark).crossJoin(spark.range(5).withColumnRenamed("id", "t"))  # eleven by five rows
    return rows.select("organelle_key", "t", replies.varied_prompt(F.col("t").cast("int"), F.col("name"), F.col("color_name")).alias("prompt"))


@query(
    f"""WITH {_ORG}, i AS (SELECT n_nationkey, list('the ' || name || ' in ' || color_name ORDER BY organelle_key) AS l FROM nation, org WHERE length(organelle_key) % 5 = n_nationkey % 5 GROUP BY n_nationkey)
SELECT n_nationkey, '{dims.PREAMBLE} Color ' || CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] END || '. Keep everything else unchanged.' AS prompt FROM i"""
)
def multi_prompt(spark, sf):
    rows = table(spark, sf, "nation").join(dims.organelles(spark), F.length("organelle_key") % 5 == F.col("n_nationkey") % 5)
    items = rows.groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("organelle_key", "name", "color_name"))).alias("l"))
    return items.select("n_nationkey", replies.multi_prompt(F.col("l")).alias("prompt"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'color {x} of ' || event_id WHEN 1 THEN 'cut ' || event_id WHEN 2 THEN '' WHEN 3 THEN 'default' ELSE 'default' END AS prompt FROM events"""
)
def initial_prompts(spark, sf):
    """Replies with a whole object, one that is cut off, one with an empty prompt, one without a prompt, and plain text."""
    n, kind = F.col("event_id").cast("string"), F.col("event_id") % 5
    whole = F.concat(F.lit('so: {"reasoning": "a {b}", "prompt": "color {x} of '), n, F.lit('"} end'))
    cut = F.concat(F.lit('{"prompt": "cut '), n, F.lit('", "reasoning": "no e'))
    text = F.when(kind == 0, whole).when(kind == 1, cut).when(kind == 2, F.lit('{"prompt": ""}')).when(kind == 3, F.lit('{"other": 1}')).otherwise(F.lit("plain"))
    rows = table(spark, sf, "events").select("event_id", text.alias("text"))
    rows = rows.withColumn("object", replies.first_object(F.col("text")))
    return rows.select("event_id", replies.initial_prompt(F.col("text"), F.col("object"), F.lit("default")).alias("prompt"))


def _reply(kind):
    score = F.format_string("%.2f", F.col("event_id") % 100 / 100)
    whole = F.concat(F.lit('x {"score": '), score, F.lit(', "issues": ["a", "b"], "note": {"k": "}"}} y'))
    detail = F.concat(F.lit('```json\n{"score": 0.9, "detailed_scores": {"tp_rate": 0.8, "dice_score": '), score, F.lit("}}\n```"))
    cut = F.concat(F.lit('{"score": '), score, F.lit(', "issues": ["c"], "refined_prompt": "x'))
    return F.when(kind == 0, whole).when(kind == 1, detail).when(kind == 2, cut).otherwise(F.lit("no json here"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN round(event_id % 100 / 100, 2) ELSE 0.5 END AS score, event_id % 4 = 1 AS dice_used,
CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN 'c' ELSE 'Could not parse VLM response' END AS issues FROM events"""
)
def json_salvage(spark, sf):
    rows = table(spark, sf, "events").select("event_id", _reply(F.col("event_id") % 4).alias("text"))
    rows = rows.withColumn("object", replies.json_of(F.col("text")))
    r = rows.withColumn("r", replies.evaluation(F.col("text"), F.col("object")))
    return r.select("event_id", F.round("r.score", 2).alias("score"), F.col("r.dice_used").alias("dice_used"), F.array_join("r.issues", ",").alias("issues"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, trunc((event_id % 900 + 100) / 1000.0::DOUBLE * 640)::INTEGER AS x, trunc((event_id % 800 + 150) / 1000.0::DOUBLE * 480)::INTEGER AS y FROM events")
def point_parse(spark, sf):
    e = table(spark, sf, "events")
    text = F.concat(F.lit('<points coords="1 '), (F.col("event_id") % 900 + 100).cast("string"), F.lit(" "), (F.col("event_id") % 800 + 150).cast("string"), F.lit('"/>'))
    return e.select("event_id", F.explode(replies.coordinates(text, F.lit(640), F.lit(480))).alias("p")).select("event_id", "p.x", "p.y")


@query(
    """SELECT event_id, least(event_id % 120, 99)::INTEGER AS x, (event_id % 50)::INTEGER AS y, 0 AS instance FROM events
UNION ALL SELECT event_id, 3, 4, 0 FROM events UNION ALL SELECT event_id, (event_id % 7)::INTEGER, 99, 1 FROM events"""
)
def tuple_parse(spark, sf):
    n = F.col("event_id")
    text = F.concat(F.lit("A: ("), (n % 120).cast("string"), F.lit(", "), (n % 50).cast("string"), F.lit("), (3, 4)\nnone\nB: ("), (n % 7).cast("string"), F.lit(", 700)"))
    rows = table(spark, sf, "events").select("event_id", F.explode(replies.tuples(text, F.lit(100), F.lit(100))).alias("p"))
    return rows.select("event_id", "p.x", "p.y", "p.instance")


@query(
    """SELECT event_id, least(event_id % 120, 99)::INTEGER AS x, 7 AS y, 1 AS label, 0 AS instance FROM events
UNION ALL SELECT event_id, 5, 6, 0, -1 FROM events UNION ALL SELECT event_id, 1, 2, 1, (event_id % 9)::INTEGER FROM events"""
)
def listed_points(spark, sf):
    n = F.col("event_id")
    text = F.concat(F.lit('{"points":[{"x":'), (n % 120).cast("string"), F.lit(',"y":7},{"x":5,"y":6,"label":0},{"x":1,"y":2,"instance":'), (n % 9).cast("string"), F.lit("}]}"))
    rows = table(spark, sf, "events").select("event_id", F.explode(replies.listed_points(text, F.lit(100), F.lit(100))).alias("p"))
    return rows.select("event_id", "p.x", "p.y", "p.label", F.coalesce("p.instance", F.lit(-1)).alias("instance"))


@query("SELECT event_id FROM events WHERE event_id % 5 = 0 OR event_id % 3 <> 1")
def validated_points(spark, sf):
    n = F.col("event_id")
    reply = F.when(n % 3 == 0, F.lit('```json\n{"valid": true}\n```')).when(n % 3 == 1, F.lit('{"valid": false}')).otherwise(F.lit("cannot say"))
    return table(spark, sf, "events").filter(replies.accepted(reply, F.when(n % 5 == 0, 0).otherwise(1))).select("event_id")


@query("SELECT event_id, (event_id % 100)::INTEGER AS x, 4 AS instance FROM events UNION ALL SELECT event_id, 9, 5 FROM events UNION ALL SELECT event_id, 8, 6 FROM events")
def point_refinement(spark, sf):
    point = lambda x, label, instance: F.struct(x.cast("int").alias("x"), F.lit(1).alias("y"), F.lit(label).alias("label"), F.lit(instance).cast("int").alias("instance"))
    held = F.array(point(F.lit(1), 1, 7), point(F.col("event_id") % 100, 1, 4))
    rows = table(spark, sf, "events").select("event_id", F.explode(replies.refined_points(held, F.array(F.lit(0), F.lit(5)), F.array(point(F.lit(9), 1, None), point(F.lit(8), 1, None)))).alias("p"))
    return rows.select("event_id", "p.x", "p.instance")


@query("""SELECT event_id, '  #' || event_id || ': score=' || printf('%.2f', round(value) / 100) || ', prompt="' || event_type || '", guidance=3.5' AS line, left(repeat(event_type, 20), 50) AS cut FROM events""")
def prompt_history(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", replies.history_line(F.col("event_id"), F.round("value") / 100, F.col("event_type"), F.lit(3.5)).alias("line"), F.left(F.repeat("event_type", 20), F.lit(50)).alias("cut"))


@query("SELECT k AS organelle_key, i AS ordinal, p AS prompt FROM (VALUES " + ", ".join(f"('{k}', {i}, '{p}')" for k, n, *_ in dims.ORGANELLES for i, p in enumerate(dict.fromkeys([n, *dims.SYNONYMS[k]]))) + ") t(k, i, p)")
def synonym_prompts(spark, sf):
    listed = spark.createDataFrame([(k, v) for k, v in dims.SYNONYMS.items()], "organelle_key string, more array<string>")
    rows = dims.organelles(spark).join(listed, "organelle_key")
    return rows.select("organelle_key", F.posexplode(F.array_distinct(F.concat(F.array("name"), "more"))).alias("ordinal", "prompt"))
