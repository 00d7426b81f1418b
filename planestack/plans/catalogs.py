"""Queries on catalogs, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planestack import dims
from planestack.operators import catalog, normalize, sampling
from planestack.plans.base import parts_of, query, table

_BRIDGE = "bridge(organelle_key, ordinal, cls_name) AS (VALUES " + ", ".join(f"('{k}', {i}, '{c}')" for k, v in dims.FINE_CLASSES.items() for i, c in enumerate(v)) + ")"
_CLASSES = ["mito_mem", "er_lum", "hchrom", "echrom", "pm", "ld_mem", "np_out"]
_PICK = "[" + ", ".join(f"'{c}'" for c in _CLASSES) + "]"
_CROP = f"cls AS (SELECT DISTINCT o_orderpriority AS dataset, 'crop' || o_orderkey AS crop_id, ({_PICK})[l_linenumber % 7 + 1] AS cls_name FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def crop_classes(spark, sf):
    """dataset, crop_id, cls_name: orders as crops, line numbers as classes.

    The line numbers of an order become one number, so that orders meet one row each; an order's classes are distinct as they are.
    """
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    n = parts_of(li)
    lines = li.select("l_orderkey", "l_linenumber").repartition(n, "l_orderkey").groupBy("l_orderkey").agg(F.bit_or(F.expr("shiftleft(1, l_linenumber % 7)")).alias("on"))
    rows = o.select("o_orderkey", "o_orderpriority").repartition(n, "o_orderkey").distinct().hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    cls = F.array_compact(F.array(*[F.when(F.col("on").bitwiseAND(1 << i) != 0, c) for i, c in enumerate(_CLASSES)]))
    return rows.select(F.col("o_orderpriority").alias("dataset"), F.concat(F.lit("crop"), F.col("o_orderkey").cast("string")).alias("crop_id"), F.explode(cls).alias("cls_name"))


@query("SELECT s_suppkey, s_name, coalesce(n.lo, 0.0) AS min, coalesce(n.hi, 255.0) AS max FROM supplier LEFT JOIN (SELECT n_nationkey, n_nationkey * 10.0 AS lo, n_nationkey * 20.0 AS hi FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey")
def norm_lookup_default(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") * 10.0).alias("min"), (F.col("n_nationkey") * 20.0).alias("max"))
    return normalize.with_norms(table(spark, sf, "supplier"), n, "s_nationkey").select("s_suppkey", "s_name", "min", "max")


@query(
    """WITH l AS (SELECT trim(' ' || p_brand || ' ') AS dataset, p_partkey AS o, p_size::DOUBLE AS lo, p_retailprice AS hi, CASE WHEN p_partkey % 3 = 0 THEN 'True' ELSE 'False' END AS inv FROM part)
SELECT dataset, arg_max(lo, o) AS min, arg_max(hi, o) AS max, arg_max(inv, o) = 'True' AS inverted FROM l GROUP BY dataset"""
)
def norms_last_wins(spark, sf):
    p = table(spark, sf, "part")
    lines = p.select(F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("dataset"), F.col("p_size").alias("min"), F.col("p_retailprice").alias("max"), F.when(F.col("p_partkey") % 3 == 0, "True").otherwise("False").alias("inverted"), F.col("p_partkey").alias("ordinal"))
    return normalize.read_norms(lines)


@query(f"WITH {_BRIDGE}, {_CROP} SELECT DISTINCT b.organelle_key, c.dataset, c.crop_id FROM cls c JOIN bridge b USING (cls_name)")
def class_semi_join(spark, sf):
    return catalog.by_organelle(crop_classes(spark, sf), dims.fine_classes(spark), parts_of(table(spark, sf, "lineitem")))


@query(f"WITH {_BRIDGE}, {_CROP} SELECT c.dataset, c.crop_id, string_agg(DISTINCT b.organelle_key, ',' ORDER BY b.organelle_key) AS organelles FROM cls c JOIN bridge b USING (cls_name) GROUP BY ALL")
def reverse_index(spark, sf):
    by = catalog.by_organelle(crop_classes(spark, sf), dims.fine_classes(spark), parts_of(table(spark, sf, "lineitem")))
    return by.groupBy("dataset", "crop_id").agg(F.array_join(F.sort_array(F.collect_set("organelle_key")), ",").alias("organelles"))


@query(
    f"""WITH {_CROP}, s AS (SELECT dataset, crop_id, cls_name, 2.0 + length(cls_name) AS r, length(crop_id) * 3 AS n FROM cls WHERE cls_name <> 'pm'),
b AS (SELECT dataset, crop_id, string_agg(cls_name, ',' ORDER BY cls_name) AS annotated, arg_min(n * r, cls_name)::DOUBLE AS extent FROM s GROUP BY ALL)
SELECT * FROM b WHERE extent / 8.0 >= 16"""
)
def crop_catalog(spark, sf):
    c = crop_classes(spark, sf).withColumns({"resolution": F.array_repeat(F.lit(2.0) + F.length("cls_name"), 3), "offset": F.array_repeat(F.lit(0.0), 3), "shape": F.array_repeat((F.length("crop_id") * 3).cast("long"), 3)})
    raw = c.select("dataset").distinct().withColumn("resolution", F.array_repeat(F.lit(8.0), 3))
    targets = spark.createDataFrame([(n,) for n in _CLASSES if n != "pm"], "cls_name string")
    out = catalog.crops(c, raw, targets)
    return out.select("dataset", "crop_id", F.array_join("annotated", ",").alias("annotated"), F.col("extent")[0].alias("extent"))


@query("SELECT p_brand, arg_min(p_partkey, struct_pack(r := p_size, o := p_partkey)) AS p_partkey, min(p_size) AS res FROM part GROUP BY p_brand")
def finest_scale(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_size").alias("res"), F.col("p_partkey").alias("ordinal"))
    return catalog.finest(p, ["p_brand"]).select("p_brand", "p_partkey", "res")


@query("SELECT p_brand, arg_min(p_partkey, struct_pack(r := abs(p_size - 20.0), o := p_partkey)) AS p_partkey FROM part WHERE greatest(p_size / 20.0, 20.0 / p_size) <= 2 GROUP BY p_brand")
def closest_scale(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("res"), F.col("p_partkey").alias("ordinal"))
    return catalog.closest(p, ["p_brand"], 20.0).select("p_brand", "p_partkey")


@query("SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'N') THEN 'fibsem-uint8' ELSE 'fibsem-uint16' END AS store FROM lineitem WHERE l_returnflag IN ('N', 'R') GROUP BY l_orderkey")
def raw_store(spark, sf):
    name = F.when(F.col("l_returnflag") == "N", "fibsem-uint8").when(F.col("l_returnflag") == "R", "fibsem-uint16").otherwise("labels")
    return catalog.raw_store(table(spark, sf, "lineitem").select("l_orderkey", name.alias("name")), ["l_orderkey"])


@query(
    """SELECT p_partkey, o AS ordinal, 's' || o AS scale, (p_size * (1 << o))::DOUBLE AS res_y, CASE WHEN o = 0 THEN 5.0 ELSE 0.0 END AS off_y FROM part, range(3) t(o)"""
)
def multiscale_metadata(spark, sf):
    p = table(spark, sf, "part")
    one = lambda o: F.concat(F.lit(f'{{"path":"s{o}","coordinateTransformations":[{{"scale":[1,'), (F.col("p_size") * (1 << o)).cast("string"), F.lit(',1]}' + (',{"translation":[0,5,0]}' if o == 0 else "") + "]}"))
    js = F.concat(F.lit('{"multiscales":[{"datasets":['), F.concat_ws(",", one(0), one(1), one(2)), F.lit("]}]}"))
    rows = catalog.scales(p.select(F.col("p_partkey").alias("path"), js.alias("json")))
    return rows.select(F.col("path").alias("p_partkey"), F.col("ordinal").cast("long").alias("ordinal"), "scale", F.col("resolution")[1].alias("res_y"), F.col("offset")[1].alias("off_y"))


@query("SELECT p_partkey, p_size * 30 / 1.0 < 1024 AND p_partkey % 1500 < 1024 AS small, (p_size * 30 + p_partkey % 1500) / 2.0::DOUBLE AS mean_yx FROM part")
def crop_size_class(spark, sf):
    p = table(spark, sf, "part")
    y, x = (F.col("p_size") * 30).cast("double"), (F.col("p_partkey") % 1500).cast("double")
    return p.select("p_partkey", catalog.is_small(F.array(F.lit(1.0), y, x), F.array(*[F.lit(1.0)] * 3)).alias("small"), ((y + x) / 2).alias("mean_yx"))


@query("SELECT count(*) AS n, min(o_orderkey) AS first FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderpriority NOT IN ('2-HIGH') AND starts_with('crop' || o_orderkey, 'crop')")
def dataset_filter(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderpriority").isin("2-HIGH") & F.concat(F.lit("crop"), F.col("o_orderkey").cast("string")).startswith("crop"))
    return o.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


@query("SELECT substr(md5('{\"a\":' || p_partkey || ',\"b\":\"' || p_brand || '\"}'), 1, 12) AS key, p_partkey FROM part")
def cache_key(spark, sf):
    return table(spark, sf, "part").select(catalog.cache_key(F.struct(F.col("p_partkey").alias("a"), F.col("p_brand").alias("b"))).alias("key"), "p_partkey")


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value * 2 END, 7.0) AS v FROM events")
def config_merge(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", catalog.effective(F.when(F.col("event_id") % 3 == 0, F.col("value")), F.when(F.col("event_id") % 2 == 0, F.col("value") * 2), 7.0).alias("v"))


@query(
    """WITH r AS (SELECT label::BIGINT AS label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('s-' || vec_id), vec_id) AS turn FROM embeddings)
SELECT label, vec_id, turn FROM r WHERE turn <= 5"""
)
def balanced_sample(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id")
    return sampling.balanced(e, "label", "vec_id", 5).select("label", "vec_id", "turn")


_DRAW = "('0x' || substr(md5('{s}-' || {k}), 1, 7))::BIGINT / 268435456.0::DOUBLE"


@query(f"SELECT o_orderkey, {_DRAW.format(s='n', k='o_orderkey')} < 0.2 AS negative FROM orders")
def negative_examples(spark, sf):
    return sampling.negatives(table(spark, sf, "orders").select("o_orderkey"), 0.2, "o_orderkey")


@query(
    f"""WITH {_CROP}, r AS (SELECT crop_id, cls_name, row_number() OVER (PARTITION BY crop_id ORDER BY md5('x-' || crop_id || '-' || cls_name), cls_name) AS n FROM cls)
SELECT crop_id, cls_name FROM r WHERE n <= 1 + floor({_DRAW.format(s='x', k='crop_id')} * 2)"""
)
def extra_members(spark, sf):
    return sampling.extras(crop_classes(spark, sf).select("crop_id", "cls_name"), "crop_id", "cls_name")


@query("WITH a AS (SELECT user_id, max(value) >= 99.5 AS good FROM events GROUP BY 1) SELECT event_id, e.user_id FROM events e JOIN a USING (user_id) WHERE value >= 99.5 OR NOT good")
def valid_or_fallback(spark, sf):
    return sampling.valid_first(table(spark, sf, "events"), F.col("value") >= 99.5, "user_id").select("event_id", "user_id")


@query(f"SELECT o_orderkey, CASE WHEN e > 1024 THEN 100 + {_DRAW.format(s='c', k='o_orderkey')} * (e - 1024) ELSE 100.0 END AS origin FROM (SELECT o_orderkey, (o_orderkey % 4000)::DOUBLE AS e FROM orders)")
def random_subcrop(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4000).cast("double").alias("e"))
    return o.select("o_orderkey", sampling.subcrop(F.lit(100.0), F.col("e"), F.lit(1024.0), sampling.draw("c", "o_orderkey")).alias("origin"))


_SET_OPS = """SELECT 'union' AS op, doc_id FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)
UNION ALL SELECT 'intersect', doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'except', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)"""


@query(_SET_OPS)
def set_ops(spark, sf):
    """The set operations on all documents and all labels."""
    d, lab = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "doc_id")
    return tag(d.union(lab).distinct(), "union").unionByName(tag(d.intersect(lab), "intersect")).unionByName(tag(d.subtract(lab), "except"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS types FROM (SELECT user_id, event_type, min(row_number) AS o FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS row_number FROM events) GROUP BY ALL) GROUP BY user_id")
def ordered_dedupe(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("o"))
    return e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "event_type"))), lambda s: s["event_type"]), ",").alias("types"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS instance FROM events")
def instance_ordinals(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return table(spark, sf, "events").select("event_id", "user_id", F.coalesce(F.lit(None).cast("long"), n - 1).alias("instance"))


@query("SELECT event_id, max(event_id) OVER (PARTITION BY user_id) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS new_id FROM events")
def new_instance_ids(spark, sf):
    """New ids of a user's points, from one above the largest that the user has."""
    e = table(spark, sf, "events")
    own = Window.partitionBy("user_id")
    return e.select("event_id", (F.max("event_id").over(own) + F.row_number().over(own.orderBy("event_id"))).alias("new_id"))


@query("SELECT r.i, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT coalesce(max(user_id), 0) + 1 FROM events))) AS i) r LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) e ON r.i = e.user_id")
def fill_missing(spark, sf):
    """Counts of all positions from 0 to the largest id (one number comes to the driver)."""
    events = table(spark, sf, "events")
    n = (events.agg(F.max("user_id")).first()[0] or 0) + 1
    e = events.filter("event_type = 'view'").groupBy(F.col("user_id").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(n).withColumnRenamed("id", "i").join(e, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))


_BACKGROUND = """WITH p AS (SELECT user_id, list(event_id ORDER BY event_id) AS points FROM events WHERE event_type = 'purchase' GROUP BY user_id),
b AS (SELECT user_id, list(event_id ORDER BY event_id) AS background FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT user_id, unnest(points) AS event_id, 'point' AS role FROM p JOIN b USING (user_id) UNION ALL SELECT user_id, unnest(background), 'background' FROM p JOIN b USING (user_id)"""


@query(_BACKGROUND)
def background_to_instances(spark, sf):
    """Every point and every background of each user with both: all pairs by membership, one row for each event."""
    e = table(spark, sf, "events").filter("event_type IN ('purchase', 'error')")
    both = e.groupBy(F.col("user_id").alias("u")).agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("event_type") == "error").alias("b")).filter("p > 0 AND b > 0").select("u")
    role = F.when(F.col("event_type") == "purchase", "point").otherwise("background")
    return e.join(both, F.col("user_id") == F.col("u")).select("user_id", "event_id", role.alias("role"))


@query(_BACKGROUND)
def background_to_all_instances(spark, sf):
    """background_to_instances under its earlier name."""
    return background_to_instances(spark, sf)


@query(_SET_OPS)
def set_ops_all(spark, sf):
    """set_ops under its earlier name."""
    return set_ops(spark, sf)


@query("SELECT a.doc_id, a.source, b.quality FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) a JOIN (SELECT quality, doc_id AS i FROM labels) b USING (i)")
def zip_by_ordinal(spark, sf):
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long")
    a = table(spark, sf, "documents").select("doc_id", "source", i.alias("i"))
    return a.join(table(spark, sf, "labels").select("quality", F.col("doc_id").alias("i")), "i").select("doc_id", "source", "quality")


@query("SELECT n_nationkey, organelle_key FROM nation, (VALUES " + ", ".join(f"('{o[0]}')" for o in dims.ORGANELLES) + ") o(organelle_key)")
def slice_by_organelle(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey").crossJoin(F.broadcast(dims.organelles(spark).select("organelle_key")))  # eleven rows


@query("SELECT event_id, printf('z%04d', event_id) AS slice, printf('iteration_%02d', event_id % 120) AS step, list_extract(string_split('a/b/' || event_type, '/'), -1) AS slug FROM events")
def path_names(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.format_string("z%04d", "event_id").alias("slice"), F.format_string("iteration_%02d", F.col("event_id") % 120).alias("step"), F.element_at(F.split(F.concat(F.lit("a/b/"), "event_type"), "/"), -1).alias("slug"))


@query("SELECT event_id, 'a' AS key, event_id % 5 AS v FROM events UNION ALL SELECT event_id, 'b', 10 FROM events UNION ALL SELECT event_id, 'c', event_id % 3 FROM events")
def map_merge(spark, sf):
    """Two maps of settings merged, the right one winning."""
    n = F.col("event_id")
    left = F.create_map(F.lit("a"), n % 5, F.lit("b"), n % 7)
    right = F.create_map(F.lit("b"), F.lit(10).cast("long"), F.lit("c"), n % 3)
    both = F.map_zip_with(left, right, lambda k, x, y: F.coalesce(y, x))
    return table(spark, sf, "events").select("event_id", F.explode(both).alias("key", "v"))


@query("SELECT event_id, p FROM (SELECT event_id, unnest([0, 1, 3]) AS p FROM events)")
def removed_indices(spark, sf):
    """Positions of a list of four without those named for removal (out-of-range ones are ignored)."""
    held = F.array(*[F.lit(i) for i in range(4)])
    left = F.filter(held, lambda p, i: ~F.array_contains(F.array(F.lit(2), F.lit(9)), i))
    return table(spark, sf, "events").select("event_id", F.explode(left).alias("p"))


@query("SELECT organelle_key, name, r, g, b, d.n IS NOT NULL AS has_classes FROM (VALUES " + ", ".join(str(o).replace('"', "'") for o in dims.ORGANELLES) + ") o(organelle_key, name, color_name, r, g, b) LEFT JOIN (VALUES " + ", ".join(f"('{k}', {len(v)})" for k, v in dims.FINE_CLASSES.items() if v) + ") d(k, n) ON d.k = organelle_key")
def organelle_dimension(spark, sf):
    """The organelles, and which of them have fine classes."""
    with_classes = dims.fine_classes(spark).select("organelle_key").distinct().withColumn("n", F.lit(1))
    return dims.organelles(spark).join(with_classes, "organelle_key", "left").select("organelle_key", "name", "r", "g", "b", F.col("n").isNotNull().alias("has_classes"))
