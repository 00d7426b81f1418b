"""Merkle manifest of a dataset: leaves in order per group, runs of consecutive nodes hashed level by level up to one root.

Texts never move: a scan makes each row's leaf (and that of its tampered text), and only ids and digests go on. Rows get their
index within the group from a range partitioning by group and key: a row number within each range, plus the rows that earlier
ranges have of the group. So a group of any size is numbered by many tasks. Each level divides the indices by the fanout and
hashes the sorted children of a run into its parent; levels are written as tables, each a fanout-th of the one before. On the
way down each level is joined with its parents' paths (left and right siblings at each level), so the long paths are kept once
for a run and meet the leaves only where the result is made. The roots of the groups are the leaves of a tree of the same kind.

Defined results: null columns count as `-`; a null group is its own group and comes first; null ids come first in their group,
and equal ids are ordered by leaf. Repeated rows are leaves of their own. A table without rows gives no rows. Further columns
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planestack.llm import common

FANOUT = 16
#: Rows that one range holds, about.
RANGE = 1 << 20
EVERY = 5


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` if null, else the byte count of the value as text, `:` and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a row."""
    return _hash(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _numbered(rows: DataFrame) -> tuple[DataFrame, str]:
    """rows (grp, ord, h, rest) with idx (from 0, within the group by ord and h) and n (rows of the group), as a table.

    A range is a task's share, whatever its group; the window within it takes the part of one group in one range.
    """
    spark = rows.sparkSession
    ranges = max(8, -(-rows.count() // RANGE))
    placed, path = common.materialize(rows.repartitionByRange(ranges, "grp", "ord", "h").withColumn("part", F.spark_partition_id()), "manifest-ranges")
    of_group = Window.partitionBy("grp")
    before = of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("rows"))
    shares = shares.select("grp", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), F.sum("rows").over(of_group).alias("n"))
    within = F.row_number().over(Window.partitionBy("grp", "part").orderBy("ord", "h")) - 1
    numbered = placed.withColumn("at", within).join(shares, ["grp", "part"]).withColumn("idx", F.col("at") + F.col("first"))
    out, kept = common.materialize(numbered.drop("part", "at", "first"), "manifest-leaves")
    common.drop(spark, path)
    return out, kept


def _others(children: Column, at: Column, left: bool) -> Column:
    """The digests of a run's children before or after a place, joined."""
    some = F.slice(children, 1, at) if left else F.slice(children, at + 2, F.size(children))
    return F.array_join(F.transform(some, lambda c: c["h"]), "")


class Tree:
    """The levels over numbered leaves (grp, idx, n, h, rest), as tables; roots(grp, root) and paths down to the leaves."""

    def __init__(self, leaves: DataFrame, fanout: int):
        self.leaves, self.fanout, self.runs, self.tables = leaves, fanout, [], []
        most = leaves.agg(F.max("n")).first()[0] or 0
        nodes, rest = leaves, [c for c in leaves.columns if c not in ("grp", "n")]
        done = leaves.filter("n = 1").select("grp", F.col("h").alias("root"))
        while most > 1:
            child = F.struct("idx", "h", *[c for c in rest if c not in ("idx", "h")])
            runs = nodes.filter("n > 1").groupBy("grp", F.expr(f"idx div {fanout}").alias("run")).agg(F.sort_array(F.collect_list(child)).alias("children"), F.first("n").alias("n"))
            runs, path = common.materialize(runs, "manifest-level")
            self.runs.append(runs)
            self.tables.append(path)
            parent = _hash(F.array_join(F.transform("children", lambda c: c["h"]), ""))
            nodes = runs.select("grp", F.col("run").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), parent.alias("h"))
            done = done.unionByName(nodes.filter("n = 1").select("grp", F.col("h").alias("root")))
            most, rest = -(-most // fanout), ["idx", "h"]
        self.roots = done

    def paths(self, top: DataFrame, carried: list[str]) -> DataFrame:
        """Leaves with their columns, the columns `carried` of top, and `path`: left and right siblings per level, from the leaf up.

        top: grp, path (what lies over the group's root) and the columns carried.
        """
        above = top.withColumn("idx", F.lit(0).cast("long"))
        alone = self.leaves.filter("n = 1").drop("n").join(above.drop("idx"), "grp")
        for level in range(len(self.runs) - 1, -1, -1):
            # groups whose top lies lower have their one node, index 0, from `top` itself
            runs = self.runs[level]
            joined = runs.join(above.withColumnRenamed("idx", "run"), ["grp", "run"])
            spread = joined.select("grp", "n", "children", "path", *carried, F.posexplode("children").alias("at", "c"))
            step = F.struct(_others(F.col("children"), F.col("at"), True).alias("left"), _others(F.col("children"), F.col("at"), False).alias("right"))
            below = spread.select("grp", "c.*", F.concat(F.array(step), "path").alias("path"), *carried)
            above = below.select("grp", "path", *carried, "idx").unionByName(self._tops(top, level)) if level else below
        return above.unionByName(alone) if self.runs else alone

    def _tops(self, top: DataFrame, level: int) -> DataFrame:
        """Rows of `top` for the groups whose root is a node of this level."""
        low, high = self.fanout ** (level - 1), self.fanout**level
        sizes = self.runs[0].filter("run = 0").filter(f"n > {low} AND n <= {high}").select("grp")
        return top.join(sizes, "grp", "left_semi").withColumn("idx", F.lit(0).cast("long"))


def prove(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """rows (doc_id, source, lang, n_chars, text) as doc_id, leaf, subroot, root, path, tampered (the leaf of the lower-cased text,
    where 5 divides the id's crc32; else null). path: the left and right siblings, level by level, from the leaf to the root.
    """
    spark = rows.sparkSession
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    struck = F.crc32(doc_id.cast("string").cast("binary")) % EVERY == 0
    tampered = F.when(struck, leaf(doc_id, source, lang, n_chars, lower_ascii(text)))
    # a null group sorts before all others, and joins as a value
    group = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    leaves = rows.select(group.alias("grp"), doc_id.alias("ord"), leaf(doc_id, source, lang, n_chars, text).alias("h"), tampered.alias("tampered"))
    leaves, scanned = common.materialize(leaves, "manifest-scan")
    numbered, _ = _numbered(leaves)
    common.drop(spark, scanned)
    tree = Tree(numbered, fanout)
    groups, _ = _numbered(tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("ord"), F.col("root").alias("h")))
    over = Tree(groups, fanout)
    root = (over.roots.first() or {"root": None})["root"]  # one digest
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = spark.range(1).select(F.lit("").alias("grp"), none.alias("path"))
    top = over.paths(start, []).select(F.col("ord").alias("grp"), F.col("h").alias("subroot"), "path")
    top, _ = common.materialize(top, "manifest-tops")
    out = tree.paths(top, ["subroot"])
    return out.select(F.col("ord").alias("doc_id"), F.col("h").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path", "tampered")


def siblings(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]).cast("binary"), 256))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prove(common.documents(spark, sf_dir))
    out = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", _hash(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels_sql(name: str, leaves: str) -> str:
    return f"""{name} AS (
    SELECT grp, 0 AS lvl, idx, h, n FROM {leaves}
    UNION ALL
    SELECT grp, lvl + 1, idx // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx)), (n + {FANOUT - 1}) // {FANOUT}
    FROM {name} WHERE n > 1 GROUP BY grp, lvl, idx // {FANOUT}, n)"""


def _steps_sql(name: str, leaves: str, nodes: str) -> str:
    run = f"(CAST(x.idx // CAST(pow({FANOUT}, o.lvl) AS BIGINT) AS BIGINT) // {FANOUT})"
    own = f"(x.idx // CAST(pow({FANOUT}, o.lvl) AS BIGINT))"
    part = lambda sign: f"coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (o.idx {sign} {own}), '')"
    return f"""{name} AS (
    SELECT x.grp, x.idx, o.lvl, {part('<')} AS l, {part('>')} AS r
    FROM {leaves} x JOIN {nodes} o ON o.grp = x.grp AND o.n > 1 AND o.idx // {FANOUT} = {run}
    GROUP BY x.grp, x.idx, o.lvl)"""


_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))))"""

#: The same rows in SQL: the levels by recursion, the paths by joining each leaf with the runs over it.
OP13_SQL = f"""
WITH RECURSIVE scanned AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS grp, {_leaf_sql("text")} AS h,
        CASE WHEN doc_id IS NOT NULL AND {_CRC} % {EVERY} = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM scanned),
{_levels_sql("node", "leaves")},
subroots AS (SELECT '' AS grp, grp AS source, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
{_levels_sql("upper_node", "subroots")},
{_steps_sql("low", "leaves", "node")},
{_steps_sql("high", "subroots", "upper_node")},
path AS (
    SELECT grp, idx, list({{'l': l, 'r': r}} ORDER BY lvl) AS steps FROM (
        SELECT grp, idx, lvl, l, r FROM low
        UNION ALL
        SELECT x.grp, x.idx, 1000 + h.lvl, h.l, h.r FROM leaves x JOIN subroots s ON s.source = x.grp JOIN high h ON h.idx = s.idx)
    GROUP BY grp, idx),
proved AS (
    SELECT x.doc_id, x.h AS leaf, s.h AS subroot, (SELECT h FROM upper_node WHERE n = 1) AS root, coalesce(p.steps, []) AS steps, coalesce(x.tampered, x.h) AS start
    FROM leaves x JOIN subroots s ON s.source = x.grp LEFT JOIN path p ON p.grp = x.grp AND p.idx = x.idx),
told AS (
    SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda p: p.l || p.r), ''), '')) AS proof_sha256,
        list_reduce(list_prepend({{'l': start, 'r': ''}}, steps), lambda a, p: {{'l': sha256(p.l || a.l || p.r), 'r': ''}}).l AS folded_root
    FROM proved)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM told
"""
