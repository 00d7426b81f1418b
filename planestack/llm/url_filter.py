"""URL filter on a sorted digest array.

Entries (path rules and a block list) are turned into key strings; their 64-bit xxhash digests are sorted and split by range
into shards, each a binary row: digests, offsets and the full strings. The keys that a URL could match are digested too, made
distinct, dealt out to the shards, and probed by a vectorised binary search over the digests in mapped memory (anonymous pages:
a shard comes by shuffle, and no file is left on a machine); a hit counts only if the stored string equals the key. The list and the URLs may both grow: no side is broadcast or collected.

Keys: a rule `host/path` fits a URL whose host is the rule's or a subdomain of it and whose path begins with the rule's; the
longest rule wins. A list entry `host/segment[/segment...]` fits host and subdomains if the path's first segments are the
entry's. Without a fitting rule, a fitting list entry blocks and all else is allowed.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and is allowed. Repeated rows are judged
alike; a null page_id is kept; further columns are left out.
"""

from __future__ import annotations

import mmap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.llm import common

#: (verdict, host and path) of the path rules.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: The block list is made by rule: these sections of this site, every LISTED_STEP-th page number under LISTED_END.
LISTED_SITE, LISTED_SECTIONS, LISTED_STEP, LISTED_END = "example.net", ["de", "en", "es", "fr"], 10, 60_000
#: Digest ranges at least, and entries in one of them at most (on average).
SHARDS, SHARD_ROWS = 64, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def block_list(spark: SparkSession) -> DataFrame:
    """The entries of the block list, one string a row."""
    sections = F.explode(F.array(*[F.lit(s) for s in LISTED_SECTIONS]))
    return spark.range(0, LISTED_END, LISTED_STEP).select(sections.alias("s"), "id").select(F.concat_ws("/", F.lit(LISTED_SITE), "s", F.col("id").cast("string")).alias("entry"))


def host_of(url: F.Column) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def _shards(entries: DataFrame, bits: int) -> DataFrame:
    """(shard, digests, ends, strings) of the sorted distinct keys."""
    rows = entries.select("key").distinct().withColumn("digest", F.xxhash64("key"))
    rows = rows.withColumn("shard", F.shiftright("digest", 64 - bits))

    def pack(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("digest", "ascending"), ("key", "ascending")])
        strings = [s.encode() for s in table.column("key").to_pylist()]
        return pa.table(
            {
                "shard": pa.array([table.column("shard")[0].as_py()], pa.int64()),
                "digests": [table.column("digest").to_numpy().astype("<i8").tobytes()],
                "ends": [np.cumsum([len(s) for s in strings]).astype("<i8").tobytes()],
                "strings": [b"".join(strings)],
            }
        )

    return rows.groupBy("shard").applyInArrow(pack, "shard long, digests binary, ends binary, strings binary")


def _probe(keys: DataFrame, shards: DataFrame, bits: int) -> DataFrame:
    """The distinct keys that the digest array holds."""
    probes = keys.distinct().withColumn("digest", F.xxhash64("key")).withColumn("shard", F.shiftright("digest", 64 - bits))

    def search(left, right):
        import numpy as np
        import pyarrow as pa

        empty = pa.table({"key": pa.array([], pa.string())})
        if not left.num_rows or not right.num_rows:
            return empty
        packed = right.column("digests")[0].as_py()
        with mmap.mmap(-1, max(1, len(packed))) as pages:  # pages of memory, no file on the machine
            pages.write(packed)
            sorted_digests = np.frombuffer(pages, "<i8", len(packed) // 8)
            asked = left.column("digest").to_numpy()
            first = np.searchsorted(sorted_digests, asked, "left")
            last = np.searchsorted(sorted_digests, asked, "right")
            del sorted_digests
        hits = np.flatnonzero(last > first)
        ends, strings = np.frombuffer(right.column("ends")[0].as_py(), "<i8"), right.column("strings")[0].as_py()
        found = []
        for i, key in zip(hits, left.column("key").take(pa.array(hits)).to_pylist(), strict=True):
            for j in range(first[i], last[i]):
                if strings[ends[j - 1] if j else 0 : ends[j]] == key.encode():
                    found.append(key)
        return pa.table({"key": pa.array(found, pa.string())})

    return probes.groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(search, "key string")


def judge(urls: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """url, rule, verdict for each distinct non-null url with a host.

    rules: (action, host, path); listed: (entry). The few distinct lengths of rule paths, and the largest counts of labels
    and segments, come to the driver as single numbers; they say which keys a URL can match.
    """
    spark = urls.sparkSession
    rule_keys = rules.select(F.concat(F.lit("R"), "host", "path").alias("key"))
    list_keys = listed.select(F.concat(F.lit("B"), "entry").alias("key"))
    r = rules.agg(F.sort_array(F.collect_set(F.length("path"))), F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0))).first()
    b = listed.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(F.split(F.split("entry", "/")[0], r"\."))), F.lit(0)), F.coalesce(F.max(F.size(F.split("entry", "/"))), F.lit(1))).first()
    bits = max(SHARDS, -(-(b[0] + 1) // SHARD_ROWS)).bit_length()
    labels, lengths, segments = max(r[1], b[1], 1), r[0], b[2] - 1

    parts = urls.filter(F.col("url").contains("://")).select("url").distinct()
    parts = parts.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({"labels": F.split("host", r"\."), "segments": F.filter(F.split("path", "/"), lambda s: s != "")})
    parts = parts.withColumn("tails", F.transform(F.sequence(F.lit(1), F.least(F.lit(labels), F.size("labels"))), lambda k: F.array_join(F.slice("labels", -k, k), ".")))
    prefixes = F.array_distinct(F.array(*[F.left(F.col("path"), F.lit(n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    heads = F.transform(F.sequence(F.lit(0), F.least(F.lit(segments), F.size("segments"))), lambda k: F.concat(F.when(k > 0, "/").otherwise(""), F.array_join(F.slice("segments", 1, k), "/")))
    keyed = F.flatten(F.transform("tails", lambda t: F.concat(F.transform(prefixes, lambda p: F.concat(F.lit("R"), t, p)), F.transform(heads, lambda h: F.concat(F.lit("B"), t, h)))))
    keyed = parts.select("url", F.explode(F.array_distinct(keyed)).alias("key"))

    shards, _ = common.materialize(_shards(rule_keys.unionByName(list_keys), bits), "digests")
    actions = rules.select(F.concat(F.lit("R"), "host", "path").alias("key"), "action")
    # Written out, so that the join below stands on plain exchanges and a key that very many URLs share can be split.
    hits, _ = common.materialize(_probe(keyed.select("key"), shards, bits).join(actions, "key", "left"), "hits")
    # A URL meets a handful of keys, so its group is small however often the URL or the key occurs.
    best = F.max(F.when(F.col("key").startswith("R"), F.struct(F.length("key").alias("n"), F.substring("key", 2, 1 << 30).alias("rule"), F.col("action").alias("action"))))
    found = keyed.join(hits, "key").groupBy("url").agg(best.alias("best"), F.max(F.col("key").startswith("B")).alias("listed"))
    return found.select("url", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.when(F.col("listed"), "block")).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    judged = judge(pages.select("url"), rules, listed)
    return (
        pages.select("page_id", "url")
        .join(judged, "url", "left")
        .select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    )


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(a, t[: t.index("/")], t[t.index("/") :]) for a, t in RULES]
    return spark.createDataFrame(rows, "action string, host string, path string")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark), block_list(spark))


_R = ", ".join(f"('{a}', '{t[: t.index('/')]}', '{t[t.index('/'):]}')" for a, t in RULES)
OP8_SQL = f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(action, host, path) AS (VALUES {_R}),
fit AS (SELECT p.r, max(struct_pack(n := length(x.host || x.path), rule := x.host || x.path, action := x.action)) AS best
    FROM p JOIN rules x ON (p.host = x.host OR ends_with(p.host, '.' || x.host)) AND starts_with(p.path, x.path) GROUP BY p.r),
seg AS (SELECT r, host, list_filter(string_split(path, '/'), lambda s: s <> '') AS s FROM p),
listed AS (SELECT r FROM seg WHERE (host = '{LISTED_SITE}' OR ends_with(host, '.{LISTED_SITE}')) AND len(s) >= 2
    AND list_contains({LISTED_SECTIONS}, s[1]) AND regexp_full_match(s[2], '0|[1-9][0-9]{{0,4}}')
    AND try_cast(s[2] AS INTEGER) % {LISTED_STEP} = 0 AND try_cast(s[2] AS INTEGER) < {LISTED_END})
SELECT p.page_id, p.host, p.path, fit.best.rule AS rule,
    coalesce(fit.best.action, CASE WHEN listed.r IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit ON fit.r = p.r LEFT JOIN listed ON listed.r = p.r
"""
