"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A text is the set of the 64-bit digests of its non-empty lines. Its fingerprint has 32 cells in four regions; each digest is
counted and XORed, with a check hash, into one cell of every region. Subtracting the cells of two versions leaves the digests
that differ; they are recovered by peeling: a cell with count 1 or -1 and a fitting check holds one digest, which is taken out
of its other cells, and so on. If cells are left over, a larger sketch is built: the digests are dealt by the bits of a hash to
2^k tables of 32 cells, about LOAD for each, and after each further failure to four times as many, with other hash functions,
until all of them peel.

Cost: a text's digests are halved k times to reach their tables, so a larger sketch takes n log n steps. Cells are filled within
the row, once for each document, and are shifted to the document before. Only texts, digests and cells are shuffled, once. Their
order is found without a global sort: ids are cut at their quantiles into ranges of about ROWS rows (RANGES at most), each
ordered for itself, and only one row of each range meets the range above it.

Defined results: a null text counts as empty, and its set too (two empty sets have likeness 1). Null doc_ids come last in
descending order; equal ids are ordered by a hash of their text. A single document follows itself. Further columns are left
out.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planestack.llm import common

REGIONS, REGION_CELLS = 4, 8
CELLS = REGIONS * REGION_CELLS
#: Rounds of peeling; each takes out all pure cells at once.
ROUNDS = 10
#: Digests of a pair for each table of a larger sketch, and tries; each try deals what is left to four times as many tables.
LOAD, TRIES = 6, 12
#: Rows of a range of ids, about, and ranges at most (so many ids come to the driver as edges).
ROWS, RANGES = 2048, 16_384
#: Ranges of null ids, by a hash of the text.
NULL_RANGES = 64


def digests(text: str) -> str:
    """SQL: the distinct digests of a text's non-empty lines."""
    return rf"array_distinct(transform(filter(split({text}, '\n'), p -> p <> ''), p -> xxhash64(p)))"


def _hit(h: str, j: str) -> str:
    return f"(shiftrightunsigned({h}, 3 * ({j} div {REGION_CELLS})) & {REGION_CELLS - 1}) = {j} % {REGION_CELLS}"


def cells(keys: str, seed: int | str = 0) -> str:
    """SQL: the cells of the digests in array `keys`."""
    zero = "named_struct('n', 0, 'k', 0L, 'h', 0L)"
    hashed = f"transform({keys}, k -> named_struct('k', k, 'h', xxhash64(k, {seed})))"
    fill = f"aggregate(ks, {zero}, (a, x) -> if({_hit('x.h', 'j')}, named_struct('n', a.n + 1, 'k', a.k ^ x.k, 'h', a.h ^ x.h), a))"
    return f"transform(array({hashed}), ks -> transform(sequence(0, {CELLS - 1}), j -> {fill}))[0]"


def peeled(a: str, b: str, seed: int | str = 0) -> str:
    """SQL: struct(ok, found) of cells a minus cells b; found: array of (k, n), n being 1 if only a has it, else -1."""
    minus = f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    pure = f"array_distinct(filter(st.cells, c -> abs(c.n) = 1 AND xxhash64(c.k, {seed}) = c.h))"
    left = f"transform(st.cells, (c, j) -> aggregate(p, c, (a, x) -> if({_hit('x.h', 'j')}, named_struct('n', a.n - x.n, 'k', a.k ^ x.k, 'h', a.h ^ x.h), a)))"
    step = f"transform(array({pure}), p -> if(size(p) = 0, st, named_struct('cells', {left}, 'found', concat(st.found, p))))[0]"
    start = f"named_struct('cells', {minus}, 'found', cast(array() AS array<struct<n:int,k:bigint,h:bigint>>))"
    done = "named_struct('ok', forall(st.cells, c -> c.n = 0 AND c.k = 0), 'found', transform(st.found, f -> named_struct('k', f.k, 'n', f.n)))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, i) -> {step}, st -> {done})"


def dealt(keys: str, tables: str, seed: str) -> str:
    """SQL: the array `keys` as an array of 2^tables arrays, by the bits of a hash."""
    bit = f"shiftrightunsigned(xxhash64(k, 100 + {seed}), b) & 1"
    halves = f"flatten(transform(ps, p -> array(filter(p, k -> ({bit}) = 0), filter(p, k -> ({bit}) = 1))))"
    return f"aggregate(filter(sequence(0, {tables}), b -> b < {tables}), array({keys}), (ps, b) -> {halves})"


def difference(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """SQL: array of (k, n) of the digests in which the sets a and b (columns) differ, through their sketches.

    What a table gives up stays found; only the tables that don't peel are dealt out anew, each to four with other hashes. So the
    work beyond the first deal is in proportion to the few tables that fail.
    """
    first = f"transform(array({peeled(cells_a, cells_b)}), r -> if(r.ok, r.found, null))[0]"
    tables = f"if(i = 1, int(greatest(1, ceil(log2(greatest(1, (size({a}) + size({b})) / {LOAD}))))), 2)"
    split = f"flatten(transform(st.open, o -> transform(array({tables}), n -> zip_with({dealt('o.x', 'n', 'i')}, {dealt('o.y', 'n', 'i')}, (x, y) -> named_struct('x', x, 'y', y)))[0]))"
    tried = f"transform({split}, t -> named_struct('t', t, 'r', {peeled(cells('t.x', 'i'), cells('t.y', 'i'), 'i')}))"
    kept = "concat(st.found, flatten(transform(filter(qs, q -> q.r.ok), q -> q.r.found)))"
    step = f"transform(array({tried}), qs -> named_struct('found', {kept}, 'open', transform(filter(qs, q -> NOT q.r.ok), q -> q.t)))[0]"
    start = f"named_struct('found', cast(array() AS array<struct<k:bigint,n:int>>), 'open', array(named_struct('x', {a}, 'y', {b})))"
    done = "if(size(st.open) = 0, st.found, cast(null AS array<struct<k:bigint,n:int>>))"
    larger = f"aggregate(sequence(1, {TRIES}), {start}, (st, i) -> if(size(st.open) = 0, st, {step}), st -> {done})"
    return f"coalesce({first}, {larger}, raise_error('a sketch did not peel'))"


def likeness(a: str, b: str, differing: str) -> F.Column:
    """Jaccard likeness of sets a and b, from their sizes and the number of recovered differences."""
    return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, (size({a}) + size({b}) - size({differing})) / cast(size({a}) + size({b}) + size({differing}) AS double))")


def text_of(cells_column: str) -> F.Column:
    """A fingerprint as a string: count, digests and checks of each cell."""
    return F.expr(f"array_join(transform({cells_column}, c -> if(c.n = 0, '0', concat(c.n, '.', hex(c.k), '.', hex(shiftrightunsigned(c.h, 32))))), ',')")


def _range_of(rows: DataFrame) -> F.Column:
    """The range of doc_id: its place between quantiles; null ids lie below, by the hash of their text."""
    n = rows.filter("doc_id IS NOT NULL").count()
    parts = max(1, min(RANGES, n // ROWS))
    edges: list[int] = []
    if parts > 1:
        edges = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 4 * parts + 10_000)).first()[0]))
    # Looked up in two steps, among the first edges of groups and then in a group.
    wide = max(1, math.isqrt(len(edges)))
    groups = [edges[i : i + wide] for i in range(0, len(edges), wide)]
    told = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    upto = lambda of: F.size(F.filter(of, lambda e: e <= F.col("doc_id")))
    group = upto(F.transform(told, lambda g: g[0]))
    place = F.when(group == 0, 0).otherwise((group - 1) * wide + upto(F.element_at(told, F.greatest(group, F.lit(1))))) if edges else F.lit(0)
    width = 64 - (NULL_RANGES - 1).bit_length()
    low = (F.shiftright(F.xxhash64("text"), width) - NULL_RANGES // 2).cast("int")
    return F.when(F.col("doc_id").isNull(), low).otherwise(place)


def followed(docs: DataFrame, made: dict[str, F.Column] | None = None) -> DataFrame:
    """doc_id, text (null as empty) and the text that comes next in descending order of doc_id, the first after the last.

    made: further columns made from text; each comes with that of the next row, next_<name>.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("range", _range_of(rows))
    held = ["text", *(made or {})]
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), F.col("text")]
    # The first row of each range alone, by its largest id; texts come by a second look at the few ids.
    first = F.struct("doc_id", F.xxhash64("text").alias("h"))
    top = rows.groupBy("range").agg(F.max(first).alias("f")).select("range", "f.doc_id", "f.h")
    heads = rows.join(F.broadcast(top.select("range", F.col("doc_id").alias("_id"), "h")), "range").filter(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("h")))
    heads = heads.groupBy("range").agg(F.min("text").alias("text"))
    # One row for each range, RANGES and NULL_RANGES at most: which range is the next lower one.
    down = top.select("range").withColumn("lower", F.lead("range").over(Window.orderBy(F.desc("range"))))
    last = down.agg(F.max("range").alias("top"))
    down = down.crossJoin(last).select("range", F.coalesce("lower", "top").alias("lower"))
    heads = heads.withColumns(made or {}).select(F.col("range").alias("lower"), *[F.col(c).alias(f"_{c}") for c in held])
    heads = down.join(heads, "lower").drop("lower")
    within = Window.partitionBy("range").orderBy(*order)
    led = rows.withColumns(made or {}).withColumns({f"next_{c}": F.lead(c).over(within) for c in held}).withColumn("_last", F.lead("range").over(within).isNull())
    after = lambda c: F.when(F.col("_last"), F.col(f"_{c}")).otherwise(F.col(f"next_{c}")).alias("next" if c == "text" else f"next_{c}")
    return led.join(heads, "range", "left").select("doc_id", "text", *(made or {}), *[after(c) for c in held])


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = followed(common.documents(spark, sf_dir), {"a": F.expr(digests("text")), "ca": F.expr(cells(digests("text")))})
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 3)), left(next, int(n_chars div 3)))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "ca", F.col("next_a").alias("b"), F.col("next_ca").alias("cb"), F.expr(digests("edited")).alias("e"))
    rows = rows.withColumn("ce", F.expr(cells("e")))
    rows = rows.withColumns({f"d{k}": F.expr(difference("a", k, "ca", f"c{k}")) for k in "eb"})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        text_of("ca").alias("fingerprint"),
        text_of("ce").alias("edited_fingerprint"),
        likeness("a", "e", "de").alias("near_edited"),
        likeness("a", "b", "db").alias("near_next"),
        F.size("de").alias("n_differing"),
    )
