"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up in cells of source, language and topic. Each marginal in turn is raked: the weights of its values are
scaled so that the weighted tokens meet the targets, until the cells fit all three. A document of a cell is then taken with a
probability in proportion to its cell's weight, found against a hash of its id, so a run can be repeated and any executor
decides alike. The probability `p` of one pass is at most 1: the cell with the largest weight is then taken whole. The sample holds
KEEP of all tokens: where one pass gives less, it takes several, in which documents of scarce cells repeat (`copies`: the whole
part of weight times KEEP, and one more by the hash for the rest). So neither is a probability cut nor the sample made smaller,
and the expected sample meets the raked marginals. op4_shares tells the target and the reached share of each value.

Targets may be given as a table (marginal, value, share). Without one, the target of a value is its share of tokens to the power TEMPER, normalised, which evens out a dominant source. The topic is
the form of the text (a table, shouting, symbols, repeated words, prose), as no subject column exists.

Cells stay a table: each round is a job over the cells, whose result is written to the shared folder. Rounds are few and
fixed, so the plan doesn't depend on the data.

Defined results: null source, lang or topic values form a value of their own; a null text has no tokens, and its document is
kept, as is any without tokens. Repeated rows with the same id and text are decided alike. Further columns stay (mix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planestack.llm import common

MARGINALS = ["source", "lang", "topic"]
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
KEEP = 0.8
ROUNDS = 6
#: Rounds at most when cells are raked to a tolerance.
MOST_ROUNDS = 50
#: Columns of the report on marginals.
SHARES = ["input", "target", "expected", "kept"]
#: Cells up to which their table is sent to all tasks, so that texts needn't be shuffled, and a value's cells may meet in one task.
FEW_CELLS = 20_000
#: Values of the hash that decides: a document is taken once more if its hash is below the rest of its expected copies times this.
DRAWS = 1 << 28


def tokens_of(text: F.Column) -> F.Column:
    """Count of white-space separated words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")).cast("long")


def topic_of(text: F.Column) -> F.Column:
    """The form of a text."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!! "), "shouting")
        .when(text.contains("%%% ") | text.contains("### ") | text.contains("$$$ ") | text.contains("&&& ") | text.contains("*** "), "symbols")
        .when(text.contains("http://") | text.contains("https://") | text.contains("@"), "contact")
        .otherwise("prose")
    )


def draw_of(doc_id: F.Column) -> F.Column:
    """A hash of the id from 0 up to DRAWS."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 7), 16, 10).cast("long")


def copies_of(doc_id: F.Column, expected: F.Column) -> F.Column:
    """How often a document is in the sample, from its expected number of copies."""
    whole = F.floor(expected)
    return whole + (draw_of(doc_id) < (expected - whole) * DRAWS).cast("long")


def cells(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).filter("tokens > 0")


def with_targets(cell_rows: DataFrame, temper: dict[str, float], targets: DataFrame | None = None) -> DataFrame:
    """The cells with t_<marginal>: the wanted share of the cell's value in each marginal (one total comes to the driver).

    targets (marginal, value, share): wanted shares in place of the tempered ones. They are taken in proportion among the values
    that have tokens; a marginal that isn't named keeps its shares, a value that isn't named in a named marginal is left out.
    """
    rows = cell_rows
    for column, power in temper.items():
        t = F.pow(F.sum("tokens").cast("double"), F.lit(power)) if targets is None else F.sum("tokens").cast("double")
        by = cell_rows.groupBy(column).agg(t.alias("t"))
        if targets is not None:
            wanted = targets.filter(F.col("marginal") == column).groupBy(F.col("value").alias("w")).agg(F.sum(F.col("share").cast("double")).alias("s"))
            if not wanted.isEmpty():
                by = by.join(wanted.hint("merge"), F.col(column).eqNullSafe(F.col("w")), "left").select(column, F.coalesce("s", F.lit(0.0)).alias("t"))
        total = by.agg(F.sum("t")).first()[0] or 1.0
        by = by.select(F.col(column).alias("v"), (F.col("t") / F.lit(total)).alias(f"t_{column}"))
        rows = rows.join(by.hint("merge"), F.col(column).eqNullSafe(F.col("v"))).drop("v")
    return rows


def residual(rows: DataFrame) -> float:
    """The largest distance of a weighted share from its target over all marginals."""
    worst = 0.0
    total = rows.agg(F.sum(F.col("tokens") * F.col("weight"))).first()[0] or 1.0
    for column in MARGINALS:
        off = rows.groupBy(column).agg(F.abs(F.sum(F.col("tokens") * F.col("weight")) / F.lit(total) - F.max(f"t_{column}")).alias("off"))
        worst = max(worst, off.agg(F.max("off")).first()[0] or 0.0)
    return worst


def _scaled(rows: DataFrame, column: str, total: float) -> DataFrame:
    """The cells with the weights of each value in a marginal scaled to its target: sums by value, joined by shuffle."""
    held = F.sum(F.col("tokens") * F.col("weight"))
    have = rows.groupBy(F.col(column).alias("v")).agg(F.when(held > 0, F.max(f"t_{column}") * total / F.nullif(held, F.lit(0.0))).otherwise(0.0).alias("scale"))
    return rows.join(have.hint("merge"), F.col(column).eqNullSafe(F.col("v"))).withColumn("weight", F.col("weight") * F.col("scale")).drop("v", "scale")


def _scaled_few(rows: DataFrame, column: str, total: float) -> DataFrame:
    """The same for few cells, by a window: the plan names `rows` once, so a round has 3 shuffles, not 21 (joins double it)."""
    held = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(column))
    rows = rows.withColumn("held", held)
    scale = F.when(F.col("held") > 0, F.col(f"t_{column}") * total / F.nullif(F.col("held"), F.lit(0.0))).otherwise(0.0)
    return rows.withColumn("weight", F.col("weight") * scale).drop("held")


def rake(cell_rows: DataFrame, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """The cells with `weight`, so that weight * tokens meets the wanted shares of each marginal in turn.

    tolerance: rounds end as soon as no share is further from its target (`rounds` is then the most there can be).
    """
    spark = cell_rows.sparkSession
    tokens, count = cell_rows.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    total, scaled = float(tokens or 0), _scaled_few if count <= FEW_CELLS else _scaled
    rows, old = cell_rows.withColumn("weight", F.lit(1.0)), None
    for _ in range(rounds):
        for column in MARGINALS:
            rows = scaled(rows, column, total)
        rows, path = common.materialize(rows, "raked")
        if old:
            common.drop(spark, old)
        old = path
        if tolerance is not None and residual(rows) <= tolerance:
            break
    return rows


def probabilities(raked: DataFrame, keep: float = KEEP) -> DataFrame:
    """source, lang, topic, weight, p, expected: weights scaled by one factor, so that a pass takes `keep` of all tokens or p is 1
    at most; copies of a document that are expected in the sample, which holds `keep` of all tokens.
    """
    most = raked.agg(F.max("weight")).first()[0] or 1.0
    rows = raked.withColumns({"p": F.col("weight") * F.lit(min(keep, 1 / most)), "expected": F.col("weight") * F.lit(keep)})
    return rows.select("source", "lang", "topic", "weight", "p", "expected")


def decided(docs: DataFrame, keep: float = KEEP, targets: DataFrame | None = None, tolerance: float = 1e-4) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, p, expected, copies, kept (it has copies) of every row (no text).

    Without targets (see with_targets) the tempered ones hold, in ROUNDS rounds. With targets the cells are raked to the tolerance
    (MOST_ROUNDS at most). `shares` tells what is reached.
    """
    rows = docs.select("doc_id", "source", "lang", topic_of(F.col("text")).alias("topic"), tokens_of(F.col("text")).alias("tokens"))
    rows, _ = common.materialize(rows, "mix")
    cell_rows, _ = common.materialize(cells(rows), "cells")
    cell_rows, _ = common.materialize(with_targets(cell_rows, TEMPER, targets), "cells")
    p = probabilities(rake(cell_rows) if targets is None else rake(cell_rows, MOST_ROUNDS, tolerance), keep).select(*[F.col(c).alias(f"_{c}") for c in MARGINALS], "weight", "p", "expected")
    fits = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MARGINALS]
    rows = rows.join(p, fits[0] & fits[1] & fits[2], "left")
    told = {c: F.when(F.col("tokens") > 0, F.coalesce(c, F.lit(1.0))).otherwise(1.0) for c in ("p", "expected")}
    rows = rows.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), **told}).withColumn("copies", copies_of(F.col("doc_id"), F.col("expected")))
    return rows.withColumn("kept", F.col("copies") > 0).select("doc_id", *MARGINALS, "tokens", "weight", "p", "expected", "copies", "kept")


def mix(docs: DataFrame, keep: float = KEEP, targets: DataFrame | None = None, tolerance: float = 1e-4, repeat: bool = False) -> DataFrame:
    """The rows of docs that are kept, all columns unchanged. The small table of cells meets the texts, which stay in place.

    repeat: a row for each copy, which makes the sample whole; else each kept row comes once.
    """
    found = decided(docs, keep, targets, tolerance)
    cut = found.groupBy(*MARGINALS).agg(F.max(F.when(F.col("tokens") > 0, F.col("expected"))).alias("_expected"))
    cut = cut.select(*[F.col(c).alias(f"_{c}") for c in MARGINALS], "_expected")
    if cut.count() <= FEW_CELLS:
        cut = F.broadcast(cut)  # its size has just been checked; a larger table is joined by shuffle
    text = F.col("row.text")
    rows = common.boxed(docs).withColumns({"_of": topic_of(text), "_tokens": tokens_of(text)})
    fits = F.col("row.source").eqNullSafe(F.col("_source")) & F.col("row.lang").eqNullSafe(F.col("_lang")) & F.col("_of").eqNullSafe(F.col("_topic"))
    expected = F.when(F.col("_tokens") > 0, F.coalesce("_expected", F.lit(1.0))).otherwise(1.0)
    kept = rows.join(cut, fits, "left").withColumn("_copies", copies_of(F.col("row.doc_id"), expected)).filter("_copies > 0")
    return common.unboxed(kept.select("row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))) if repeat else kept)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(common.documents(spark, sf_dir))
    return rows.select("doc_id", *MARGINALS, "tokens", F.round("weight", 6).alias("weight"), F.round("p", 6).alias("p"), "kept", "copies")


def shares(rows: DataFrame) -> DataFrame:
    """marginal, value, input, target, expected, kept: shares of each value in the tokens of decided rows and of their sample."""
    out = None
    for column, power in TEMPER.items():
        t = F.col("tokens")
        by = rows.groupBy(F.col(column).alias("value")).agg(F.sum(t).alias("input"), F.sum(t * F.col("p")).alias("expected"), F.sum(t * F.col("copies")).alias("kept"))
        by = by.filter("input > 0").withColumn("target", F.pow(F.col("input").cast("double"), F.lit(power)))
        total = by.agg(*[F.sum(c).alias(f"all_{c}") for c in SHARES])
        by = by.crossJoin(F.broadcast(total))  # one row
        by = by.select(F.lit(column).alias("marginal"), "value", *[F.round(F.col(c) / F.col(f"all_{c}"), 4).alias(c) for c in SHARES])
        out = by if out is None else out.unionByName(by)
    return out


def op4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = common.materialize(decided(common.documents(spark, sf_dir)).select(*MARGINALS, "tokens", "p", "copies"), "shares")
    return shares(rows)


def _sql() -> str:
    t = "coalesce(text, '')"
    has = lambda s: f"contains({t}, '{s}')"
    parts = [
        f"""d AS (SELECT doc_id, source, lang, CASE WHEN {has(' | ')} THEN 'table' WHEN {has('!! ')} THEN 'shouting'
            WHEN {' OR '.join(has(s) for s in ('%%% ', '### ', '$$$ ', '&&& ', '*** '))} THEN 'symbols'
            WHEN {has('http://')} OR {has('https://')} OR {has('@')} THEN 'contact' ELSE 'prose' END AS topic,
            len(list_filter(regexp_split_to_array({t}, '[ \\t\\n\\r]+'), lambda w: w <> '')) AS tokens FROM documents)""",
        "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS weight FROM d GROUP BY ALL HAVING sum(tokens) > 0)",
        "total AS (SELECT sum(tokens) AS t FROM c0)",
    ]
    for c in MARGINALS:
        parts.append(f"t_{c} AS (SELECT {c}, pow(sum(tokens), {TEMPER[c]}) / sum(pow(sum(tokens), {TEMPER[c]})) OVER () AS target FROM c0 GROUP BY {c})")
    n = 0
    for _ in range(ROUNDS):
        for c in MARGINALS:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * s.target * (SELECT t FROM total) / s.have AS weight FROM c{n} x
                JOIN (SELECT y.{c} AS v, any_value(target) AS target, sum(tokens * weight) AS have FROM c{n} y JOIN t_{c} z ON y.{c} IS NOT DISTINCT FROM z.{c} GROUP BY y.{c}) s ON x.{c} IS NOT DISTINCT FROM s.v)"""
            )
            n += 1
    parts.append(f"q AS (SELECT *, weight * least({KEEP}::DOUBLE, 1 / (SELECT max(weight) FROM c{n})) AS p, weight * {KEEP}::DOUBLE AS expected FROM c{n})")
    parts.append(
        f"""e AS (SELECT d.*, round(coalesce(q.weight, 1.0), 6) AS weight, round(CASE WHEN d.tokens > 0 THEN coalesce(q.p, 1.0) ELSE 1.0 END, 6) AS p,
            CASE WHEN d.tokens > 0 THEN coalesce(q.expected, 1.0) ELSE 1.0 END AS expected, ('0x' || substr(md5('mix-' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 7))::BIGINT AS draw
            FROM d LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source AND d.lang IS NOT DISTINCT FROM q.lang AND d.topic IS NOT DISTINCT FROM q.topic)"""
    )
    parts.append(f"f AS (SELECT *, floor(expected)::BIGINT + (draw < (expected - floor(expected)) * {DRAWS})::BIGINT AS copies FROM e)")
    return f"""WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, tokens, weight, p, copies > 0 AS kept, copies FROM f"""


OP4_SQL = _sql()


def _shares_sql() -> str:
    one = lambda c: f"""SELECT '{c}' AS marginal, {c} AS value, sum(tokens) AS input, pow(sum(tokens), {TEMPER[c]}) AS target,
    sum(tokens * p) AS expected, sum(tokens * copies) AS kept FROM r GROUP BY {c} HAVING sum(tokens) > 0"""  # noqa: E731
    share = ", ".join(f"round(({c} / sum({c}) OVER (PARTITION BY marginal))::DOUBLE, 4) AS {c}" for c in SHARES)
    return f"WITH r AS ({OP4_SQL}) SELECT marginal, value, {share} FROM ({' UNION ALL '.join(one(c) for c in TEMPER)})"


OP4_SHARES_SQL = _shares_sql()
