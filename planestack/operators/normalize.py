"""Intensity norms: percentiles per dataset or image, joined back to every pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planestack.functions import pixels
from planestack.sources import scratch


#: Bins that a range of values is cut in, each round.
BINS = 4096


def percentiles(values: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """key, p (array): exact percentiles of each group by linear interpolation, whatever the values' type and number.

    Each share lies between two ranks. For each rank a round cuts the range that holds it into BINS, counts what falls in each, and
    goes on with the bin that holds the rank, from its smallest value to its largest, until these are one. So a group has a few
    thousand counts at most, and a round reads the values once; some three rounds settle millions of values. A group without a
    value has null; nulls, NaN and infinities are left out, and a null key is a group.
    """
    spark = values.sparkSession
    v = values.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    finite = v.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    ends = finite.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = [F.floor((F.col("n") - 1) * F.lit(s)).cast("long") for s in shares] + [F.ceil((F.col("n") - 1) * F.lit(s)).cast("long") for s in shares]
    goals = ends.select("k", "n", "low", "high", F.explode(F.array_distinct(F.array(*ranks))).alias("rank")).withColumn("before", F.lit(0).cast("long"))
    goals, path = scratch.materialize(goals, "percentiles")
    from pyspark.sql import Window

    done, paths = goals.filter("low = high"), [path]
    goals = goals.filter("low < high")
    while not goals.isEmpty():
        # the ranges of a group, once each: ranks that are close share one
        ranges = goals.select("k", F.struct("low", "high").alias("r")).groupBy("k").agg(F.collect_set("r").alias("ranges"))
        held = finite.withColumnRenamed("k", "_k").join(ranges, F.col("_k").eqNullSafe(F.col("k")))
        held = held.select("k", "v", F.explode("ranges").alias("r")).filter((F.col("v") >= F.col("r.low")) & (F.col("v") <= F.col("r.high")))
        share = (F.col("v") / 2 - F.col("r.low") / 2) / (F.col("r.high") / 2 - F.col("r.low") / 2)
        bins = held.groupBy("k", "r", F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy("k", "r").orderBy("bin"))
        bins = bins.withColumn("upto", upto).select(F.col("k").alias("_k"), "r", "c", "least", "most", "upto")
        at = F.col("rank") - F.col("before")
        fits = F.col("_k").eqNullSafe(F.col("k")) & (F.struct("low", "high") == F.col("r")) & (at >= F.col("upto") - F.col("c")) & (at < F.col("upto"))
        new = goals.join(bins, fits).select("k", "n", F.col("least").alias("low"), F.col("most").alias("high"), "rank", (F.col("before") + F.col("upto") - F.col("c")).alias("before"))
        new, path = scratch.materialize(new, "percentiles")
        paths.append(path)
        done, goals = done.unionByName(new.filter("low = high")), new.filter("low < high")
    out, _ = scratch.materialize(done.groupBy("k", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "low"))).alias("at")), "percentiles")
    for path in paths:
        scratch.drop(spark, path)

    def one(s: float):
        place = (F.col("n") - 1) * F.lit(s)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.col("at")[low.cast("long")], F.col("at")[high.cast("long")]
        return F.when(low == high, a).otherwise((high - place) * a + (place - low) * b)

    found = out.select(F.col("k").alias("_k"), F.array(*[one(s) for s in shares]).alias("p"))
    every = v.select("k").distinct()
    return every.join(found, F.col("k").eqNullSafe(F.col("_k")), "left").select(F.col("k").alias(key), "p")


def auto_norms(values: DataFrame, key: str, value: str, low: float = 1.0, high: float = 99.0, wide: bool = True) -> DataFrame:
    """key, min, max: exact percentiles of each group, to one decimal (0 and 255 where there is no value).

    wide: values may be of any type and number (see percentiles). Otherwise a count is kept for each distinct value, which takes one
    pass: raw volumes hold 8 or 16 bits, so a group has 65,536 counts at most however many voxels it has.
    """
    shares = [low / 100, high / 100]
    if wide:
        p = percentiles(values, key, value, shares)
    else:
        p = values.groupBy(key).agg(F.percentile(F.col(value), F.array(*map(F.lit, shares))).alias("p"))
    return p.select(key, F.coalesce(F.round(F.col("p")[0], 1), F.lit(0.0)).alias("min"), F.coalesce(F.round(F.col("p")[1], 1), F.lit(255.0)).alias("max"))


def with_norms(rows: DataFrame, norms: DataFrame, key: str) -> DataFrame:
    """rows with min and max of their key, or 0 and 255 without norms. AQE broadcasts the norms if they are small."""
    joined = rows.join(norms.select(key, F.col("min"), F.col("max")), key, "left")
    return joined.withColumns({"min": F.coalesce("min", F.lit(0.0)), "max": F.coalesce("max", F.lit(255.0))})


def normalize(rows: DataFrame, norms: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `value` mapped to [0, 1] by the norms of their key."""
    return with_norms(rows, norms, key).withColumn(value, pixels.normalized(F.col(value), F.col("min"), F.col("max"))).drop("min", "max")


def to_uint8(rows: DataFrame, image: str, value: str, eight_bit: bool = False) -> DataFrame:
    """rows with u8: `value` stretched between the image's percentiles 1 and 99. Data that have 8 bits already pass through."""
    if eight_bit:
        return rows.withColumn("u8", F.col(value).cast("int"))
    p = percentiles(rows, image, value, [0.01, 0.99])
    joined = rows.join(p, image)
    return joined.withColumn("u8", pixels.stretched(F.col(value).cast("double"), F.col("p")[0], F.col("p")[1])).drop("p")


def read_norms(lines: DataFrame) -> DataFrame:
    """Norms from CSV rows (dataset, min, max, inverted, ordinal): names trimmed; of equal names the last row counts."""
    last = lines.groupBy(F.trim("dataset").alias("dataset")).agg(F.max_by(F.struct("min", "max", "inverted"), "ordinal").alias("n"))
    return last.select("dataset", F.col("n.min").cast("double").alias("min"), F.col("n.max").cast("double").alias("max"), (F.trim("n.inverted") == "True").alias("inverted"))
