"""Balanced and random samples that depend on keys only, so that they can be repeated on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from a seed and the row's keys (28 bits of an md5)."""
    text = F.concat_ws("-", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long") / float(1 << 28)


def balanced(rows: DataFrame, group: str, key: str, each: int, seed: str = "s") -> DataFrame:
    """`each` rows of every class in hash order (all, if fewer), with their turn: classes take turns, the least seen first.

    Rows over the limit are dropped before the shuffle (a top-k per class and task).
    """
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(key).cast("string")).cast("binary")), key)
    return rows.withColumn("turn", F.row_number().over(order).cast("long")).filter(F.col("turn") <= each)


def negatives(rows: DataFrame, probability: float, *keys: str, seed: str = "n") -> DataFrame:
    """rows with `negative`: true for a share of them."""
    return rows.withColumn("negative", draw(seed, *keys) < probability)


def extras(members: DataFrame, sample: str, member: str, most: int = 2, seed: str = "x") -> DataFrame:
    """Up to `most` (one or two, by hash) further members of each sample, without replacement."""
    order = Window.partitionBy(sample).orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col(sample).cast("string"), F.col(member).cast("string")).cast("binary")), member)
    many = F.lit(1) + F.floor(draw(seed, sample) * most).cast("int")
    return members.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= many).drop("_n")


def valid_first(rows: DataFrame, valid: Column, group: str) -> DataFrame:
    """The valid rows of each group; all rows of groups that have no valid one."""
    any_valid = rows.groupBy(group).agg(F.bool_or(F.coalesce(valid, F.lit(False))).alias("_any"))
    return rows.join(any_valid, group).filter(F.coalesce(valid, F.lit(False)) | ~F.col("_any")).drop("_any")


def subcrop(origin: Column, extent: Column, size: Column, unit: Column) -> Column:
    """Begin of a window of `size` inside [origin, origin + extent), at a place given by unit in [0, 1)."""
    return F.when(extent > size, origin + unit * (extent - size)).otherwise(origin)


def normal(seed: str, *keys: str) -> Column:
    """A standard normal number from a seed and the row's keys."""
    u = 1 - draw(f"{seed}-u", *keys)  # never 0
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * draw(f"{seed}-v", *keys))


def between(low: float, high: float, seed: str, *keys: str) -> Column:
    return low + draw(seed, *keys) * (high - low)


def intensity(seed: str, *keys: str) -> dict[str, Column]:
    """brightness, contrast, gamma and noise of an image's augmentation, drawn for its keys."""
    return {
        "brightness": between(-20.0, 20.0, f"{seed}-b", *keys), "contrast": between(0.8, 1.2, f"{seed}-c", *keys),
        "gamma": between(0.8, 1.2, f"{seed}-g", *keys), "noise": between(0.0, 5.0, f"{seed}-n", *keys),
    }


def placed(samples: DataFrame, crops: DataFrame, group: str, sample: str, seed: str = "p") -> DataFrame:
    """samples (group, sample) with a crop of their group and a slice of it, each alike likely: crop_id and z_index.

    crops: group, crop_id, depth. Crops are numbered within their group, and a sample's draw picks the number. A group without
    crops leaves its samples out.
    """
    order = Window.partitionBy(group).orderBy("crop_id")
    numbered = crops.select(group, "crop_id", "depth").withColumn("_k", F.row_number().over(order) - 1)
    many = numbered.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rows = samples.join(many, group).withColumn("_k", F.floor(draw(f"{seed}-crop", sample) * F.col("_n")).cast("int"))
    return rows.join(numbered, [group, "_k"]).withColumn("z_index", F.floor(draw(f"{seed}-z", sample) * F.col("depth")).cast("long")).drop("_k", "_n", "depth")


def logit_normal(normal: Column) -> Column:
    """Noise level from a normal number."""
    return 1 / (1 + F.exp(-normal))
