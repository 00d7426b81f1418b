"""Reports of runs as JSON lines, and norms as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planestack.sources import formats


def evaluation_json(iterations: DataFrame) -> DataFrame:
    """value: one JSON document for each iteration, with a generation and an evaluation section (absent fields are left out)."""
    have = set(iterations.columns)
    of = lambda names: F.struct(*[F.col(n) for n in names if n in have])
    generation = of(["prompt", "num_inference_steps", "guidance_scale", "strength", "seed", "threshold"] if "prompt" in have else ["i"])
    return iterations.select(F.to_json(F.struct("run", "i", generation.alias("generation"), of(["score", "delta", "best", "reverted"]).alias("evaluation"))).alias("value"))


def run_summary(iterations: DataFrame) -> DataFrame:
    """value: one JSON document for each run: iterations, best and mean score."""
    s = iterations.groupBy("run").agg(F.count(F.lit(1)).alias("iterations"), F.max("score").alias("best"), F.avg("score").alias("mean"))
    return s.select(F.to_json(F.struct("*")).alias("value"))


def evaluation_documents(history: DataFrame) -> DataFrame:
    """name, content: the JSON document of each iteration of a refinement (operators.refine), in the folder of its run and iteration.

    A generation section tells what was used, an evaluation section what was said; an iteration without an image has the error as
    its issue and the score 0. Absent values are left out.
    """
    used = F.struct("prompt", "guidance_scale", "num_inference_steps", "seed", "strength", F.when(F.col("changed").isNotNull(), F.struct("changed", "direction")).alias("param_change"))
    failed = F.array(F.concat(F.lit("Generation failed: "), F.col("error")))
    said = F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("issues", failed).alias("issues"), F.when(F.col("error").isNotNull(), F.lit("generation error")).alias("reasoning"), F.struct(F.col("request").alias("user")).alias("vlm_prompts"))
    name = F.concat(F.lit("run_"), F.col("run").cast("string"), F.lit("/iteration_"), F.format_string("%02d", "i"), F.lit("/evaluation.json"))
    return history.select(name.alias("name"), F.to_json(F.struct(used.alias("generation"), said.alias("evaluation"))).alias("content"))


def stack_summary(scores: DataFrame, z_start: int = 0) -> DataFrame:
    """name, content: the summary of each stack (stack, index, score): slices, mean score, and the scores in their order."""
    rows = scores.groupBy("stack").agg(F.count(F.lit(1)).alias("total_slices"), F.sort_array(F.collect_list(F.struct("index", "score"))).alias("s"), F.avg("score").alias("mean_score"))
    body = F.struct("total_slices", F.lit(z_start).alias("z_start"), F.transform("s", lambda r: r["score"]).alias("per_slice_scores"), "mean_score")
    return rows.select(F.concat(F.col("stack").cast("string"), F.lit("/zstack_summary.json")).alias("name"), F.to_json(body).alias("content"))


def points_summary(points: DataFrame) -> DataFrame:
    """name, content: the points of each stack (stack, index, points) by slice."""
    rows = points.groupBy("stack").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("index", "points")))).alias("m"))
    return rows.select(F.concat(F.col("stack").cast("string"), F.lit("/per_slice_points.json")).alias("name"), F.to_json("m").alias("content"))


def run_metadata(spark: SparkSession, args: dict, command: list[str], config: str | None = None) -> DataFrame:
    """name, content of what a run was started with: args.json, command.txt, and config.yaml if there was a config's text."""
    import json

    files = [("args.json", json.dumps(args, indent=2, default=str)), ("command.txt", " ".join(command) + "\n")]
    files += [("config.yaml", config)] if config is not None else []
    return spark.createDataFrame(files, "name string, content string")


def save(files: DataFrame, folder: str) -> None:
    """Write name, content (text) as files."""
    formats.register(files.sparkSession)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("files").mode("append").save(folder)


def write_norms(norms: DataFrame, path: str, key: str = "dataset") -> None:
    """One CSV file in the order of the keys: a row for each dataset, so it is small."""
    rows = norms.select(F.col(key).alias("dataset"), "min", "max", F.lit("False").alias("inverted"), F.lit("True").alias("set_norm"))
    rows.orderBy("dataset").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
