"""Requests to an evaluating model, built from a slice's state: current parameters, earlier attempts, the best so far.

The wordings are fixed values: what a model replies depends on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A text in quotes as in a printed list: single ones, or double ones if it holds single ones only."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = escaped.contains("'") & ~escaped.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def printed(texts: Column) -> Column:
    """A list of texts as it is printed."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(texts, F.array().cast("array<string>")), quoted), ", "), F.lit("]"))


def _two(number: Column) -> Column:
    """A number with two digits after the point, rounded from its exact binary value, exact halves to even.

    200 times the number is known exactly as a rounded product and its error, which tells halves from what is just beside them.
    """
    size = F.abs(number.cast("double"))
    twice = size * 200
    high = size * 134217729.0 - (size * 134217729.0 - size)
    error = (high * 200 - twice) + (size - high) * 200
    low = F.floor(twice / 2)
    up = (error > 0) | ((error == 0) & (low % 2 == 1))
    hundredths = F.when(twice % 2 == 1, low + up.cast("int")).otherwise(F.rint(twice / 2)).cast("long")
    digits = F.concat(F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    return F.when(number < 0, F.concat(F.lit("-"), digits)).otherwise(digits)


def _settings(a: Column) -> Column:
    """Prompt, guidance and strength (if there is one) of an attempt."""
    strength = F.coalesce(F.concat(F.lit(", strength="), a["strength"].cast("string")), F.lit(""))
    return F.concat(F.lit('prompt="'), F.coalesce(a["prompt"], F.lit("")), F.lit('", guidance='), a["guidance_scale"].cast("string"), strength)


def _scores(a: Column) -> Column:
    """The sub-scores of an attempt if it has some, else its score."""
    d = a["detailed"]
    parts = [F.lit("tp="), _two(d["tp_rate"]), F.lit(" fp="), _two(d["fp_rate"]), F.lit(" fn="), _two(d["fn_rate"]), F.lit(" boundary="), _two(d["boundary_quality"]), F.lit(" dice="), _two(d["dice_score"])]
    return F.when(d.isNotNull(), F.concat(*parts)).otherwise(F.concat(F.lit("score="), _two(a["score"])))


def attempts(history: Column) -> Column:
    """The earlier attempts (array of struct prompt, guidance_scale, strength, score, detailed, issues), a line each, numbered from 1."""
    line = lambda a, i: F.concat(F.lit("  #"), (i + 1).cast("string"), F.lit(": "), _scores(a), F.lit(", "), _settings(a), F.lit(", issues="), printed(a["issues"]))
    return F.transform(history, line)


def best_of(history: Column) -> Column:
    """struct(i, a): the attempt with the highest score, the first of equal ones, and its number from 0."""
    ranked = F.transform(history, lambda a, i: F.struct((-a["score"]).alias("s"), i.alias("i"), a.alias("a")))
    first = F.array_min(F.transform(ranked, lambda r: F.struct(r["s"].alias("s"), r["i"].alias("i"))))
    return F.when(F.size(history) > 0, F.struct(first["i"].alias("i"), F.get(history, first["i"]).alias("a")))


def _opening(name: Column, description: Column | None, nm: Column | None) -> list[Column]:
    parts = [F.concat(F.lit("Evaluate the "), name, F.lit(" segmentation quality."))]
    if description is not None:
        parts.append(F.when(description != "", F.concat(F.lit("In EM, "), name, F.lit(" appear as: "), description)))
    if nm is not None:
        parts.append(F.concat(F.lit("Image resolution: "), F.format_string("%.0f", F.rint(nm)), F.lit(" nm/px.")))
    return parts


def evaluation_request(params: Column, iteration: Column, history: Column, name: Column, description: Column | None = None, nm: Column | None = None, model: str = "") -> Column:
    """The request for an image: what it shows, how it was made, and (after the first iteration) all attempts and the best of them."""
    said = [F.concat(F.lit("The first image is the original EM. The second image is the "), name, F.lit(" segmentation mask output.")), *_opening(name, description, nm)]
    if model:
        said.append(F.lit(f"Generator model: {model}."))
    strength = F.concat(F.lit("strength="), params["strength"].cast("string"))
    made = F.concat_ws(", ", F.concat(F.lit("guidance_scale="), params["guidance_scale"].cast("string")), strength, F.concat(F.lit("num_inference_steps="), params["num_inference_steps"].cast("string")))
    said += [F.concat(F.lit('Current prompt: "'), F.coalesce(params["prompt"], F.lit("")), F.lit('"')), F.concat(F.lit("Current params: "), made), F.concat(F.lit("Iteration "), (iteration + 1).cast("string"), F.lit("."))]
    top = best_of(history)
    best = F.concat(F.lit("\nBEST so far: #"), (top["i"] + 1).cast("string"), F.lit(" with score="), _two(top["a"]["score"]), F.lit(", "), _settings(top["a"]))
    some = F.size(history) > 0
    earlier = [F.when(some, F.lit("\nPrevious attempts:")), F.when(some, F.array_join(attempts(history), "\n")), F.when(some, best), F.when(some, F.lit("Build on what worked best. Do NOT repeat prompts that scored poorly."))]
    return F.concat_ws("\n", *said, *earlier, F.lit("\nRespond with JSON only."))


def point_request(params: Column, iteration: Column, history: Column, name: Column, width: Column, height: Column, description: Column | None = None, nm: Column | None = None) -> Column:
    """The request for a mask made from points: the points with their positions, and how many earlier attempts had."""
    size = F.concat(width.cast("string"), F.lit("x"), height.cast("string"))
    said = [F.concat(F.lit("The first image is the original EM ("), size, F.lit("). The second image is the SAM3 "), name, F.lit(" segmentation mask.")), *_opening(name, description, nm)]

    def point(p: Column, i: Column) -> Column:
        label = F.coalesce(p["label"], F.lit(1))
        place = F.concat(F.lit("["), i.cast("string"), F.lit("] ("), p["x"].cast("string"), F.lit(", "), p["y"].cast("string"), F.lit(") label="), label.cast("string"))
        return F.when(label == 1, F.concat(place, F.lit(" instance="), F.coalesce(p["instance"].cast("string"), F.lit("?")))).otherwise(place)

    points = params["points"]
    listed = F.concat(F.lit("\nCurrent points ("), F.size(points).cast("string"), F.lit("): "), F.array_join(F.transform(points, point), ", "))
    said += [F.when(F.size(points) > 0, listed), F.concat(F.lit("Iteration "), (iteration + 1).cast("string"), F.lit("."))]

    def line(a: Column, i: Column) -> Column:
        score = F.when(a["detailed"].isNotNull(), F.concat(F.lit("dice="), _two(a["detailed"]["dice_score"]))).otherwise(F.concat(F.lit("score="), _two(a["score"])))
        return F.concat(F.lit("  #"), (i + 1).cast("string"), F.lit(": "), score, F.lit(", "), a["n_points"].cast("string"), F.lit(" points, issues="), printed(a["issues"]))

    some = F.size(history) > 0
    return F.concat_ws("\n", *said, F.when(some, F.lit("\nPrevious attempts:")), F.when(some, F.array_join(F.transform(history, line), "\n")), F.lit("\nRespond with JSON only (include point_refinement)."))
