"""Semi-structured model replies and prompts, as Column expressions (one Arrow function for nested braces)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from planestack import dims, schemas

# Patterns of what replies hold, here and in the parsers below.
NUMBER = r"([0-9.]+)"
STRING = r'"((?:[^"\\]|\\.)*+)"'  # possessive: else Java's matcher goes a call deeper for each character, and long strings end its stack
DEFAULT_ISSUE = "Could not parse VLM response"
SUBSCORES = [f.name for f in schemas.SCORES.fields]


def _first_objects(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first balanced JSON object of each text, or null. Nesting is not regular, so no Column expression finds its end."""
    import re

    token = re.compile(r'\\.|["{}]', re.S)

    def find(text):
        if text is None or (start := text.find("{")) < 0:
            return None
        depth, quoted = 0, False
        for m in token.finditer(text, start):
            if m[0] == '"':
                quoted = not quoted
            elif not quoted and m[0] in "{}":
                depth += 1 if m[0] == "{" else -1
                if not depth:
                    return text[start : m.end()]
        return None

    for batch in texts:
        yield pd.Series([find(t) for t in batch], dtype=object)


def first_object(text: Column) -> Column:
    """The first balanced JSON object of a text, or null."""
    return F.pandas_udf(_first_objects, "string")(text)


def _field(text: Column, name: str, value: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf'"{name}"\s*:\s*{value}', 1), F.lit(""))


def initial_prompt(text: Column, parsed_object: Column, default: Column) -> Column:
    """The prompt of a reply: of its JSON object, else the first one that is quoted whole, else the default.

    parsed_object: the first balanced JSON object as a string, null if none. An object that doesn't parse, or whose prompt is
    missing or empty, leaves the choice to the quoted one, which may be empty.
    """
    said = F.nullif(F.from_json(parsed_object, "prompt string")["prompt"], F.lit(""))
    quoted = rf'"prompt"\s*:\s*{STRING}'
    return F.coalesce(said, F.when(text.rlike(quoted), F.regexp_extract(text, quoted, 1)), default)


def evaluation(text: Column, parsed_object: Column) -> Column:
    """struct(score, dice_used, detailed, issues, refined_prompt, should_stop, reasoning) of a reply.

    parsed_object: its JSON object as a string (fenced, or the first balanced one), null if none. Where that doesn't parse, the
    fields that are whole are salvaged one by one; without any, the score is 0.5 and the issue says so.
    """
    shape = "score double, detailed_scores struct<tp_rate:double,fp_rate:double,fn_rate:double,boundary_quality:double,dice_score:double>, issues array<string>, refined_prompt string, should_stop boolean, reasoning string"
    whole = F.from_json(parsed_object, shape)
    good = F.coalesce(F.get_json_object(parsed_object, "$").isNotNull(), F.lit(False))
    number = lambda n: F.expr("double(null)") if n is None else _field(text, n, NUMBER).try_cast("double")
    listed = F.regexp_extract(text, r'"issues"\s*:\s*\[([^\]]*)\]', 1)
    salvaged_issues = F.when(text.rlike(r'"issues"\s*:\s*\['), F.regexp_extract_all(listed, F.lit(r'"([^"]*)"'), F.lit(1)))
    some = F.coalesce(*[_field(text, n, NUMBER) for n in ("score", *SUBSCORES)], _field(text, "refined_prompt", STRING), _field(text, "should_stop", "(true|false)"), _field(text, "reasoning", STRING)).isNotNull() | salvaged_issues.isNotNull()
    has_detail = F.when(good, whole["detailed_scores"]["tp_rate"].isNotNull()).otherwise(number("tp_rate").isNotNull())
    dice = F.when(good, whole["detailed_scores"]["dice_score"]).otherwise(number("dice_score"))
    plain = F.when(good, whole["score"]).otherwise(number("score"))
    score = F.when(has_detail, F.coalesce(dice, F.lit(0.5))).otherwise(F.coalesce(plain, F.lit(0.5)))
    issues = F.when(good, F.coalesce(whole["issues"], F.array().cast("array<string>"))).when(some, F.coalesce(salvaged_issues, F.array().cast("array<string>"))).otherwise(F.array(F.lit(DEFAULT_ISSUE)))
    part = lambda n: F.coalesce(F.when(good, whole["detailed_scores"][n]).otherwise(number(n)), F.lit(0.5)).alias(n)
    return F.struct(
        score.alias("score"),
        has_detail.alias("dice_used"),
        F.when(has_detail, F.struct(*[part(n) for n in SUBSCORES])).alias("detailed"),
        issues.alias("issues"),
        F.when(good, whole["refined_prompt"]).otherwise(_field(text, "refined_prompt", STRING)).alias("refined_prompt"),
        F.coalesce(F.when(good, whole["should_stop"]).otherwise(_field(text, "should_stop", "(true|false)") == "true"), F.lit(False)).alias("should_stop"),
        F.coalesce(F.when(good, whole["reasoning"]).otherwise(_field(text, "reasoning", STRING)), F.lit("")).alias("reasoning"),
    )


def point_refinement(parsed_object: Column) -> Column:
    """struct(removed, added) of a reply's object; null if it has none."""
    kind = "point_refinement struct<add_points:array<struct<x:int,y:int,label:int,instance:int>>, remove_indices:array<int>>"
    r = F.from_json(parsed_object, kind)["point_refinement"]
    added = F.transform(r["add_points"], lambda p: p.withField("label", F.coalesce(p["label"], F.lit(1))))
    none = F.array().cast("array<struct<x:int,y:int,label:int,instance:int>>")
    return F.when(r.isNotNull(), F.struct(F.coalesce(r["remove_indices"], F.array().cast("array<int>")).alias("removed"), F.coalesce(added, none).alias("added")))


def json_of(text: Column) -> Column:
    """The fenced JSON object of a text, else its first balanced one."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(fenced, first_object(text))


def _point(x: Column, y: Column, w: Column, h: Column) -> Column:
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), n - 1).cast("int")
    return F.struct(clamp(x, w).alias("x"), clamp(y, h).alias("y"))


def coordinates(text: Column, w: Column, h: Column) -> Column:
    """array<struct<x,y>> of native pointing replies: coords="..." triplets, bare triplets, numbered or single legacy points."""
    triplet = r"\d+\s+\d{3,4}\s+\d{3,4}"

    def scaled(found: Column) -> Column:
        part = lambda m, k: F.regexp_extract(m, r"(\d+)\s+(\d{3,4})\s+(\d{3,4})", k).cast("double")
        return F.transform(found, lambda m: _point((part(m, 2) / 1000 * w).cast("int"), (part(m, 3) / 1000 * h).cast("int"), w, h))

    quoted = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r'coords="([^"]+)"'), F.lit(1)), lambda c: F.regexp_extract_all(c, F.lit(triplet), F.lit(0))))
    bare = F.regexp_extract_all(F.regexp_extract(text, r'((?:\d+\s+\d{3,4}\s+\d{3,4}\s*)+)"?\s*>', 1), F.lit(triplet), F.lit(0))
    attributes = F.regexp_extract(text, r"<points\s+([^>]+)>", 1)
    of = lambda axis: F.regexp_extract_all(attributes, F.lit(rf'{axis}\d+\s*=\s*"[^"]+"'), F.lit(0))
    number = lambda m: F.regexp_extract(m, r'"([^"]+)"', 1).try_cast("double")
    name = lambda m: F.regexp_extract(m, r"^[xy](\d+)", 1)
    pairs = F.transform(of("x"), lambda m: F.struct(number(m).alias("x"), F.get(F.transform(F.filter(of("y"), lambda o: name(o) == name(m)), number), F.lit(0)).alias("y")))
    pairs = F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    single = F.regexp_extract_all(text, F.lit(r'<point\s+x\s*=\s*"[^"]+"\s+y\s*=\s*"[^"]+"'), F.lit(0))
    single = F.transform(single, lambda m: F.struct(F.regexp_extract(m, r'x\s*=\s*"([^"]+)"', 1).try_cast("double").alias("x"), F.regexp_extract(m, r'y\s*=\s*"([^"]+)"', 1).try_cast("double").alias("y")))
    legacy = F.transform(F.concat(pairs, single), lambda p: _point((p["x"] * w / 100).cast("int"), (p["y"] * h / 100).cast("int"), w, h))
    return F.when(F.size(quoted) > 0, scaled(quoted)).when(F.size(bare) > 0, scaled(bare)).otherwise(legacy)


def tuples(text: Column, w: Column, h: Column) -> Column:
    """array<struct<x,y,instance>> of (x, y) tuples, those of a line being one instance; the centre if there are none."""
    lines = F.transform(F.split(text, "\n"), lambda t: F.regexp_extract_all(t, F.lit(r"\(\s*\d+\s*,\s*\d+\s*\)"), F.lit(0)))
    lines = F.filter(lines, lambda t: F.size(t) > 0)
    number = lambda m, k: F.regexp_extract(m, r"\(\s*(\d+)\s*,\s*(\d+)\s*\)", k).cast("int")

    def points(found: Column, i: Column) -> Column:
        def one(m: Column) -> Column:
            p = _point(number(m, 1), number(m, 2), w, h)
            return F.struct(p["x"].alias("x"), p["y"].alias("y"), i.cast("int").alias("instance"))

        return F.transform(found, one)

    found = F.flatten(F.transform(lines, points))
    middle = F.array(F.struct(F.floor(w / 2).cast("int").alias("x"), F.floor(h / 2).cast("int").alias("y"), F.lit(0).alias("instance")))
    return F.when(F.size(found) > 0, found).otherwise(middle)


def listed_points(parsed_object: Column, w: Column, h: Column) -> Column:
    """array<struct<x,y,label,instance>> of a JSON reply's points; foreground points without an instance get their position."""
    points = F.from_json(parsed_object, "points array<struct<x:double,y:double,label:int,instance:int>>")["points"]

    def one(p: Column, i: Column) -> Column:
        at, label = _point(p["x"].cast("int"), p["y"].cast("int"), w, h), F.coalesce(p["label"], F.lit(1))
        return F.struct(at["x"].alias("x"), at["y"].alias("y"), label.alias("label"), F.when(label == 1, F.coalesce(p["instance"], i.cast("int"))).alias("instance"))

    shaped = F.transform(points, one)
    return F.filter(shaped, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def loose_points(text: Column, w: Column, h: Column) -> Column:
    """array<struct<x,y,label,instance>> of the points that stand whole in a text whose JSON is broken; each is its own instance."""
    found = F.regexp_extract_all(text, F.lit(r'\{\s*"x"\s*:\s*\d+\s*,\s*"y"\s*:\s*\d+(?:\s*,\s*"label"\s*:\s*\d+)?\s*\}'), F.lit(0))
    number = lambda m, name: F.regexp_extract(m, rf'"{name}"\s*:\s*(\d+)', 1)

    def one(m: Column, i: Column) -> Column:
        at = _point(number(m, "x").try_cast("int"), number(m, "y").try_cast("int"), w, h)
        label = F.when(m.contains('"label"'), number(m, "label").try_cast("int")).otherwise(F.lit(1))
        return F.struct(at["x"].alias("x"), at["y"].alias("y"), label.alias("label"), F.when(label == 1, i.cast("int")).alias("instance"))

    return F.transform(found, one)


def points(text: Column, parsed_object: Column, w: Column, h: Column) -> Column:
    """array<struct<x,y,label,instance>> of a reply: its JSON object's points, else loose ones, else tuples by line, else the centre.

    An object that parses and lists something settles it, even if none of what it lists is a point.
    """
    listed = F.from_json(parsed_object, "points array<string>")["points"]
    by_line = F.transform(tuples(text, w, h), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(1).alias("label"), p["instance"].alias("instance")))
    loose = loose_points(text, w, h)
    none = F.array().cast("array<struct<x:int,y:int,label:int,instance:int>>")
    return F.when(F.size(listed) > 0, F.coalesce(listed_points(parsed_object, w, h), none)).when(F.size(loose) > 0, loose).otherwise(by_line)


def accepted(reply: Column, label: Column) -> Column:
    """Whether a point stays: background always does, and so does one whose reply doesn't parse or doesn't say."""
    body = F.trim(F.regexp_replace(F.when(reply.contains("```"), F.get(F.split(reply, "```"), F.lit(1))).otherwise(reply), "^json", ""))
    return (label == 0) | F.coalesce(F.get_json_object(body, "$.valid") != "false", F.lit(True))


def refined_points(points: Column, removed: Column, added: Column) -> Column:
    """Points without those at the removed positions, then the added ones; new foreground points get the next instance numbers."""
    kept = F.filter(points, lambda p, i: ~F.array_contains(removed, i))
    top = F.coalesce(F.array_max(F.transform(F.filter(kept, lambda p: p["label"] == 1), lambda p: p["instance"])), F.lit(-1))
    lacks = lambda p: (p["label"] == 1) & p["instance"].isNull()
    before = lambda i: F.size(F.filter(F.slice(added, 1, i + 1), lacks))
    new = F.transform(added, lambda p, i: F.when(lacks(p), p.withField("instance", (top + before(i)).cast("int"))).otherwise(p))
    return F.concat(kept, new)


def prompt(kind: str, name: Column, color: Column, nm: Column | None = None, description: Column | None = None) -> Column:
    """A prompt of one of the fixed kinds, with resolution and description if given."""
    body = F.replace(F.replace(F.lit(dims.BODIES[kind]), F.lit("{name}"), name), F.lit("{color_name}"), color)
    return _with_context(body, nm, name, description)


def _with_context(body: Column, nm: Column | None, name: Column | None = None, description: Column | None = None) -> Column:
    parts = [F.lit(dims.PREAMBLE)]
    if nm is not None:
        parts.append(F.replace(F.lit(dims.RESOLUTION), F.lit("{nm}"), F.format_string("%.0f", F.rint(nm))))
    if description is not None:
        parts.append(F.when(description != "", F.concat(F.lit("In EM, "), name, F.lit(" appear as: "), description)))
    return F.concat_ws(" ", *parts, body)


def varied_prompt(template: Column, name: Column, color: Column, nm: Column | None = None) -> Column:
    """A prompt from the template with this number."""
    text = F.element_at(F.array(*[F.lit(t) for t in dims.PROMPT_TEMPLATES]), template + 1)
    return _with_context(F.replace(F.replace(text, F.lit("{name}"), name), F.lit("{color_name}"), color), nm)


def multi_prompt(items: Column, template: int = 0) -> Column:
    """A prompt for several organelles: array of struct(name, color_name), joined by commas and a last "and"."""
    said = F.transform(items, lambda o: F.concat(F.lit("the "), o["name"], F.lit(" in "), o["color_name"]))
    joined = F.when(F.size(said) == 1, said[0]).otherwise(F.concat(F.array_join(F.slice(said, 1, F.size(said) - 1), ", "), F.lit(" and "), F.element_at(said, -1)))
    return F.concat(F.lit(dims.PREAMBLE + " "), F.replace(F.lit(dims.MULTI_TEMPLATES[template]), F.lit("{instructions}"), joined))


def history_line(i: Column, score: Column, prompt_text: Column, guidance: Column) -> Column:
    """One earlier attempt as a line of the next request."""
    return F.concat(F.lit("  #"), i.cast("string"), F.lit(": score="), F.format_string("%.2f", score), F.lit(', prompt="'), prompt_text, F.lit('", guidance='), guidance.cast("string"))
