"""The refinement loop against a plain one, a slice at a time; requests, replies and refused calls."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from planestack import dims, models
from planestack.functions import replies, requests
from planestack.operators import refine

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


@models.painter("plain")
def _painter():
    return lambda f: [ValueError("none") if fails == i else json.dumps([g, s if s == s else None, int(n), p, len(pts)]).encode() for fails, i, g, s, n, p, pts in zip(f["fails"], f["iteration"], f["guidance_scale"], f["strength"], f["num_inference_steps"], f["prompt"], f["points"], strict=True)]


def reply_to(image, run, i):
    g, s, n, p, pts = json.loads(image)
    score = 1 / (1 + abs(g - 3 - run % 5 / 3) + abs((s or 0.5) - 0.6) + abs(n - 30) / 40 + (len(p or "") % 7) / 50 + (0.4 if (run + i) % 6 == 5 else 0))
    refined = {"remove_indices": [0] if i % 2 else [], "add_points": [{"x": i, "y": 2}]} if run % 2 else None
    return {"score": score, "issues": [f"i{i}"], "refined_prompt": ["", None, "short", "a longer prompt"][(run + i) % 4], "point_refinement": refined}


@models.judge("plain")
def _judge():
    return lambda f: ["```json\n" + json.dumps(reply_to(m, r, i)) + "\n```" for m, r, i in zip(f["image"], f["run"], f["iteration"], strict=True)]


def plain(run, backend, iterations, enough, text_mode, prompts, fails, seed):
    """(i, prompt, steps, guidance, strength, seed, points, score) of each iteration of one slice."""
    tunable = dims.TUNABLE[backend]
    names = list(tunable)
    now = {"prompt": prompts[0] if text_mode else "start", "num_inference_steps": 28, "guidance_scale": 3.5, "strength": 0.75 if "strength" in tunable else None, "seed": seed, "points": []}
    index, direction, tried, old, best, best_score, before, out = 0, 1, False, None, None, -1.0, None, []

    def with_value(p, name, v):
        return {**p, name: round(v) if name == "num_inference_steps" else v}

    for i in range(iterations):
        row = (i, now["prompt"], now["num_inference_steps"], now["guidance_scale"], now["strength"], now["seed"], len(now["points"]))
        if fails == i:
            out.append((*row, None))
            continue
        r = reply_to(json.dumps([now["guidance_scale"], now["strength"], now["num_inference_steps"], now["prompt"], len(now["points"])]), run, i)
        score, hint = r["score"], r["refined_prompt"]
        out.append((*row, score))
        if score >= enough:
            break
        if score > best_score:
            best_score, best = score, now
        new = {**now, "prompt": prompts[(i + 1) % len(prompts)] if text_mode else hint or now["prompt"]}
        if r["point_refinement"]:
            new["points"] = [p for k, p in enumerate(now["points"]) if k not in r["point_refinement"]["remove_indices"]] + r["point_refinement"]["add_points"]
        if names and i == 0:
            old = now[names[0]]
            new = with_value(new, names[0], max(tunable[names[0]][0], min(tunable[names[0]][1], old + old * 0.05)))
            index, tried = 0, True
        elif names:
            back, name = now, names[index]
            if score - (before or 0) > 0:
                index, direction, tried = (index + 1) % len(names), 1, False
            else:
                back = now if old is None else with_value(now, name, old)
                new = {**back, "prompt": hint or back["prompt"]}
                if tried:
                    direction, tried = -1, False
                else:
                    index, direction = (index + 1) % len(names), 1
            if score < best_score - 0.1:
                new = {**best, "prompt": hint or best["prompt"]}
            name = names[index]
            tried = direction == 1
            low, high = tunable[name]
            old = back[name]
            new = with_value(new, name, max(low, min(high, new[name] + new[name] * 0.05 * direction)))
            if new["seed"] is not None:
                new["seed"] = seed + i + 1
        now, before = new, score
    return out


@pytest.mark.parametrize("backend,text_mode", [("flux", False), ("glm", True), ("gemini", False)])
def test_against_a_plain_loop(spark, backend, text_mode):
    prompts = ["one", "two", "three"]
    rows = [(r, r % 4 - 1, 10 * r if r % 3 else None) for r in range(24)]
    slices = spark.createDataFrame(rows, "run long, fails int, seed long").withColumn("prompt", F.lit("start")).withColumn("prompts", F.array(*map(F.lit, prompts)))
    got = refine.refine(slices.repartition(3), "plain", "plain", 7, 0.75, backend, text_mode=text_mode, calls={"batch": 5})
    found = {}
    for r in sorted(got.history.collect(), key=lambda r: (r.run, r.i)):
        found.setdefault(r.run, []).append((r.i, r.prompt, r.num_inference_steps, r.guidance_scale, r.strength, r.seed, r.n_points, r.score))
    for run, fails, seed in rows:
        want = plain(run, backend, 7, 0.75, text_mode, prompts, fails, seed)
        assert [tuple(pytest.approx(x, abs=1e-9) if isinstance(x, float) else x for x in w) for w in want] == found[run]
    best = {r.run: r.score for r in got.best().collect()}
    assert best == {run: max(r[-1] for r in found[run] if r[-1] is not None) for run in found}
    made = {run: [r[-1] for r in found[run] if r[-1] is not None] for run in found}
    assert {r.run: (r.iterations, r.converged) for r in got.outcome().collect()} == {run: (len(m), max(m) >= 0.75) for run, m in made.items()}


def test_one_iteration_is_not_judged_and_no_slices_give_no_rows(spark):
    slices = spark.createDataFrame([(1, -1), (2, 0)], "run long, fails int")
    rows = {r.run: r for r in refine.refine(slices, "plain", "plain", 1).history.collect()}
    assert (rows[1].score, rows[1].accepted, rows[2].score, rows[2].error) == (0.0, False, None, "none")
    assert refine.refine(slices.limit(0), "plain", "plain", 3).history.count() == 0


@models.judge("long")
def _long_judge():
    """Replies that come to their point late: thoughts first, and a long text within the object or one that is cut off."""

    def reply(m, r, i):
        said = reply_to(m, r, i)
        body = json.dumps({"reasoning": "x\ny " * 40_000, **said} if r % 3 else {"reasoning": "short", **said, "refined_prompt": 'a "b" ' * 20_000})
        return "thought " * 1000 + (body if r % 2 else "```json\n" + body + "\n```")

    return lambda f: [reply(m, r, i) for m, r, i in zip(f["image"], f["run"], f["iteration"], strict=True)]


def test_whole_replies_are_read(spark):
    """What a reply says behind its first 4000 characters counts like the rest."""
    slices = spark.createDataFrame([(r, -1, "start") for r in range(6)], "run long, fails int, prompt string")
    rows = refine.refine(slices, "plain", "long", 2, 2.0).history.collect()
    for r in (r for r in rows if r.i == 0):
        want = reply_to(json.dumps([3.5, 0.75, 28, "start", 0]), r.run, 0)
        assert (r.score, r.issues) == (pytest.approx(want["score"], abs=1e-9), ["i0"])
    later = {r.run: r.prompt for r in rows if r.i == 1}
    assert later[0] == later[3] == 'a "b" ' * 20_000 and later[2] == "short"


def test_long_strings_of_broken_objects(spark):
    """A string is salvaged however long it is and however many escapes it has."""
    body = r'long \n \" \u00e9 ' * 20_000
    rows = spark.createDataFrame([("z " * 5000 + '{"refined_prompt": "' + body + '", "issues": ["i"], "score": 0.5, "reasoning": "cut ' + body,)], "t string").withColumn("o", replies.json_of(F.col("t")))
    r = rows.select(replies.evaluation(F.col("t"), F.col("o")).alias("r"), replies.initial_prompt(F.regexp_replace("t", "refined_prompt", "prompt"), F.col("o"), F.lit("d")).alias("p")).first()
    assert (r.r.refined_prompt, r.p, r.r.score, r.r.issues, r.r.reasoning) == (body, body, 0.5, ["i"], "")


def test_all_images_fail(spark):
    slices = spark.createDataFrame([(1, 0)], "run long, fails int")
    refined = refine.refine(slices, "plain", "plain", 1)
    assert refined.best().count() == 0 and refined.outcome().count() == 0


def test_refused_calls_are_asked_again():
    import pandas as pd

    waits, asked = [], []

    def model(frame):
        asked.append(frame["k"].tolist())
        if len(asked) == 2:
            raise models.Busy("all busy")
        return [models.Busy("one busy") if k == 2 or (k == 1 and len(asked) == 1) else ValueError("bad") if k == 3 else k for k in frame["k"]]

    got = models.attempted(model, pd.DataFrame({"k": [0, 1, 2, 3]}), 3, 30.0, waits.append)
    assert got == ([0, 1, None, None], [None, None, "one busy", "bad"], [1, 3, 3, 1])
    assert waits == [30.0, 60.0] and asked == [[0, 1, 2, 3], [1, 2], [1, 2]]
    with pytest.raises(ValueError):
        models.attempted(lambda f: [], pd.DataFrame({"k": [1]}))


def test_two_digits_are_those_of_the_exact_value(spark):
    values = [0.0, 0.005, 0.015, 0.125, 0.375, 0.625, 0.875, 0.075, 0.285, 0.995, 1.0, 2.675, 1.005, 0.1, 123.455, -0.125, -2.5] + [i / 997 for i in range(200)] + [i / 200 for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", requests._two(F.col("v")).alias("s"))
    assert all(r.s == f"{r.v:.2f}" for r in df.collect())


def test_requests_and_point_replies(spark):
    texts = ["a", "it's", 'say "x"', "both ' and \"", "back\\slash"]
    df = spark.createDataFrame([(texts,), (None,)], "t array<string>").select(requests.printed(F.col("t")).alias("s"))
    assert sorted(r.s for r in df.collect()) == sorted([str(texts), "[]"])
    point = "array<struct<x:int,y:int,label:int,instance:int>>"
    rows = spark.createDataFrame([([(1, 2, 1, 4), (3, 4, 0, None), (5, 6, 1, None)],)], f"points {point}")
    history = F.array(F.struct(F.lit(0.5).alias("score"), F.lit(None).cast("struct<dice_score:double>").alias("detailed"), F.lit(2).alias("n_points"), F.array(F.lit("few")).alias("issues")))
    text = rows.select(requests.point_request(F.struct("points"), F.lit(1), history, F.lit("nucleus"), F.lit(64), F.lit(32), F.lit("dark"), F.lit(4.4))).first()[0]
    assert text.split("\n")[2:] == ["Image resolution: 4 nm/px.", "", "Current points (3): [0] (1, 2) label=1 instance=4, [1] (3, 4) label=0, [2] (5, 6) label=1 instance=?", "Iteration 2.", "", "Previous attempts:", "  #1: score=0.50, 2 points, issues=['few']", "", "Respond with JSON only (include point_refinement)."] or text.split("\n")[2] == "In EM, nucleus appear as: dark"
    moved = spark.createDataFrame([('{"point_refinement": {"remove_indices": [1], "add_points": [{"x": 1, "y": 2}]}}',), ("{}",)], "t string").select(replies.point_refinement(F.col("t")).alias("m")).collect()
    assert moved[0].m.removed == [1] and moved[0].m.added[0].label == 1 and moved[1].m is None
