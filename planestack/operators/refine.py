"""Refinement histories: best scores, stops, parameter steps, and the loop that makes them."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planestack import dims, models, schemas
from planestack.functions import replies, requests
from planestack.sources import scratch

#: A score this far under the best so far is taken back.
DROP = 0.1
#: Slices that a task starts with, and rows that a worker holds at once: both bound what the models' processes take.
SLICES, BATCH_ROWS = 4096, 512


def annotated(history: DataFrame) -> DataFrame:
    """run, i, score with delta (to the iteration before), best (so far), best_i (first of the best), reverted."""
    before = Window.partitionBy("run").orderBy("i")
    sofar = before.rowsBetween(Window.unboundedPreceding, 0)
    best = F.max("score").over(sofar)
    rows = history.withColumns({"delta": F.col("score") - F.lag("score").over(before), "best": best})
    return rows.withColumns(
        {
            "delta": F.coalesce("delta", F.lit(0.0)),
            "best_i": F.min_by("i", F.struct(-F.col("score"), F.col("i"))).over(sofar),
            "reverted": F.col("score") < F.col("best") - DROP,
        }
    )


def stopped(history: DataFrame, enough: float) -> DataFrame:
    """One row for each run: iterations made until a score was enough (or all), whether it was, the best score and its i."""
    first = history.groupBy("run").agg(F.min(F.when(F.col("score") >= enough, F.col("i"))).alias("stop"))
    seen = history.join(first, "run").filter(F.col("stop").isNull() | (F.col("i") <= F.col("stop")))
    return seen.groupBy("run").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.max(F.col("stop").isNotNull()).alias("converged"),
        F.max("score").alias("best"),
        F.min_by("i", F.struct(-F.col("score"), F.col("i"))).alias("best_i"),
    )


def stepped(value: Column, direction: Column, low: float | None = None, high: float | None = None, whole: bool = False) -> Column:
    """A parameter one step (5 % of itself) up or down, kept in its range; whole ones are rounded, ties to even."""
    new = value + value * dims.STEP_FRACTION * direction
    if low is not None:
        new = F.least(F.greatest(new, F.lit(float(low))), F.lit(float(high)))
    return F.rint(new).cast("long") if whole else new


def with_defaults(params: DataFrame, backend: str) -> DataFrame:
    """num_inference_steps, guidance_scale and strength with the backend's defaults where they hold the mark for unset."""
    steps, guidance, strength = dims.BACKEND_DEFAULTS.get(backend, (28, 3.5, None))
    unset = dims.UNSET
    pick = lambda c, mark, default: F.when(F.col(c) != mark, F.col(c)).otherwise(F.lit(default))
    return params.withColumns(
        {
            "num_inference_steps": pick("num_inference_steps", unset[0], steps),
            "guidance_scale": pick("guidance_scale", unset[1], guidance),
            "strength": pick("strength", unset[2], strength) if strength is not None else F.lit(None).cast("double"),
        }
    )


def next_prompt(i: Column, prompts: Column) -> Column:
    """The prompt of the next iteration, in turn."""
    return F.element_at(prompts, (F.pmod(i + 1, F.size(prompts)) + 1).cast("int"))


_FIELDS = ["prompt", "num_inference_steps", "guidance_scale", "strength", "seed", "points"]


def _replaced(params: Column, new: dict[str, Column]) -> Column:
    """Parameters with some of them new."""
    return F.struct(*[new.get(c, params[c]).alias(c) for c in _FIELDS])


def _value(params: Column, names: list[str], index: Column) -> Column:
    """The tunable parameter with this number, as a double."""
    return F.get(F.array(*[params[n].cast("double") for n in names]), index)


def _with_value(params: Column, names: list[str], index: Column, value: Column) -> Column:
    whole = lambda n: F.rint(value).cast("long") if n == "num_inference_steps" else value
    return _replaced(params, {n: F.when(index == i, whole(n)).otherwise(params[n]) for i, n in enumerate(names)})


def _step(params: Column, names: list[str], backend: str, index: Column, direction: Column) -> Column:
    """The parameters with one of them a step up or down, within its range."""
    limits = dims.TUNABLE[backend]
    new = lambda n: stepped(params[n].cast("double"), direction, *limits[n], whole=n == "num_inference_steps")
    return _replaced(params, {n: F.when(index == i, new(n)).otherwise(params[n]) for i, n in enumerate(names)})


_POINTS = "array<struct<x:int,y:int,label:int,instance:int>>"
_PARAMS = f"struct<prompt:string,num_inference_steps:bigint,guidance_scale:double,strength:double,seed:bigint,points:{_POINTS}>"
_ATTEMPT = f"struct<prompt:string,guidance_scale:double,strength:double,n_points:int,score:double,detailed:{schemas.SCORES.simpleString()},issues:array<string>>"
#: What a slice carries from round to round, beside its own columns (`slice`) and the parameters of its next image.
_STATE = ["run", "slice", "params", "seed", "best", "param", "direction", "tried", "old", "previous", "history"]


@dataclass
class Refined:
    """history: run, i, slice, prompt, num_inference_steps, guidance_scale, strength, seed, n_points, changed, direction, image, error,
    request, score, issues, accepted: a row for each iteration of each run. paths: the tables that it lies in.
    """

    history: DataFrame
    paths: list[str]

    def best(self) -> DataFrame:
        """The row of each run's highest score (the first of equal ones); a run whose images all failed has none."""
        top = self.history.filter("score IS NOT NULL").groupBy("run").agg(F.min_by("i", F.struct(-F.col("score"), F.col("i"))).alias("i"))
        return self.history.join(top, ["run", "i"], "left_semi")

    def outcome(self) -> DataFrame:
        """run, iterations (images made), converged, best, best_i."""
        made = self.history.filter("error IS NULL")
        return made.groupBy("run").agg(F.count(F.lit(1)).alias("iterations"), F.max("accepted").alias("converged"), F.max("score").alias("best"), F.min_by("i", F.struct(-F.col("score"), F.col("i"))).alias("best_i"))


def _begun(slices: DataFrame, backend: str, text_mode: bool) -> DataFrame:
    """The state before the first round."""
    given = set(slices.columns)
    own = lambda c, kind, default: (F.col(c) if c in given else default).cast(kind).alias(c)
    prompt = F.get(F.col("prompts"), F.lit(0)).alias("prompt") if text_mode else own("prompt", "string", F.lit(None))
    fields = [prompt, own("num_inference_steps", "long", F.lit(dims.UNSET[0])), own("guidance_scale", "double", F.lit(dims.UNSET[1]))]
    fields += [own("strength", "double", F.lit(dims.UNSET[2] if "strength" in dims.TUNABLE[backend] else None)), own("seed", "long", F.lit(None)), own("points", _POINTS, F.array())]
    carried = [F.col(f"`{c}`") for c in slices.columns]
    null = lambda kind: F.lit(None).cast(kind)
    return slices.select(
        F.col("run"), F.struct(*carried).alias("slice"), F.struct(*fields).cast(_PARAMS).alias("params"), own("seed", "long", F.lit(None)),
        null(f"struct<score:double,params:{_PARAMS}>").alias("best"), F.lit(0).alias("param"), F.lit(1).alias("direction"), F.lit(False).alias("tried"),
        null("double").alias("old"), null("double").alias("previous"), F.array().cast(f"array<{_ATTEMPT}>").alias("history"),
    )


def _heard() -> dict[str, Column]:
    """said and moved: the evaluation and the better points of a whole reply and its object."""
    return {"said": F.when(F.col("reply").isNotNull(), replies.evaluation(F.col("reply"), F.col("object"))), "moved": replies.point_refinement(F.col("object"))}


def _judged(state: DataFrame, painter: str, judge: str, system: str, request: Column, heard_as: dict[str, Column], calls: dict) -> DataFrame:
    """state (with its round, i) with image, image_error, request and said (the evaluation of the reply); both models are asked in batches."""
    flat = _FIELDS
    inputs = state.select("slice.*").columns
    bare = state.select("*", *[F.col(f"slice.`{c}`").alias(f"_s_{c}") for c in inputs if c not in flat], *[F.col(f"params.{c}").alias(f"_p_{c}") for c in flat], F.col("i").alias("_p_iteration"))
    named = {f"_s_{c}": c for c in inputs if c not in flat} | {f"_p_{c}": c for c in [*flat, "iteration"]}

    def model(factory: Callable, more: dict) -> Callable:
        def made():
            f = factory()
            return lambda frame: f(frame.rename(columns=named | more))

        return made

    painted = models.called(bare, model(models.create_painter(painter), {}), list(named), "image", "binary", **calls)
    asked = painted.withColumns({"request": F.when(F.col("image_error").isNull(), request), "_system": F.lit(system)})
    heard = models.called(asked, _skipping(model(models.create_judge(judge), {"_system": "system"})), [*named, "image", "request", "_system"], "reply", "string", **calls)
    heard = heard.withColumn("object", replies.json_of(F.col("reply")))
    return heard.withColumns(heard_as).select(*_STATE, "i", "image", F.coalesce("image_error", "reply_error").alias("error"), "request", "said", "moved")


def _skipping(factory: Callable) -> Callable:
    """A judge that is asked about rows with an image only; the others have no reply."""

    def made():
        f = factory()

        def reply(frame):
            there = frame["image"].notna().to_numpy()
            found = iter(f(frame[there]) if there.any() else [])
            return [next(found) if t else None for t in there]

        return reply

    return made


def _turn(first: bool, backend: str, text_mode: bool, enough: float) -> list[dict[str, Column]]:
    """Columns, one set after the other, that move a judged state on: what was best, and the parameters of the next image.

    After the first image the first parameter goes up. A change that helped stays and the next parameter's turn comes; else it is
    taken back, and the same parameter goes down, or (if it went down) the next one up. A score 0.1 under the best goes back to the
    best parameters. A slice without an image or a reply keeps its state.
    """
    names = list(dims.TUNABLE[backend])
    score, kept = F.col("said.score"), F.col("error").isNull()
    hinted = lambda p: _replaced(p, {"prompt": F.coalesce(F.col("hint"), p["prompt"])})
    prompt = next_prompt(F.col("i"), F.col("slice.prompts")) if text_mode else F.coalesce("hint", "params.prompt")
    moved = replies.refined_points(F.coalesce(F.col("params.points"), F.array().cast(_POINTS)), F.col("moved.removed"), F.col("moved.added"))
    points = F.when(F.col("moved").isNotNull(), moved.cast(_POINTS)).otherwise(F.col("params.points"))
    steps = [
        {
            "done": kept & (score >= enough),
            "better": kept & (F.col("best").isNull() | (score > F.col("best.score"))),
            "hint": F.nullif(F.col("said.refined_prompt"), F.lit("")),
            "helped": score - F.coalesce("previous", F.lit(0.0)) > 0,
        },
        {
            "best": F.when(F.col("better"), F.struct(score.alias("score"), F.col("params").alias("params"))).otherwise(F.col("best")),
            "next": _replaced(F.col("params"), {"prompt": prompt, "points": points}),
        },
    ]
    if names and first:
        steps.append({"old_": _value(F.col("params"), names, F.lit(0)), "param_": F.lit(0), "direction_": F.lit(1), "tried_": F.lit(True), "next": _step(F.col("next"), names, backend, F.lit(0), F.lit(1))})
    elif names:
        onward = F.col("helped") | ~F.col("tried")
        steps.append(
            {
                "param_": F.when(onward, (F.col("param") + 1) % len(names)).otherwise(F.col("param")),
                "direction_": F.when(onward, 1).otherwise(-1),
                "back": F.when(F.col("helped") | F.col("old").isNull(), F.col("params")).otherwise(_with_value(F.col("params"), names, F.col("param"), F.col("old"))),
            }
        )
        far = score < F.col("best.score") - DROP
        chosen = F.when(far, hinted(F.col("best.params"))).when(F.col("helped"), F.col("next")).otherwise(hinted(F.col("back")))
        steps.append({"next": chosen, "old_": _value(F.col("back"), names, F.col("param_")), "tried_": F.col("direction_") == 1})
        steps.append({"next": _step(F.col("next"), names, backend, F.col("param_"), F.col("direction_"))})
        steps.append({"next": _replaced(F.col("next"), {"seed": F.when(F.col("next.seed").isNotNull(), F.col("seed") + F.col("i") + 1)})})
    else:
        steps.append({f"{c}_": F.col(c) for c in ("param", "direction", "tried", "old")})
    changed = F.lit(None).cast("string")
    for k, name in enumerate(names):
        changed = F.when((F.col("param") == k) & F.col("old").isNotNull(), name).otherwise(changed)
    told = F.struct(F.col("i"), F.col("params").alias("used"), changed.alias("changed"), F.when(F.col("old").isNotNull(), F.col("direction")).alias("direction"))
    attempt = F.struct(
        F.col("params.prompt"), F.col("params.guidance_scale"), F.col("params.strength"), F.size("params.points").alias("n_points"), score.alias("score"),
        F.col("said.detailed").alias("detailed"), F.col("said.issues").alias("issues"),
    )
    after = {c: F.when(kept, F.col(f"{c}_")).otherwise(F.col(c)) for c in ("param", "direction", "tried", "old")}
    after |= {"previous": F.when(kept, score).otherwise(F.col("previous")), "history": F.when(kept, F.concat("history", F.array(attempt))).otherwise(F.col("history"))}
    return [*steps, {"told": told}, {"params": F.when(kept, F.col("next")).otherwise(F.col("params")), **after}]


@contextmanager
def _small_batches(spark: SparkSession):
    """Rows go to the models' workers BATCH_ROWS at a time, or fewer if the session says so; the session's value comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, BATCH_ROWS if int(old) <= 0 else min(int(old), BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def refine(
    slices: DataFrame, painter: str, judge: str, iterations: int = 5, enough: float = 0.95, backend: str = "flux", name: str = "organelle", system: str = "",
    text_mode: bool = False, points: tuple[int, int] | None = None, calls: dict | None = None,
) -> Refined:
    """The generate-evaluate-refine loop over many slices at once, a round for each iteration.

    slices: run (unique) and whatever the models read; prompt, num_inference_steps, guidance_scale, strength, seed, points are the
    first parameters if there. text_mode takes the prompts of an array `prompts` in turn. points: width and height, if the request
    is to ask for better points. calls: tries, wait and batch of `models.called`.

    A round asks both models for all slices that go on, in batches within each partition, then moves each slice's state on by
    Column expressions, and writes the table that the next round reads; a slice that was accepted is not read again. Slices are dealt
    out evenly at the start, as a small table of many slices may lie in one file; after that no row changes its partition. A single
    iteration is not evaluated: its score is 0 and nothing is accepted. Repeated runs go on side by side; a null run is a run.
    """
    context = slices.sparkSession.sparkContext
    slices = slices.repartition(max(context.defaultParallelism, -(-slices.count() // SLICES)))
    of_state = (F.col("params"), F.col("i"), F.col("history"), F.lit(name))
    request = requests.point_request(*of_state, *map(F.lit, points)) if points else requests.evaluation_request(*of_state, model=backend)
    heard_as, turns = _heard(), {}
    state, rounds, paths = _begun(slices, backend, text_mode), [], []
    for i in range(iterations):
        rows = _judged(state.withColumn("i", F.lit(i)), painter, judge if iterations > 1 else "none", system, request, heard_as, calls or {})
        if iterations == 1:
            rows = rows.withColumns({"told": F.struct(F.lit(0).alias("i"), F.col("params").alias("used"), F.lit(None).cast("string").alias("changed"), F.lit(None).cast("int").alias("direction")), "done": F.lit(False)})
            rows = rows.withColumns({"said": F.col("said").withField("score", F.lit(0.0)), "request": F.lit(None).cast("string")})
        else:
            if i < 2:
                turns = _turn(i == 0, backend, text_mode, enough)
            for step in turns:
                rows = rows.withColumns(step)
            rows = rows.select(*_STATE, "told", "image", "error", "request", "said", "done")
        with _small_batches(slices.sparkSession):
            table, path = scratch.materialize(rows, f"refine-{i}")
        rounds.append(table)
        paths.append(path)
        state = table.filter("NOT coalesce(done, false)").select(*_STATE)
        if state.isEmpty():
            break
    told = [
        t.select(
            "run", F.col("told.i").alias("i"), "slice", *[F.col(f"told.used.{c}").alias(c) for c in ("prompt", "num_inference_steps", "guidance_scale", "strength", "seed")], F.size("told.used.points").alias("n_points"),
            F.col("told.changed").alias("changed"), F.col("told.direction").alias("direction"), "image", "error", "request", F.when(F.col("error").isNull(), F.col("said.score")).alias("score"), F.col("said.issues").alias("issues"), F.coalesce("done", F.lit(False)).alias("accepted"),
        )
        for t in rounds
    ]
    history = told[0]
    for t in told[1:]:
        history = history.unionByName(t)
    return Refined(history, paths)
