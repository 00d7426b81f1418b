"""Registries of the models that a user plugs in: functions over pandas batches, loaded once for each worker.

No model is shipped. The deterministic stand-ins serve tests and show the interface.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_GENERATORS: dict[str, Callable] = {}
_CHAT: dict[str, Callable] = {}
_PAINTERS: dict[str, Callable] = {}
_JUDGES: dict[str, Callable] = {}
_TRACKERS: dict[str, Callable] = {}

#: Calls of a busy model for a row, and the seconds before the second one; the n-th wait is n times as long.
TRIES, WAIT = 3, 30.0


class Busy(Exception):
    """A model that refuses for now. Raised for a whole call, or returned in place of a row's result; the row is asked again."""


def generator(name: str):
    """Register a factory: called once in a worker, it returns f(pandas frame of tiles) -> list of masks (bytes of 0 and 1)."""
    return lambda f: _GENERATORS.setdefault(name, f)


def chat(name: str):
    """Register a factory: called once in a worker, it returns f(list of prompts) -> list of replies."""
    return lambda f: _CHAT.setdefault(name, f)


def painter(name: str):
    """Register a factory: called once in a worker, it returns f(pandas frame of slices and parameters) -> list of images (bytes).

    An exception in place of an image says that the row has none.
    """
    return lambda f: _PAINTERS.setdefault(name, f)


def judge(name: str):
    """Register a factory: called once in a worker, it returns f(pandas frame of slices, images, system and request) -> list of replies."""
    return lambda f: _JUDGES.setdefault(name, f)


def tracker(name: str):
    """Register a factory: called once in a worker, it returns f(mask of the frame before (bytes), tile of this one (array)) -> mask or None."""
    return lambda f: _TRACKERS.setdefault(name, f)


def create_tracker(name: str) -> Callable:
    if name not in _TRACKERS:
        raise ValueError(f"no tracker {name}; there are {sorted(_TRACKERS)}")
    return _TRACKERS[name]


def create_painter(name: str) -> Callable:
    if name not in _PAINTERS:
        raise ValueError(f"no painter {name}; there are {sorted(_PAINTERS)}")
    return _PAINTERS[name]


def create_judge(name: str) -> Callable:
    if name not in _JUDGES:
        raise ValueError(f"no judge {name}; there are {sorted(_JUDGES)}")
    return _JUDGES[name]


def create_generator(name: str) -> Callable:
    if name not in _GENERATORS:
        raise ValueError(f"no generator {name}; there are {sorted(_GENERATORS)}")
    return _GENERATORS[name]


def create_chat(name: str) -> Callable:
    if name not in _CHAT:
        raise ValueError(f"no chat model {name}; there are {sorted(_CHAT)}")
    return _CHAT[name]


@generator("threshold")
def threshold_generator():
    """Foreground where a tile's value is over 0.1."""
    import numpy as np

    return lambda tiles: [(np.frombuffer(t, "<f8") > 0.1).astype(np.uint8).tobytes() for t in tiles["data"]]


@painter("cut")
def cut_painter():
    """The foreground over a cut that the parameters move: a mask of 0 and 1 for a row's `tile` (array).

    It stands for a generator whose parameters matter. The row's `offset` is the error that they have to make up for; a slice
    whose `fails` is the iteration has no image.
    """
    import numpy as np

    def paint(f):
        strength = f["strength"].fillna(0.75)
        cuts = 0.1 + f["offset"] + (f["guidance_scale"] - 3.5) / 50 + (strength - 0.75) / 10 + (f["num_inference_steps"] - 28) / 1000
        masks = [(np.asarray(t, float) > c).astype(np.uint8).tobytes() for t, c in zip(f["tile"], cuts, strict=True)]
        return [ValueError("no image") if fails == i else m for m, fails, i in zip(masks, f["fails"], f["iteration"], strict=True)]

    return paint


@judge("dice")
def dice_judge():
    """A reply in JSON with the overlap of an image and the foreground over 0.1, and a next prompt while that is under 0.9."""
    import json

    import numpy as np

    def reply(tile, image, i):
        true, said = np.asarray(tile, float) > 0.1, np.frombuffer(image, np.uint8) > 0
        hit, extra, missed = int((true & said).sum()), int((~true & said).sum()), int((true & ~said).sum())
        dice = 2.0 * hit / (2 * hit + extra + missed) if hit + extra + missed else 1.0
        detail = {"tp_rate": hit / 64, "fp_rate": extra / 64, "fn_rate": missed / 64, "boundary_quality": 0.5, "dice_score": dice}
        issues = ["too much"] * (extra > missed) + ["too little"] * (missed > extra)
        return json.dumps({"score": 0.25, "detailed_scores": detail, "issues": issues, "refined_prompt": f"again, {i + 1}" if dice < 0.9 else None})

    return lambda f: ["Sure: " + reply(t, m, i) for t, m, i in zip(f["tile"], f["image"], f["iteration"], strict=True)]


@painter("often_busy")
def often_busy_painter():
    """The tile's sum as an image, from a model that refuses each row `busy` times."""
    import numpy as np

    refused: dict = {}

    def paint(f):
        out = []
        for run, busy, tile in zip(f["run"], f["busy"], f["tile"], strict=True):
            refused[run] = refused.get(run, -1) + 1
            out.append(Busy("busy") if refused[run] < busy else np.asarray(tile, float).astype("<f8").tobytes())
        return out

    return paint


@tracker("fading")
def fading_tracker():
    """What was foreground stays so where the next tile isn't under -0.1."""
    import numpy as np

    def track(mask, tile):
        left = (np.frombuffer(mask, np.uint8) > 0) & (np.asarray(tile, float) > -0.1)
        return left.astype(np.uint8).tobytes() if left.any() else None

    return track


@judge("none")
def no_judge():
    """Says nothing that could be read: for runs of a single iteration, which aren't judged."""
    return lambda f: ["{}"] * len(f)


@chat("marks")
def marks_chat():
    """Points to where the prompt says that a mark is, `mark x y` in thousandths; says so if there is none."""
    import re

    def reply(prompt):
        found = re.findall(r"mark (\d+) (\d+)", prompt)
        return "".join(f'<points coords="{i + 1} {x} {y}"/>' for i, (x, y) in enumerate(found)) or "There are none."

    return lambda prompts: [reply(p) for p in prompts]


@chat("echo")
def echo_chat():
    """Points to the middle of whatever is asked about."""
    return lambda prompts: ['<points coords="1 500 500"/>' for _ in prompts]


# Classes of generator backends, and the names that their parameters go by.
BACKENDS = {"SAM3Backend": "sam3", "FluxBackend": "flux", "GLMImageBackend": "glm", "QwenImageEditBackend": "qwen", "GeminiImageBackend": "gemini"}


def backend_name(class_name: Column) -> Column:
    """The name of a backend from that of its class; flux if it isn't known."""
    name = F.lit("flux")
    for known, short in BACKENDS.items():
        name = F.when(class_name == known, short).otherwise(name)
    return name


def ask(rows: DataFrame, name: str, prompt: str = "prompt") -> DataFrame:
    """rows with `reply` of a chat model to their prompts; a worker loads the model once for its partition."""
    import pandas as pd

    factory = create_chat(name)
    schema = StructType([*rows.schema.fields, StructField("reply", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for frame in frames:
            yield frame.assign(reply=model(frame[prompt].tolist()))

    return rows.mapInPandas(run, schema)


def segment(slices: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """keys, row, col of the foreground that a generator finds in slices (keys, row, col, v).

    One slice is put together in one task, as a model needs it whole; slices run in parallel.
    """
    factory = create_generator(name)
    of_keys = ", ".join(f"{k} {slices.schema[k].dataType.simpleString()}" for k in keys)

    def run(table):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        row, col = table.column("row").to_numpy(), table.column("col").to_numpy()
        grid = np.zeros((row.max() + 1, col.max() + 1))
        grid[row, col] = table.column("v").to_numpy()
        mask = np.frombuffer(factory()(pd.DataFrame({"data": [grid.tobytes()], "height": [grid.shape[0]], "width": [grid.shape[1]]}))[0], np.uint8).reshape(grid.shape)
        r, c = np.nonzero(mask)
        return pa.table({**{k: pa.array([table.column(k)[0].as_py()] * len(r), table.schema.field(k).type) for k in keys}, "row": r, "col": c})

    return slices.groupBy(*keys).applyInArrow(run, f"{of_keys}, row long, col long")


def attempted(model: Callable, frame, tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] | None = None) -> tuple[list, list, list]:
    """Results, errors and attempts of a model for the rows of a pandas frame.

    Only rows that met a busy model are asked again, after a wait; those still refused at the end, and rows with another error,
    have no result and the error's text.
    """
    import time

    n = len(frame)
    results, errors, attempts, left = [None] * n, [None] * n, [0] * n, list(range(n))
    for attempt in range(1, tries + 1):
        if not left:
            break
        if attempt > 1:
            (sleep or time.sleep)(wait * (attempt - 1))
        try:
            got = model(frame.iloc[left])
        except Busy as e:
            got = [e] * len(left)
        if len(got) != len(left):
            raise ValueError(f"{len(got)} results for {len(left)} rows")
        again = []
        for i, value in zip(left, got, strict=True):
            attempts[i] = attempt
            failed = isinstance(value, Exception)
            results[i], errors[i] = (None, str(value)) if failed else (value, None)
            if isinstance(value, Busy):
                again.append(i)
        left = again
    return results, errors, attempts


def called(rows: DataFrame, factory: Callable, inputs: list[str], column: str, kind: str, tries: int = TRIES, wait: float = WAIT, batch: int = 64) -> DataFrame:
    """rows with `column` (of SQL type kind), column_error and column_attempts: what a model returns for the columns `inputs`.

    A worker makes the model once for its partition and asks it in batches. Exhausted rows keep their place, without a result.
    """
    from pyspark.sql.types import IntegerType, _parse_datatype_string

    added = [StructField(column, _parse_datatype_string(kind)), StructField(f"{column}_error", StringType()), StructField(f"{column}_attempts", IntegerType())]
    schema = StructType([*rows.schema.fields, *added])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        model, kinds = factory(), [to_arrow_type(f.dataType) for f in added]
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                some = whole.slice(at, batch)
                found = attempted(model, some.select(inputs).to_pandas(), tries, wait)
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(v, k) for v, k in zip(found, kinds, strict=True)]], schema.names)

    return rows.mapInArrow(run, schema)
