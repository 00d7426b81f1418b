"""Refinement histories as streams: each run's state is kept until a score is good enough."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "run long, iterations long, converged boolean, best double, best_i long"
STATE = "seen long, converged boolean, best double, best_i long"


def early_stop(scores: DataFrame, enough: float) -> DataFrame:
    """The state of each run (run, ts, event_id, score) after every batch: iterations are taken in the order of their times.

    A run that has converged takes no more scores. Late scores of a batch that is over are counted as the next iterations.
    """
    import pandas as pd

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, converged, best, best_i = state.get if state.exists else (0, False, float("-inf"), 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for score in rows["score"]:
            if converged:
                break
            seen += 1
            if score > best:
                best, best_i = score, seen
            converged = score >= enough
        state.update((int(seen), bool(converged), float(best), int(best_i)))
        yield pd.DataFrame({"run": [key[0]], "iterations": [seen], "converged": [converged], "best": [best], "best_i": [best_i]})

    return scores.groupBy("run").applyInPandasWithState(advance, RESULT, STATE, "update", "NoTimeout")


def hourly_scores(scores: DataFrame, late: str = "1 hour") -> DataFrame:
    """hour, n, best of closed hours; scores later than the watermark are left out."""
    return scores.withWatermark("ts", late).groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")).select(F.col("window.start").alias("hour"), "n", "best")
