"""Follow-the-regularised-leader (proximal) updates on hashed features, trained by rounds of parameter mixing.

Each round sends the state to a number of partitions of the training sample; each runs over its rows one by one. What they
changed is added up by blocks of coordinates in tasks, so the driver gets one sum for each touched coordinate, however many the
partitions are. State and sample have fixed bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

PARTITIONS = 6
#: A partition makes at least so many updates a round: small samples are gone over more often.
LEAST = 1500
#: Blocks of coordinates whose changes are added up apart.
BLOCKS = 8


class Ftrl:
    """Per-coordinate state: z (shifted gradient sum) and n (squared gradient sum)."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float, z=None, n=None):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(size) if z is None else z.astype(np.float64)
        self.n = np.zeros(size) if n is None else n.astype(np.float64)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, w: np.ndarray, g: np.ndarray) -> None:
        """One step on distinct coordinates `at`, whose weights are w and whose gradient is g."""
        n = self.n[at]
        more = n + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = more


def train(
    sample: DataFrame,
    step: Callable[[Ftrl, dict], None],
    size: int,
    rounds: int,
    start: dict[int, float] | None = None,
    passes: int = 1,
    **settings: float,
) -> np.ndarray:
    """Weights after `rounds` rounds of `passes` passes or more each.

    `step` makes the updates for one row of the sample (a dict of its columns). start: the first z of some coordinates. Only the
    coordinates that some partition has touched come back, `size` at most; which of them get a weight is up to l1.
    """
    spark = sample.sparkSession
    z, n = np.zeros(size, np.float32), np.zeros(size, np.float32)
    fixed = list(start or {size - 1: 0.0})
    z[fixed] = list((start or {size - 1: 0.0}).values())

    for _ in range(rounds):
        at = np.flatnonzero((n > 0) | (z != 0)).astype(np.int32)
        state = spark.sparkContext.broadcast((at, z[at], n[at]))

        def local(batches: Iterator, state=state) -> Iterator:
            import pyarrow as pa
            from pyspark import TaskContext

            rows = [row for batch in batches for row in batch.to_pylist()]
            if not rows:
                return
            at, z0, n0 = state.value
            model = Ftrl(size, **settings)
            model.z[at], model.n[at] = z0, n0
            old = Ftrl(size, z=model.z, n=model.n, **settings)
            for row in rows * max(passes, -(-LEAST // len(rows))):
                step(model, row)
            own = np.flatnonzero(model.n != old.n).astype(np.int32)
            dz, dn = (len(rows) * (model.z - old.z)[own]).astype(np.float32), (len(rows) * (model.n - old.n)[own]).astype(np.float32)
            cut = np.searchsorted(own, np.arange(1, BLOCKS) * size // BLOCKS)
            parts = [[p.tobytes() for p in np.split(x, cut)] for x in (own, dz, dn)]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array([*range(BLOCKS)], pa.int32()), pa.array([part] * BLOCKS, pa.int32()), pa.array([len(rows)] * BLOCKS, pa.int64()), *[pa.array(p, pa.binary()) for p in parts]],
                ["block", "part", "rows", "at", "z", "n"],
            )

        total = 0
        back = sample.mapInArrow(local, "block int, part int, rows long, at binary, z binary, n binary").groupBy("block").applyInArrow(_summed, "rows long, at binary, z binary, n binary")
        for r in back.collect():
            own, total = np.frombuffer(r["at"], np.int32), r["rows"]
            z[own] += np.frombuffer(r["z"], np.float32) / total
            n[own] += np.frombuffer(r["n"], np.float32) / total
        state.destroy()
    weights = np.zeros(size)
    at = np.flatnonzero((n > 0) | (z != 0))
    weights[at] = Ftrl(size, z=z, n=n, **settings).weights(at)
    return weights


def _summed(table):
    """One row for a block of coordinates: the sums over all partitions, added in the partitions' order."""
    import pyarrow as pa

    table = table.sort_by("part")
    at = np.frombuffer(b"".join(table.column("at").to_pylist()), np.int32)
    known, of = np.unique(at, return_inverse=True)
    sums = [np.bincount(of, np.frombuffer(b"".join(table.column(c).to_pylist()), np.float32), len(known)).astype(np.float32) for c in ("z", "n")]
    rows = int(np.sum(table.column("rows").to_numpy()))
    return pa.table({"rows": pa.array([rows], pa.int64()), "at": pa.array([known.tobytes()], pa.binary()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip("zn", sums, strict=True)}})


def spread(rows: DataFrame) -> DataFrame:
    """The sample over the fixed number of partitions, each in an order that doesn't depend on the cluster."""
    from pyspark.sql import functions as F

    return rows.repartition(PARTITIONS, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)), "doc_id")
