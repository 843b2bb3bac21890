"""The minimum of a smooth convex function that is a sum over the rows of a table.

Every pass reads all rows where they lie: a task adds up the value and gradient of its own rows,
and parts of these vectors are summed over tasks. The driver holds the weights alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers in a row that goes to the sum.
PART = 8192
#: Steps that tell the curvature.
REMEMBERED_STEPS = 10


def summed(rows: DataFrame, add: Callable[[Iterator[pa.RecordBatch], np.ndarray], None], width: int) -> np.ndarray:
    """The sum over tasks of vectors of `width` numbers, zero at first, to which `add` adds a task's rows.

    A task sends one vector, so rows are read by no more tasks than keep the cluster busy.
    """

    def send(batches):
        total = np.zeros(width)
        add(batches, total)
        parts = [total[at : at + PART].tobytes() for at in range(0, width, PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "v"])

    def together(key, group):
        total = sum(np.frombuffer(v.as_py()) for v in group.column("v"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    sent = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(send, "part int, v binary")
    found = sorted(sent.groupBy("part").applyInArrow(together, "part int, v binary").collect())  # `width` numbers in all
    return np.frombuffer(b"".join(bytes(r["v"]) for r in found)) if found else np.zeros(width)


def minimum(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, passes: int, tolerance: float) -> np.ndarray:
    """Where `evaluate`, which gives value and gradient, is least: L-BFGS with a halved step where a step does not descend.

    It ends when no part of the gradient is above `tolerance`, or after so many evaluations.
    """
    w = start.astype(float)
    value, gradient = evaluate(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    direction, length = -gradient, 1.0
    for _ in range(passes - 1):
        if np.abs(gradient).max(initial=0.0) <= tolerance or length < 1e-10:
            break
        slope = float(gradient.ravel() @ direction.ravel())
        new = w + length * direction
        new_value, new_gradient = evaluate(new)
        if new_value > value + 1e-4 * length * slope + 1e-14 * abs(value):
            bend = new_value - value - length * slope
            length *= min(0.5, max(0.1, -0.5 * length * slope / bend))
            continue
        moved, turned = new - w, new_gradient - gradient
        if (moved * turned).sum() > 1e-12 * (moved * moved).sum():
            steps = [*steps[1 - REMEMBERED_STEPS :], (moved, turned)]
        w, value, gradient = new, new_value, new_gradient
        direction, length = -_curved(gradient, steps), 1.0
    return w


def _curved(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that the last steps tell."""
    q, shares = gradient.copy(), []
    for moved, turned in reversed(steps):
        share = (moved * q).sum() / (moved * turned).sum()
        q -= share * turned
        shares.append(share)
    if steps:
        moved, turned = steps[-1]
        q *= (moved * turned).sum() / (turned * turned).sum()
    for (moved, turned), share in zip(steps, reversed(shares), strict=True):
        q += moved * (share - (turned * q).sum() / (moved * turned).sum())
    return q
