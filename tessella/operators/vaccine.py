"""Gradients of several tasks, turned towards one another where they agree less than they used to.

What two tasks used to agree is a moving average over steps, updated only where it is not reached: a recurrence along a run. Runs
are worked through apart, each as a stream of its steps in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.runtime import ship_code


def order_of(step: int, task: int, others: list[int], seed: int) -> list[int]:
    """The other tasks in the order in which a task meets them at a step: by MD5 of seed, step and both tasks."""
    return sorted(others, key=lambda j: (hashlib.md5(f"{seed}:{step}:{task}:{j}".encode()).hexdigest(), j))


class Agreement:
    """What the tasks of one run used to agree, pair by pair and by direction; 0 before the first step."""

    def __init__(self, beta: float, seed: int):
        self.beta, self.seed = beta, seed
        self.target: dict[tuple[int, int], float] = {}

    def merged(self, step: int, grads: dict[int, np.ndarray], mean: bool) -> tuple[np.ndarray, int]:
        """One gradient of all tasks' turned ones, and how many turns it took. Components that all tasks have (other than 0) are
        averaged if ``mean``, those that some lack are summed. A zero gradient neither turns nor is turned to."""
        turned, turns = [], 0
        for i, g in grads.items():
            own = g.copy()
            for j in order_of(step, i, [k for k in grads if k != i], self.seed):
                a, b = float(np.linalg.norm(own)), float(np.linalg.norm(grads[j]))
                if not a or not b:
                    continue
                cos, target = min(1.0, max(-1.0, float(own @ grads[j]) / (a * b))), self.target.get((i, j), 0.0)
                if cos < target:
                    root = (1 - target**2) ** 0.5
                    own = own + grads[j] * (a * (target * (1 - cos**2) ** 0.5 - cos * root) / (b * root))
                    self.target[i, j] = (1 - self.beta) * target + self.beta * cos
                    turns += 1
            turned.append(own)
        stacked = np.stack(turned)
        shared = np.all(np.stack(list(grads.values())) != 0, axis=0)
        return np.where(shared & mean, stacked.mean(0), stacked.sum(0)), turns


def merged_gradients(rows: DataFrame, beta: float = 0.01, mean: bool = True, seed: int = 0) -> DataFrame:
    """run, step, grad and turns from ``rows`` of run, step, task (all long) and grad, one gradient size for each run.

    Steps go by number; a step holds the tasks that it has. Rows with a null, and repeats of a task in a step but the smallest gradient, go.
    """
    ship_code(rows.sparkSession)
    once = rows.dropna(subset=["run", "step", "task", "grad"]).groupBy("run", "step", "task").agg({"grad": "min"}).toDF("run", "step", "task", "grad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, grads = None, None, {}

        def done() -> pa.RecordBatch:
            grad, turns = state.merged(at[1], grads, mean)
            return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([grad.tolist()], pa.list_(pa.float64())), pa.array([turns])], ["run", "step", "grad", "turns"])

        for batch in batches:
            for r, s, task, grad in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if at != (r, s):
                    if at:
                        yield done()
                    if at is None or at[0] != r:
                        state = Agreement(beta, seed)
                    at, grads = (r, s), {}
                grads[task] = np.array(grad, float)
        if at:
            yield done()

    dealt = once.repartition("run").sortWithinPartitions("run", "step", "task")
    return dealt.mapInArrow(run, "run long, step long, grad array<double>, turns long")
