"""Sums of vectors over all rows in one job, and the optimiser that uses them on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks whose sums come to the driver directly; more are added up in as many groups first.
DIRECT = 64


def summed(df: DataFrame, per_batch: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of ``per_batch``, a vector of ``size`` doubles.

    Each task adds up its batches and sends one vector.  Vectors are added in the order of their tasks,
    so that a job run again on the same files gives the same sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += per_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(size), None
        for b in batches:
            for task, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first = task if first is None else first
                total += np.frombuffer(v)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "v"])

    parts = df.mapInArrow(run, "task int, v binary")
    if df.rdd.getNumPartitions() > DIRECT:
        parts = parts.repartition(DIRECT, F.col("task") % DIRECT).sortWithinPartitions("task").mapInArrow(add, "task int, v binary")
    total = np.zeros(size)
    for _, v in sorted((r.task, r.v) for r in parts.collect()):
        total += np.frombuffer(v)
    return total


class Adam:
    """Adam with decoupled weight decay; ``rate`` may be an array, one for each parameter."""

    def __init__(self, size: int, decay: float = 0.0):
        self.m, self.v, self.t, self.decay = np.zeros(size), np.zeros(size), 0, decay

    def step(self, x: np.ndarray, gradient: np.ndarray, rate: float | np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return x - rate * ((self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8) + self.decay * x)
