"""Sums of count arrays whose size is fixed, made in every task and added up in steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Key = tuple[pa.Scalar, ...]
SCHEMA = "slice int, counts binary"
SLICES = 16


def packed(counts: np.ndarray) -> pa.RecordBatch:
    """A task's counts as rows of SCHEMA; the length must be a multiple of SLICES."""
    each = [zstandard.compress(x.astype("<i8").tobytes(), 1) for x in counts.reshape(SLICES, -1)]
    return pa.record_batch([pa.array(range(SLICES), pa.int32()), pa.array(each, pa.binary())], names=["slice", "counts"])


def _unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(payload), "<i8")


def _add(key: Key, table: pa.Table) -> pa.Table:
    total = None
    for payload in table["counts"]:
        counts = _unpacked(payload.as_py())
        total = counts.copy() if total is None else total + counts
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())], names=["slice", "counts"])


def summed(spread: DataFrame, size: int) -> np.ndarray:
    """The sum over all tasks, on the driver: `size` numbers, whatever the input."""
    # Two steps, so that no task meets the arrays of every task.
    mixed = spread.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(32)).cast("int"))
    partly = mixed.groupBy("slice", "part").applyInArrow(_add, SCHEMA)
    counts = np.zeros((SLICES, size // SLICES), np.int64)
    for row in partly.groupBy("slice").applyInArrow(_add, SCHEMA).collect():
        counts[row["slice"]] = _unpacked(row["counts"])
    return counts.reshape(-1)
