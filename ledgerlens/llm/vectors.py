"""Whole-number vectors: reading them from Arrow and exact products of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Greatest magnitude of a scaled component; beyond, the query ends with an error.
LARGEST = float(1 << 62)


def whole_numbers(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of every component, x as double, as longs; null if the
    vector is null or holds a null or non-finite component. A component too
    large for a long is an error, never a wrong number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) != F.lit(float("inf"))))

    def whole(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return (F.when(F.abs(y) < LARGEST, F.floor(y).cast("long"))
                .otherwise(F.raise_error(F.lit("a scaled component does not fit a long"))
                           .cast("long")))

    return F.when(finite, F.transform(vector, whole))


def exact(*tables: np.ndarray) -> list[np.ndarray]:
    """The tables of longs in the fastest type in which their inner products and
    squared distances are exact: doubles, longs or Python's integers."""
    top = max([int(np.abs(t).max(initial=0)) for t in tables] + [1])
    terms = 4 * max([t.shape[-1] for t in tables] + [1])
    kind = (np.float64 if terms * top * top < 1 << 53
            else np.int64 if terms * top * top < 1 << 62 else object)
    return [t.astype(kind) for t in tables]


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) of the vectors of each length in a batch."""
    lists = batch.column(column)
    values = lists.values.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()
    sizes = np.diff(starts)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, values[starts[:-1][rows][:, None] + np.arange(size)]
