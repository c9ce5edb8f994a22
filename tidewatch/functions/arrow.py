"""Moving window tensors between Arrow batches and NumPy without touching single rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VECTOR_TYPE = T.ArrayType(T.DoubleType())
MATRIX_TYPE = T.ArrayType(VECTOR_TYPE)


class BadRow(ValueError):
    """A row that is not a full list of numbers; ``row`` is its place in the column."""

    def __init__(self, row: int, reason: str):
        super().__init__(f"row {row} {reason}")
        self.row, self.reason = row, reason


def _of_length(column: pa.Array, length: int, what: str, per_row: int = 1) -> pa.Array:
    """The values of a list column, all of whose lists must have ``length`` of them."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    wrong = np.flatnonzero(sizes != length)
    if len(wrong):
        raise BadRow(int(wrong[0]) // per_row, f"does not have {length} {what}")
    return column.flatten()


def _numbers(flat: pa.Array, per_row: int) -> np.ndarray:
    """Values without null or NaN."""
    values = flat.to_numpy(zero_copy_only=False)
    if flat.null_count or np.isnan(values.sum()):
        wrong = np.flatnonzero(np.isnan(values))
        if len(wrong):
            raise BadRow(int(wrong[0]) // per_row, "has a null or NaN feature")
    return values


def tensor(column: pa.ChunkedArray | pa.Array, length: int, width: int) -> np.ndarray:
    """``list<list<double>>`` column -> array of shape (rows, length, width); ``BadRow`` if a row is not of that shape."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = _of_length(column, length, "steps")
    return _numbers(_of_length(rows, width, "features", length), length * width).reshape(-1, length, width)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """``list<double>`` column -> array of shape (rows, width); ``BadRow`` if a row is not of that shape."""
    return _numbers(_of_length(column, width, "features"), width).reshape(-1, width)


def list_column(values: np.ndarray) -> pa.Array:
    """(rows, width) -> ``list<double>`` column."""
    rows, width = values.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def nested_column(values: np.ndarray) -> pa.Array:
    """(rows, length, width) -> ``list<list<double>>`` column."""
    rows, length, width = values.shape
    offsets = np.arange(0, (rows + 1) * length, length, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), list_column(values.reshape(rows * length, width)))


def map_windows(
    windows: DataFrame, column: str, new: dict[str, T.DataType], compute: Callable[[pa.Array], dict[str, pa.Array]]
) -> DataFrame:
    """Replace or append the columns ``compute`` makes from one column, batch by batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                try:
                    made = compute(batch.column(batch.schema.names.index(column)))
                except BadRow as bad:
                    where = f"window {batch.column('w')[bad.row].as_py()}" if "w" in batch.schema.names else f"row {bad.row}"
                    raise ValueError(f"{where} {bad.reason}") from bad
                yield with_columns(batch, made)

    kept = [f for f in windows.schema if f.name not in new or f.name == column]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in new.items() if n != column])
    return windows.select(*[f.name for f in kept]).mapInArrow(run, schema)


def minmax_tensor(x: np.ndarray) -> np.ndarray:
    """Every window scaled by its own bounds per feature; a constant feature maps to 0."""
    low = x.min(axis=1, keepdims=True)
    span = x.max(axis=1, keepdims=True) - low
    return np.divide(x - low, span, out=np.zeros_like(x), where=span != 0)


def quadratic_scores(errs: np.ndarray, mu: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """sqrt((e-mu)' W (e-mu)) per step of every window."""
    c = errs - mu
    return np.sqrt(np.maximum(((c @ weight) * c).sum(axis=2), 0))


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """Replace or append columns, keeping the order of the existing ones."""
    columns = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
    columns.update(new)
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
