"""Arrays of numbers as bytes, little-endian, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"int32": "array<int>", "int64": "array<bigint>", "float32": "array<float>", "float64": "array<double>"}


def pack(values: Column, dtype: str) -> Column:
    """Null for null; an array must hold no nulls."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.array(x, f"<{np.dtype(dtype).str[1:]}").tobytes() for x in column.to_pylist()], pa.binary())

    return run(values)


def unpack(data: Column, dtype: str) -> Column:
    @F.arrow_udf(KINDS[dtype])
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else np.frombuffer(x, f"<{np.dtype(dtype).str[1:]}").tolist() for x in column.to_pylist()], pa.list_(pa.from_numpy_dtype(dtype)))

    return run(data)
