"""Integer vectors: every component x of a float vector becomes floor(256 * x).

Rows travel as packed blocks: a matrix of the smallest integer type that
holds its values, with the row numbers and ids beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256.0
#: Components beyond this raise: products of two would leave a long.
LARGEST = 1 << 31


def int_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` (long) and ``x`` (array of long) of every row of ``df`` whose
    vector is neither null nor holds a null or non-finite component.  Other
    columns are left out, so their names can't clash.  A component whose
    integer is not below 2**31 in size raises an error."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    sound = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform("vec", lambda c: F.when(
        F.abs(F.lit(SCALE) * c.cast("double")) < LARGEST, F.floor(F.lit(SCALE) * c.cast("double"))).otherwise(
        F.raise_error(F.lit(f"a component times {SCALE:g} is not below 2**31"))))
    return rows.filter(sound).select("id", whole.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls as an int64 matrix; shorter rows end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = int(size.max()) if len(size) else 0
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width).astype(np.int64)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def pack(x: np.ndarray) -> tuple[str, bytes]:
    """Type name and bytes of an integer matrix."""
    top = int(np.abs(x).max()) if x.size else 0
    kind = next(k for k in ("int8", "int16", "int32", "int64") if top < np.iinfo(k).max)
    return kind, np.ascontiguousarray(x, dtype=kind).tobytes()


def unpack(kind: str, raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=kind).reshape(rows, -1) if rows else np.zeros((0, 0), dtype=kind)
