"""What the vector operators share: which vectors count, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True if the vector is there, not empty, and all its components are numbers."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & real, F.lit(False))


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    if len(lists) == 0:
        return np.zeros((0, 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)
