"""What both vector operators share: Arrow lists as matrices, and which vectors count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, no null or non-finite component, and not all zero."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return c.isNotNull() & (F.size(c) > 0) & ~bad & F.exists(c, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal width as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
