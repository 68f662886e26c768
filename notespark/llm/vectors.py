"""What several operators on vectors share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType


def finite(column: str) -> Column:
    """Whether ``column`` holds a vector of at least one entry, all of them finite numbers; never null."""
    c = F.col(column)
    plain = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & plain, F.lit(False))


def kind(vectors: DataFrame, column: str) -> str:
    """The numpy type that holds the entries of ``column`` unchanged."""
    return "f8" if vectors.schema[column].dataType == ArrayType(DoubleType()) else "f4"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision. No row may be zero."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
