"""Reading of vector columns for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def by_width(column: pd.Series) -> dict[int, np.ndarray]:
    """Row numbers of a column of vectors by their number of components."""
    sizes = np.fromiter(map(len, column), np.int64, len(column))
    return {int(n): np.flatnonzero(sizes == n) for n in np.unique(sizes)}


def matrix(column: pd.Series, rows: np.ndarray) -> np.ndarray:
    return np.vstack([column.iloc[k] for k in rows]).astype(np.float64)
