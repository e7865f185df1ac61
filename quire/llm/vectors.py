"""Reading embedding columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the rows that hold a vector of it, and their components as doubles.

    A vector that is null or empty, or holds a null or non-finite component, holds no row.
    """
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(n[n > 0]).tolist():
        at = np.flatnonzero(n == dim)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        x = np.asarray(flat.to_numpy(zero_copy_only=False), float).reshape(-1, dim)  # nulls become NaN
        good = np.isfinite(x).all(axis=1)
        if good.any():
            yield at[good], x[good]
