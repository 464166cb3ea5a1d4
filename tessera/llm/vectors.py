"""Vectors as rows of doubles, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vector: Column) -> Column:
    """Not null, and no component is null or not finite. An empty vector is valid."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def matrix(vectors: list, width: int | None = None) -> np.ndarray:
    """Rows padded with zeros to one width."""
    width = max([len(v) for v in vectors], default=0) if width is None else width
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:width]
    return out


def fitted(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1]))) if a.shape[1] < width else a[:, :width]


def sampled(rows: DataFrame, size: int, vector: str = "v") -> np.ndarray:
    """At most size vectors, those with the smallest hashes, as a matrix."""
    some = rows.select(vector).orderBy(F.xxhash64(vector), vector).limit(size).collect()
    return matrix([r[0] for r in some])
