"""Vector columns (``ARRAY<FLOAT>``): dot products, cosine, normalisation.

Products are taken in DOUBLE.  Query / prototype vectors are few by nature
(a handful of phrases); they are read from their table behind a row-count
check and embedded as literals, so scoring is one projection per article row
with no join and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has norm 0 (``try_divide`` evaluates the norms once
    and gives null for a zero divisor, also in ANSI mode)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalise(a: Column, eps: float = 1e-12) -> Column:
    """L2 normalisation ``v / (||v|| + eps)``; zeros stay zeros."""
    n = norm(a)
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), n + F.lit(eps)), x.cast("double")))


def vector_literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def unit(v: Sequence[float]) -> list[float]:
    s = sum(float(x) * float(x) for x in v) ** 0.5
    return [float(x) / s for x in v] if s > 0 else [0.0 for _ in v]


def mean_vector(vectors: Sequence[Sequence[float]]) -> list[float]:
    n = len(vectors)
    return [sum(float(v[i]) for v in vectors) / n for i in range(len(vectors[0]))]


def collect_bounded(df: DataFrame, max_rows: int, what: str = "rows") -> list:
    """Collect a small table after proving it has at most ``max_rows`` rows."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows; use operators.vectors.nearest_in_table for large tables")
    return rows


def sq_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in DOUBLE."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)),
                       F.lit(0.0), lambda acc, x: acc + x)


def as_matrix(e: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x d matrix of the non-null vectors, mask of the non-null rows) from one Arrow batch.

    The flat Arrow values are reshaped at once.  Vectors of different lengths are an error."""
    ok = e.is_valid().to_numpy(zero_copy_only=False)
    rows = e.filter(e.is_valid())
    if not len(rows):
        return np.empty((0, 0)), ok
    if len(set(pc.list_value_length(rows).unique().to_pylist())) > 1:
        raise ValueError("vectors of different lengths in one column")
    return rows.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(rows), -1), ok


def as_lists(m: np.ndarray, ok: np.ndarray) -> pa.Array:
    """The rows of ``m`` as a list column; null where ``ok`` is false."""
    width = m.shape[1] if len(m) else 0
    offsets = np.concatenate([[0], np.cumsum(np.where(ok, width, 0))]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m, dtype="float64").reshape(-1)),
                                    mask=pa.array(~ok))


def _unit_rows(m):
    m = np.asarray(m, dtype="float64")
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1.0, n)


def cosine_matrix(emb: Column, vectors: Sequence[Sequence[float]], as_is: bool = False) -> Column:
    """``ARRAY<DOUBLE>``: cosine of each row vector with every fixed vector, in the fixed order.

    One NumPy matrix product per Arrow batch: the fixed vectors (size-checked by the caller)
    travel with the function.  A null vector or one of norm 0 gives null.  ``as_is``: the fixed vectors are
    means of unit vectors, and their length counts.
    """
    P = (np.asarray(vectors, dtype="float64") if as_is else _unit_rows(vectors)).T  # d x k

    @F.arrow_udf(ArrayType(DoubleType()))
    def _cos(e: pa.Array) -> pa.Array:
        X, ok = as_matrix(e)
        if len(X):
            n = np.linalg.norm(X, axis=1)
            ok[np.flatnonzero(ok)[n == 0]] = False
            X = (X[n > 0] @ P) / n[n > 0][:, None]
        return as_lists(X, ok)

    return _cos(emb)


def sq_distance_matrix(emb: Column, vectors: Sequence[Sequence[float]]) -> Column:
    """``ARRAY<DOUBLE>``: squared Euclidean distance of each row vector to every fixed vector
    (one Arrow batch at a time, differences taken directly for exact ties)."""
    C = np.asarray(vectors, dtype="float64")

    @F.arrow_udf(ArrayType(DoubleType()))
    def _dist(e: pa.Array) -> pa.Array:
        X, ok = as_matrix(e)
        return as_lists(np.stack([((X - c) ** 2).sum(axis=1) for c in C], axis=1) if len(X) else X, ok)

    return _dist(emb)


def dot_matrix(emb: Column, vectors: Sequence[Sequence[float]]) -> Column:
    """``ARRAY<DOUBLE>``: plain dot product of each row vector with every fixed vector
    (one matrix product per Arrow batch; null vectors give null)."""
    M = np.asarray(vectors, dtype="float64").T  # d x k

    @F.arrow_udf(ArrayType(DoubleType()))
    def _dot(e: pa.Array) -> pa.Array:
        X, ok = as_matrix(e)
        return as_lists(X @ M if len(X) else X, ok)

    return _dot(emb)


def array_mean(a: Column, start: int = 1, length: int | None = None) -> Column:
    """Mean of (a slice of) a small numeric array."""
    part = F.slice(a, start, length) if length is not None else a
    return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x, lambda s: s / F.size(part))


def array_argmax(a: Column) -> Column:
    """0-based position of the largest element (ties: the first)."""
    return F.array_max(F.transform(a, lambda x, i: F.struct(x.alias("x"), (-i).alias("p"))))["p"] * -1


def array_argmin(a: Column) -> Column:
    """0-based position of the smallest element (ties: the first)."""
    return F.array_min(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("p"))))["p"]
