"""Vector arithmetic on ``array<float>`` columns as higher-order Column expressions (no Python UDF)."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fold_sum(values: Column) -> Column:
    """Sequential left fold in double precision (same order as a plain loop)."""
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    """Dot product; vectors of unequal lengths raise."""
    total = _fold_sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))
    return F.when(F.size(_c(a)) != F.size(_c(b)), F.raise_error(F.lit("vectors of unequal lengths")).cast("double")).otherwise(total)


def sq_norm(a) -> Column:
    return _fold_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """Cosine similarity; zero norm gives 0.0; null when either side is missing."""
    a, b = _c(a), _c(b)
    norm = F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(norm == 0.0, F.lit(0.0)).otherwise(
        dot(a, b) / norm
    )


# Arrow-batched twins of the expressions above. Spark evaluates higher-order functions element by element
# (interpreted, outside whole-stage codegen); for dense vector arithmetic an Arrow batch through NumPy is much
# faster. Sums run over the vector dimension in index order, so results are bit-identical to the folds above.

def _stack(s):
    return np.stack([np.asarray(x, dtype=np.float64) for x in s]) if len(s) else np.zeros((0, 0))


def seq_dot(a, b):
    """Row-wise dot products of two (n, d) float64 matrices, summed in index order."""
    acc = np.zeros(a.shape[0], dtype=np.float64)
    for j in range(a.shape[1]):
        acc += a[:, j] * b[:, j]
    return acc


def cosine_fast(a, b) -> Column:
    """Same result as ``cosine``; one Arrow batch at a time through NumPy."""
    @F.pandas_udf("double")
    def cos(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        ok = np.array([(u is not None) and (v is not None) for u, v in zip(x, y)], dtype=bool)
        if ok.any():
            A, B = _stack(x[ok]), _stack(y[ok])
            if A.shape != B.shape:
                raise ValueError("vectors of unequal lengths")
            norm = np.sqrt(seq_dot(A, A)) * np.sqrt(seq_dot(B, B))
            d = seq_dot(A, B)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[ok] = np.where(norm == 0.0, 0.0, d / np.where(norm == 0.0, 1.0, norm))
        return pd.Series(np.where(ok, out, None), dtype="object").astype("float64")

    return cos(_c(a), _c(b))


def sq_l2_fast(a, q: list[float]) -> Column:
    """Squared L2 distance of every vector to one constant query vector (index-order sums)."""
    qv = np.asarray(q, dtype=np.float32).astype(np.float64)

    @F.pandas_udf("double")
    def dist(x: pd.Series) -> pd.Series:
        ok = np.array([u is not None and len(u) == len(qv) for u in x], dtype=bool)
        out = np.full(len(x), np.nan)
        if ok.any():
            A = _stack(x[ok])
            acc = np.zeros(A.shape[0])
            for j in range(A.shape[1]):
                d = A[:, j] - qv[j]
                acc += d * d
            out[ok] = acc
        return pd.Series(out).where(ok, None)

    return dist(_c(a))
