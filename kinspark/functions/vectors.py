"""Vector expressions.

All of them are plain Spark expressions for use inside any query; the bulk joins in
``operators.similarity`` do the same arithmetic block-wise on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT_NORM_TOLERANCE = 1e-3 + 1e-5
NORM_EPSILON = 1e-10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v, eps: float = NORM_EPSILON) -> Column:
    n = norm(v) + F.lit(eps)
    return F.transform(_col(v), lambda x: x.cast("double") / n)


def is_unit(v, tolerance: float = UNIT_NORM_TOLERANCE) -> Column:
    return F.abs(norm(v) - 1.0) <= F.lit(tolerance)


def cosine_distance(a, b) -> Column:
    return 1.0 - dot(a, b) / (norm(a) * norm(b))


def squared_l2(a, b) -> Column:
    squares = F.zip_with(_col(a), _col(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def cosine_to_squared_l2(distance) -> Column:
    """On unit vectors the squared Euclidean distance is twice the cosine distance."""
    return _col(distance) * 2.0


def squared_l2_to_cosine(squared) -> Column:
    return _col(squared) / 2.0


def rounded(value, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0, so equal distances compare and hash equal."""
    return F.round(_col(value), digits) + F.lit(0.0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half_precision(v: pd.Series) -> pd.Series:
    """Round to half precision and widen again, as a half-precision store would."""
    known = v.notna().to_numpy()
    rows = v[known].tolist()
    if rows:
        flat = np.concatenate(rows).astype(np.float32).astype(np.float16).astype(np.float32)
        rows = np.split(flat, np.cumsum([len(r) for r in rows])[:-1])
    out = np.full(len(v), None, dtype=object)
    for at, row in zip(np.flatnonzero(known), rows):
        out[at] = row
    return pd.Series(out)
