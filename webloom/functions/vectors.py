"""Vector functions as native higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector is zero."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def normalize_l2(a: Column | str) -> Column:
    """A vector at length one; of a zero vector NaN."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(float("nan"))))


def mean_pool(tokens: Column | str) -> Column:
    """The mean of an array of token vectors, position by position."""
    t = _c(tokens)
    first = F.transform(F.get(t, 0), lambda x: x.cast("double"))
    total = F.aggregate(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(t))
