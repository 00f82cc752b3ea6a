"""Dense vectors stored as ``array<double>`` / ``array<float>`` columns.

When the width is known the helpers expand to plain element arithmetic, which
stays inside whole-stage codegen; otherwise they fall back to higher-order
functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b, n: int | None = None) -> Column:
    """Inner product of two array columns (double arithmetic)."""
    a, b = _c(a), _c(b)
    if n is not None:
        terms = [a[i].cast("double") * b[i].cast("double") for i in range(n)]
        return reduce(lambda x, y: x + y, terms)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(v, n: int | None = None) -> Column:
    return F.sqrt(dot(v, v, n))


def scale(v, s: Column, n: int | None = None) -> Column:
    v = _c(v)
    if n is not None:
        return F.array(*[v[i].cast("double") * s for i in range(n)])
    return F.transform(v, lambda x: x.cast("double") * s)


def divide(v, d: Column, n: int | None = None) -> Column:
    v = _c(v)
    if n is not None:
        return F.array(*[v[i].cast("double") / d for i in range(n)])
    return F.transform(v, lambda x: x.cast("double") / d)


def l2_normalize(v, n: int | None = None, mode: str = "skip_zero") -> Column:
    """L2-normalise a vector.

    ``skip_zero``: a zero vector is left unchanged (feature path).
    ``clamp``: divide by ``max(norm, 1e-8)`` (index / query path).
    """
    nv = norm(v, n)
    if mode == "clamp":
        return divide(v, F.greatest(nv, F.lit(1e-8)), n)
    return F.when(nv > 0, divide(v, nv, n)).otherwise(scale(v, F.lit(1.0), n))


def zeros(n: int) -> Column:
    return F.array(*[F.lit(0.0) for _ in range(n)])


def pad_or_zero(v, n: int) -> Column:
    """Element ``i`` or 0.0 when the vector is null or shorter than ``n``."""
    v = _c(v)
    return F.array(*[F.coalesce(F.try_element_at(v, F.lit(i + 1)).cast("double"), F.lit(0.0))
                     for i in range(n)])


def expand(v, prefix: str, n: int) -> list[Column]:
    """Array column -> ``prefix0 .. prefix{n-1}`` scalar columns."""
    v = _c(v)
    return [v[i].cast("double").alias(f"{prefix}{i}") for i in range(n)]
