"""Column functions over float arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    pairs = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a, b) -> Column:
    """1 - cos(a, b); NULL when a vector is all zero."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def has_dimension(a, dimension: int) -> Column:
    c = _c(a)
    return c.isNotNull() & (F.size(c) == dimension) & ~F.exists(c, lambda x: x.isNull())


def literal(a) -> Column:
    """Text form of a vector, for export: ``[x1,x2,…]`` with nine digits."""
    digits = F.transform(_c(a), lambda x: F.regexp_replace(
        F.regexp_replace(F.format_string("%.9g", x.cast("double")), r"(\.\d*?)0+(e|$)", "$1$2"),
        r"\.(e|$)", "$1"))
    return F.concat(F.lit("["), F.array_join(digits, ","), F.lit("]"))
