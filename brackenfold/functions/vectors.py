"""Vector expressions: products, cosine distance and its guards.

All accumulate in double, element by element from the left, whatever the
element type, and run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(values) -> Column:
    """A query vector as a constant; it is folded once per plan."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def is_placeholder(a) -> Column:
    """All elements are zero (of either sign); such rows are stored but never found."""
    return F.forall(_col(a), lambda x: x == 0)


def is_finite(a) -> Column:
    return F.forall(_col(a), lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def similarity(a, b, norm_a=None, norm_b=None) -> Column:
    """Cosine, clamped to [-1, 1]; divided by one norm after the other."""
    na = norm(a) if norm_a is None else _col(norm_a)
    nb = norm(b) if norm_b is None else _col(norm_b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / na / nb))


def distance_of(sim) -> Column:
    return (F.lit(1.0) - _col(sim)).cast("float")


def cosine_distance(a, b) -> Column:
    """Float in [0, 2]. Raises on different lengths, then on values that aren't finite, then on zero vectors."""
    a, b = _col(a), _col(b)
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("DimensionMismatch: expected "), F.size(a).cast("string"), F.lit(", got "), F.size(b).cast("string"))).cast("float"))
        .when(~is_finite(a) | ~is_finite(b), F.raise_error(F.lit("NaNDistance")).cast("float"))
        .when(is_placeholder(a) | is_placeholder(b), F.raise_error(F.lit("ZeroVector")).cast("float"))
        .otherwise(distance_of(similarity(a, b)))
    )


def score_of(distance) -> Column:
    """1 - distance in [0, 1]: negative similarities all become 0 but keep their order by distance."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - _col(distance).cast("double"))).cast("float")
