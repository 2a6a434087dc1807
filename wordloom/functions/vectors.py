"""Column expressions over dense vectors (``array<double>``).

All of them are Catalyst expressions, so they can be used in any select, filter or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_TOLERANCE = 1e-10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_vector(c) -> Column:
    """The column as ``array<double>``; single-precision input is widened before any arithmetic."""
    return _col(c).cast("array<double>")


def literal_vector(values) -> Column:
    """A constant vector column."""
    return F.lit([float(v) for v in values]).cast("array<double>")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression used inside a lambda is evaluated again for each element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def _paired(a, b, combine) -> Column:
    a, b = _col(a), _col(b)
    message = F.concat(F.lit("vector sizes differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) != F.size(b), F.raise_error(message)).otherwise(combine(a, b))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _square_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def vec_add(a, b) -> Column:
    """Element-wise sum; fails when the sizes differ."""
    return _paired(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p + q))


def vec_sub(a, b) -> Column:
    """Element-wise difference; fails when the sizes differ."""
    return _paired(a, b, lambda x, y: F.zip_with(x, y, lambda p, q: p - q))


def vec_scale(v, factor) -> Column:
    """Every element times ``factor``."""
    return _let(_col(factor).cast("double"), lambda f: F.transform(_col(v), lambda x: x * f))


def vec_dot(a, b) -> Column:
    """Inner product; fails when the sizes differ."""
    return _paired(a, b, lambda x, y: _total(F.zip_with(x, y, lambda p, q: p * q)))


def vec_norm(v) -> Column:
    """Euclidean length."""
    return F.sqrt(_square_sum(_col(v)))


def is_normalized(v, tolerance: float = UNIT_TOLERANCE) -> Column:
    """Whether the length is 1 within ``tolerance``."""
    return F.abs(vec_norm(v) - 1.0) <= tolerance


def unit_vector(v) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    v = _col(v)
    return _let(vec_norm(v), lambda n: F.when(n == 0.0, v).otherwise(F.transform(v, lambda x: x / n)))


def squared_distance(a, b) -> Column:
    """Squared euclidean distance."""
    return _paired(a, b, lambda x, y: _total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))))


def euclidean(a, b) -> Column:
    """Euclidean distance; lower is better."""
    return F.sqrt(squared_distance(a, b))


def cosine_similarity(a, b) -> Column:
    """Cosine of the angle, higher is better; NULL when either vector is zero."""
    return F.try_divide(vec_dot(a, b), vec_norm(a) * vec_norm(b))


def normalized_cosine(a, b) -> Column:
    """Cosine similarity of vectors known to be of unit length: the inner product alone."""
    return vec_dot(a, b)


def cosine_distance(a, b) -> Column:
    """One minus the cosine similarity."""
    return 1.0 - cosine_similarity(a, b)


def query_vector(a, b, c) -> Column:
    """``b - a + c``: where the fourth word of the analogy a:b :: c:? is expected."""
    return vec_add(vec_sub(b, a), c)


def to_unit_vectors(df: DataFrame, column: str = "vector") -> DataFrame:
    """The table with every vector scaled to unit length."""
    return df.withColumn(column, unit_vector(column))
