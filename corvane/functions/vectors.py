"""Column functions over array<double> vectors and map<string,double> spectra."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def as_double(v: Column) -> Column:
    """float32 vectors become double before any arithmetic."""
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def unit(v: Column) -> Column:
    """v / |v|; a zero vector is left as it is.

    The vector and its norm stand in arrays of one, so that they are found once, not for each element.
    """
    over = lambda w, n: F.when(n == 0, w).otherwise(scaled(w, n))
    return F.transform(F.array(v), lambda w: F.transform(F.array(norm(w)), lambda n: over(w, n))[0])[0]


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(difference(a, b), F.lit(0.0), lambda acc, x: acc + x * x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with zero norms counted as 1."""
    na, nb = norm(a), norm(b)
    return dot(a, b) / (F.when(na == 0, 1.0).otherwise(na) * F.when(nb == 0, 1.0).otherwise(nb))


def padded(v: Column, width: int | Column) -> Column:
    """Right-pad with 0.0; wider vectors are unchanged."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(width - F.size(v), F.lit(0)).cast("int")))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def variance(v: Column) -> Column:
    """Population variance; 0 for an empty array."""
    return F.when(F.size(v) == 0, 0.0).otherwise(
        F.transform(F.array(mean(v)), lambda m: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)))[0] / F.size(v)
    )


def gate_state(spectrum: Column, threshold: Column, ethical_key: Column) -> Column:
    """The dual-key gate over a map from axis to projection: consolidated only if both keys hold."""
    return F.when((variance(F.map_values(spectrum)) >= threshold) & ethical_key, "consolidated").otherwise("incubating")


def is_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
