"""Column expressions over arrays of numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12
# Least deviation in a density: an author with a single vector has none.
LEAST_SIGMA = 1e-6


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    length = F.greatest(norm(vector), F.lit(TINY))
    return F.transform(as_double(vector), lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-8)) * F.greatest(norm(b), F.lit(1e-8)))


def neg_log_density(target: Column, mu: Column, sigma: Column) -> Column:
    """Minus the mean over dimensions of log N(target; mu, sigma), with sigma at least ``LEAST_SIGMA``."""
    half_log_2pi = 0.5 * math.log(2 * math.pi)
    m, s = as_double(mu), as_double(sigma)

    def term(t, i):
        spread = F.greatest(F.get(s, i), F.lit(LEAST_SIGMA))
        gap = (t - F.get(m, i)) / spread
        return gap * gap / 2 + F.log(spread) + half_log_2pi

    return total(F.transform(as_double(target), term)) / F.size(target)


def gaussian_nll(target: Column, mu: Column, sigma: Column, eps: float = 1e-6) -> Column:
    """Half the mean over dimensions of ``(t-mu)^2/var + ln var`` with ``var = sigma^2 + eps``."""
    m, s = as_double(mu), as_double(sigma)

    def term(t, i):
        var = F.get(s, i) * F.get(s, i) + eps
        gap = t - F.get(m, i)
        return gap * gap / var + F.log(var)

    return F.lit(0.5) * total(F.transform(as_double(target), term)) / F.size(target)


def pad_right(items: Column, length: Column, fill: int = 0) -> Column:
    return F.concat(items, F.array_repeat(F.lit(fill).cast("bigint"), (length - F.size(items)).cast("int")))
