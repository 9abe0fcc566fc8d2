"""Numbers: quantile levels, normal quantiles, transforms."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 23 levels of a quantile forecast.
LEVELS = (0.01, 0.025, *(k / 100 for k in range(5, 100, 5)), 0.975, 0.99)


def z_values(levels=LEVELS) -> list[float]:
    return [0.0 if q == 0.5 else NormalDist().inv_cdf(q) for q in levels]


def gaussian_array(mu: Column, sigma: Column, levels=LEVELS) -> Column:
    """Array of normal quantiles at the levels, none below 0."""
    return F.array(*(F.greatest(F.lit(0.0), mu + F.lit(z) * sigma) for z in z_values(levels)))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution by a published rational approximation (relative error below 1.2e-9); null outside 0 < p < 1."""
    # Fixed coefficients of the approximation: central and tail numerators and denominators.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(x: Column, terms) -> Column:
        out = F.lit(terms[0])
        for t in terms[1:]:
            out = out * x + t
        return out

    def tail(x: Column) -> Column:
        root = F.sqrt(F.ln(x) * -2.0)
        return poly(root, c) / poly(root, d)

    mid = p - 0.5
    return F.when((p <= 0) | (p >= 1), None).when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(mid * poly(mid * mid, a) / poly(mid * mid, b))


def to_log(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def from_log(x: Column) -> Column:
    return F.expm1(x)


def rate_of(count: Column, population: Column) -> Column:
    """Per 100,000."""
    return F.try_divide(count * 100000.0, population)


def count_of(rate: Column, population: Column) -> Column:
    """Nearest whole count, halves to even."""
    return F.bround(rate * population / 100000.0, 0)


def share_of(part: Column, whole: Column) -> Column:
    """part / whole, 1 where unknown."""
    return F.coalesce(F.try_divide(part, whole), F.lit(1.0))


def number_of(text: Column) -> Column:
    """Text as a number; junk gives null, the word `null` 0."""
    return F.when(F.lower(F.trim(text)) == "null", F.lit(0.0)).otherwise(text.try_cast("double"))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
