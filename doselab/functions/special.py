"""Special functions as columns: the log of the gamma function, the regularised incomplete beta function, and what follows from it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Steps of the continued fraction: enough for full precision up to parameters of some ten thousand.
STEPS = 400
_TINY = 1e-300


def log_gamma(z: Column) -> Column:
    """ln of the gamma function; z above 0.5."""
    z = z.cast("double") - 1
    total = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + k)
    t = z + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, _TINY).otherwise(x)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by the modified method of Lentz."""

    def step(s: Column, factor: Column) -> Column:
        d = 1 / _away(1 + factor * s["d"])
        c = _away(1 + factor / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def both(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # An array of one keeps the first half step from being written out again for each use.
        return F.get(F.transform(F.array(step(s, even)), lambda half: step(half, odd)), F.lit(0))

    d = 1 / _away(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, both)["h"]


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b of 0.5 or more and x in [0, 1]; null elsewhere."""
    a, b, x = a.cast("double"), b.cast("double"), x.cast("double")
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    inside = F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)
    return F.when(x == 0, 0.0).when(x == 1, 1.0).when((x > 0) & (x < 1) & (a >= 0.5) & (b >= 0.5), inside)


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p-value of a correlation of n pairs by Student's t with n - 2 degrees of freedom; null with under 3 pairs."""
    free = n - 2
    return F.when(free >= 1, beta_inc(free / 2, F.lit(0.5), F.greatest(F.lit(0.0), 1 - r * r)))
