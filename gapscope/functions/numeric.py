"""Number and statistics expressions: rounding, normal distribution, seeded draws."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

# Acklam's rational approximation of the inverse normal CDF.
ACKLAM_A = (-3.969683028665376e1, 2.209460984245205e2, -2.759285104469687e2,
            1.38357751867269e2, -3.066479806614716e1, 2.506628277459239)
ACKLAM_B = (-5.447609879822406e1, 1.615858368580409e2, -1.556989798598866e2,
            6.680131188771972e1, -1.328068155288572e1)
ACKLAM_C = (-7.784894002430293e-3, -3.223964580411365e-1, -2.400758277161838,
            -2.549732539343734, 4.374664141464968, 2.938163982698783)
ACKLAM_D = (7.784695709041462e-3, 3.224671290700398e-1, 2.445134137142996, 3.754408661907416)
ACKLAM_LOW = 0.02425

EULER_MASCHERONI = 0.5772156649015329


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL where the denominator is 0 or NULL."""
    return F.when(den != 0, num / den)


def half_up(x: Column) -> Column:
    """Nearest integer with halves toward plus infinity."""
    return F.floor(x + 0.5)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def _horner(x: Column, coefficients, tail: float | None = None) -> Column:
    acc = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        acc = acc * x + F.lit(float(c))
    return acc if tail is None else acc * x + F.lit(tail)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    y = 1.0 - _horner(t, tuple(reversed(ERF_A))) * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(x: Column) -> Column:
    return 0.5 * (1.0 + erf(x / F.sqrt(F.lit(2.0))))


def norm_inv(p: Column) -> Column:
    """Inverse normal CDF inside (0, 1); NULL outside."""
    tail_lo = F.sqrt(-2.0 * F.ln(p))
    tail_hi = F.sqrt(-2.0 * F.ln(1.0 - p))
    q = p - 0.5
    r = q * q
    low = _horner(tail_lo, ACKLAM_C) / _horner(tail_lo, ACKLAM_D, 1.0)
    mid = _horner(r, ACKLAM_A) * q / _horner(r, ACKLAM_B, 1.0)
    high = -_horner(tail_hi, ACKLAM_C) / _horner(tail_hi, ACKLAM_D, 1.0)
    return (F.when((p <= 0) | (p >= 1), None).when(p < ACKLAM_LOW, low)
            .when(p <= 1 - ACKLAM_LOW, mid).otherwise(high))


_M32 = 0xFFFFFFFF


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_M32))


def _imul(x: Column, y: Column) -> Column:
    """Low 32 bits of a product of two 32-bit values held in longs, by 16-bit halves."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return _low32(low * y + F.shiftleft((high * y).bitwiseAND(F.lit(0xFFFF)), 16))


def _mix(a: Column, shift: int, odd: int) -> Column:
    return _imul(a.bitwiseXOR(F.shiftright(a, shift)), a.bitwiseOR(F.lit(odd).cast("long")))


def seeded_uniform(seed: Column, k: Column) -> Column:
    """The k-th draw (k >= 1) in [0, 1) of the 32-bit generator started at ``seed``.

    Draw k depends on the seed and k alone, so any draw is one expression.
    """
    step = F.lit(0x6D2B79F5).cast("long")
    start = _let(_low32(k.cast("long")), lambda n: _low32(seed.cast("long") + _imul(n, step)))
    first = _let(start, lambda a: _mix(a, 15, 1))
    second = _let(first, lambda t: _low32(t + _mix(t, 7, 61)).bitwiseXOR(t))
    return _let(second, lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(4294967296.0))


def expected_max_sharpe(variance: Column, trials: Column) -> Column:
    """Best Sharpe ratio that luck alone is expected to reach among ``trials`` strategies."""
    n = trials.cast("double")
    best = (1 - EULER_MASCHERONI) * norm_inv(1.0 - 1.0 / n) + EULER_MASCHERONI * norm_inv(
        1.0 - 1.0 / (n * F.exp(F.lit(1.0))))
    return F.when((trials < 2) | (variance <= 0), 0.0).otherwise(F.sqrt(variance) * best)


def _sharpe_variance(sr: Column, skew: Column, kurt: Column) -> Column:
    return F.greatest(F.lit(1e-12), 1.0 - skew * sr + (kurt - 1.0) / 4.0 * sr * sr)


def probabilistic_sharpe(sr: Column, benchmark: Column, n: Column, skew: Column, kurt: Column) -> Column:
    z = (sr - benchmark) * F.sqrt((n - 1).cast("double")) / F.sqrt(_sharpe_variance(sr, skew, kurt))
    return F.when(n < 2, 0.0).otherwise(norm_cdf(z))


def min_track_record(sr: Column, benchmark: Column, skew: Column, kurt: Column, confidence: float = 0.95) -> Column:
    z = norm_inv(F.lit(confidence))
    excess = sr - benchmark
    return F.when(excess > 0, 1.0 + _sharpe_variance(sr, skew, kurt) * F.pow(z / excess, F.lit(2.0)))
