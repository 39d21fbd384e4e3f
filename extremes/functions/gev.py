"""The GEV distribution as column expressions. A negative shape is heavy-tailed; shape 0 is the Gumbel case."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329
# Lanczos coefficients, g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def no_nan(x: Column) -> Column:
    """Null for NaN and for infinities, which Spark's aggregates would not skip."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def gamma(x: Column) -> Column:
    """Gamma function for x > 0.5, by Lanczos' formula."""
    y = x - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + 7.5
    return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, y + 0.5) * F.exp(-t) * total


def plotting_position(kind: str, rank: Column, n: Column) -> Column:
    """ecdf, weibull, cunnane, gringorten, landwehr or goda."""
    a, b = {"ecdf": (0.0, 0.0), "weibull": (0.0, 1.0), "cunnane": (0.4, 0.2), "gringorten": (0.44, 0.12), "landwehr": (0.35, 0.0), "goda": (0.45, 0.0)}[kind]
    return (rank - a) / (n + b)


def z_test(shape: Column, n: Column) -> Column:
    """Statistic of the hypothesis that the shape is 0 (fixed value: 0.5633)."""
    return shape * F.sqrt(n / 0.5633)


def gumbel_scale(l2: Column) -> Column:
    # Fixed value: ln 2 to four digits.
    return l2 / 0.6931


def gumbel_location(l1: Column, scale: Column) -> Column:
    return l1 - EULER * scale


def shape_of(b0: Column, b1: Column, b2: Column) -> Column:
    # Ln 2 / ln 3 and the published approximation of the shape.
    c = F.try_divide(2 * b1 - b0, 3 * b2 - b0) - 0.63093
    return 7.859 * c + 2.9554 * c * c


def scale_of(l2: Column, shape: float | Column) -> Column:
    if not isinstance(shape, Column):
        return gumbel_scale(l2) if shape == 0 else l2 * (shape / (math.gamma(1 + shape) * (1 - 2.0**-shape)))
    k = F.nullif(shape, F.lit(0.0))
    other = F.try_divide(l2 * k, gamma(1 + k) * (1 - F.pow(F.lit(2.0), -k)))
    return F.when(shape == 0, gumbel_scale(l2)).otherwise(other)


def location_of(l1: Column, scale: Column, shape: float | Column) -> Column:
    if not isinstance(shape, Column):
        return gumbel_location(l1, scale) if shape == 0 else l1 - scale * ((1 - math.gamma(1 + shape)) / shape)
    k = F.nullif(shape, F.lit(0.0))
    return F.when(shape == 0, gumbel_location(l1, scale)).otherwise(l1 - scale * (1 - gamma(1 + k)) / k)


def cdf(x: Column, loc: Column, scale: Column, shape: Column) -> Column:
    """Null outside the support and for a scale of 0."""
    z, k = F.try_divide(x - loc, scale), F.nullif(shape, F.lit(0.0))
    inner = 1 - k * z
    return F.when(shape == 0, F.exp(-F.exp(-z))).when(inner >= 0, F.exp(-F.pow(inner, 1 / k)))


def lnt(t: Column) -> Column:
    return -F.ln(1 - 1 / t)


def reduced_variate(t: Column, shape: Column) -> Column:
    k = F.nullif(shape, F.lit(0.0))
    return F.when(shape == 0, -F.ln(lnt(t))).otherwise((1 - F.pow(lnt(t), k)) / k)


def quantile(t: Column, loc: Column, scale: Column, shape: Column) -> Column:
    """The value that is exceeded once in ``t`` blocks; null for t <= 1."""
    return F.when(t > 1, loc + scale * reduced_variate(F.when(t > 1, t), shape))


def quantile_variance(t: Column, scale: Column, shape: Column, n: Column, c: tuple[float, float, float]) -> Column:
    """Variance of a quantile when the shape is given."""
    y = reduced_variate(t, shape)
    return F.try_divide(scale * scale * (c[0] + c[1] * y + c[2] * y * y), n)


def return_period(p: Column) -> Column:
    return F.try_divide(F.lit(1.0), 1 - p)


def scaled(intercept: Column, slope: Column, duration: Column) -> Column:
    return F.pow(F.lit(10.0), intercept + slope * F.log10(duration))


def fill_c(shape: float) -> tuple[float, float, float]:
    """Coefficients of the quantile variance for a given shape, from the sampling variances of b0 and b1."""
    g1, g2, h = math.gamma(1 + shape), math.gamma(1 + 2 * shape), 1 - 2.0**-shape
    d_loc = (1 - 1 / h + 1 / (h * g1), 2 / h - 2 / (h * g1))
    d_scale = (-shape / (h * g1), 2 * shape / (h * g1))
    tail = sum(math.gamma(2 * shape + m) * (-0.5) ** m / ((shape + m) * math.factorial(m)) for m in range(1, 30))
    big_g = 1 + 2 * shape**2 / g2 * tail
    v00 = (g2 - g1**2) / shape**2
    v11 = 2.0 ** (-2 * shape) * (g2 * big_g - g1**2) / shape**2
    v01 = (2.0 ** (-2 * shape) * g2 + (1 - 2.0 ** (1 - shape)) * g1**2) / (2 * shape**2)
    form = lambda u, v: u[0] * v[0] * v00 + u[1] * v[1] * v11 + (u[0] * v[1] + u[1] * v[0]) * v01
    return form(d_loc, d_loc), 2 * form(d_loc, d_scale), form(d_scale, d_scale)


def fill_c_cubic(shape: float) -> tuple[float, float, float]:
    # Published cubic approximations.
    table = ((1.1128, -0.2384, 0.0908, 0.1084), (0.4580, -3.0561, 1.1104, -0.4071), (0.8046, -2.8890, 8.7874, -10.375))
    return tuple(sum(c * shape**i for i, c in enumerate(row)) for row in table)


def filliben_critical(shape: float, n: Column) -> tuple[Column, Column]:
    """Critical correlations at 5 % and 10 %, for shapes from -0.20 to 0.25."""
    if not -0.20 <= shape <= 0.25:
        raise ValueError("critical values are known for shapes from -0.20 to 0.25")
    # Published regression coefficients of factor and exponent.
    table = (((1.527, -0.7656, 2.228, -3.824), (0.1986, 0.3858, -0.5985)), ((1.695, -0.5205, 1.229, -2.809), (0.1912, 0.2838, -0.3765)))
    at = lambda row: sum(c * shape**i for i, c in enumerate(row))
    return tuple(1 - F.exp(-at(factor) * F.pow(n.cast("double"), F.lit(at(power)))) for factor, power in table)


def t_quantile(p: float, df: float) -> float:
    """Student's t quantile, by bisection of the incomplete beta function's continued fraction."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_quantile(1 - p, df)

    def upper(t: float) -> float:  # P(T > t)
        return 0.5 * _beta_share(df / (df + t * t), df / 2, 0.5)

    lo, hi = 0.0, 1.0
    while upper(hi) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break  # no number lies between
        lo, hi = (mid, hi) if upper(mid) > 1 - p else (lo, mid)
    return (lo + hi) / 2


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return _beta_share(df / (df + t * t), df / 2, 0.5)


def _beta_share(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0
    for m in range(300, 0, -1):  # evaluated from its end
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + even / (1 + odd / value)
    first = -(a + b) * x / (a + 1)
    return front / (1 + first / value) if value else front
