"""Scalar expressions that the operators share. Undefined values stay visible: NaN, not NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS, EPS_FIX = 1e-7, 1e-5  # the two stabilising constants
NAN, INF = float("nan"), float("inf")
WINDOWS = [("6-12", 6, 12), ("13-30", 13, 30)]  # rollout steps, ends included


def shown(x: Column, n: int | Column = 6) -> Column:
    """A finite double as text, n significant figures and an exponent, by its exact binary value; ties go to the even figure."""
    zeros = F.lit("0" * (n - 1)) if isinstance(n, int) else F.repeat(F.lit("0"), n - 1)
    as_text = lambda v: F.call_function("format_number", v, F.concat(F.lit("0."), zeros, F.lit("E0")))
    # a whole double counts as inexact in Java's formatter, which rounds its ties up; as a long it is exact
    whole = (F.rint(x) == x) & (F.abs(x) < 2.0**63)
    return F.when(whole, as_text(x.try_cast("bigint"))).otherwise(as_text(x))


def sig(x: Column, n: int | Column = 6) -> Column:
    """x to n significant figures, by its exact binary value, ties to the even figure; null, NaN and infinities pass."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == INF) | (x == 0), x).otherwise(shown(x, n).cast("double"))


def variance(x: Column) -> Column:
    """Sample variance; below 1e-15 of the mean square it is what summing in some order leaves, and 0."""
    v = F.var_samp(x)
    return F.when(v <= 1e-15 * F.avg(x * x), 0.0).otherwise(v)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != INF)


def safe_div(a: Column, b: Column) -> Column:
    """a / b with 0 / 0 = NaN and x / 0 = an infinity of its sign."""
    return F.when(b == 0, F.when(a == 0, NAN).when(a > 0, INF).otherwise(-INF)).otherwise(F.try_divide(a, b))


def floor_share(var: Column, eps: float) -> Column:
    """eps / (var + eps): what the constant supplies of the denominator; 0 where there is none."""
    if eps < 0:
        raise ValueError("eps must not be negative")
    return F.lit(0.0) if eps == 0 else F.lit(eps) / (var + F.lit(eps))


def band(share: Column) -> Column:
    return F.when(~finite(share), "undefined").when(share < 0.01, "well-conditioned").when(share < 0.5, "floor-sensitive").when(share < 0.9, "floor-dominated").otherwise("floor-determined")


def vrmse(mse: Column, var: Column, eps: float | Column) -> Column:
    if isinstance(eps, float) and eps < 0:
        raise ValueError("eps must not be negative")
    eps = F.lit(eps) if isinstance(eps, float) else eps
    return F.sqrt(safe_div(mse, var + eps))


def nan_to_num(x: Column) -> Column:
    big = 1.7976931348623157e308
    return F.when(F.isnan(x), 0.0).when(x == INF, big).when(x == -INF, -big).otherwise(x)


def two_sided_p(r: Column, df: Column) -> Column:
    """Two-sided p of a correlation with integer df: the finite Student sum, no solver."""
    theta = F.atan(F.abs(r) / F.sqrt(1 - r * r))
    c, s = F.cos(theta), F.sin(theta)
    k = F.floor((df - 2) / 2).cast("int")
    # even df: sin * (1 + 1/2 cos^2 + 1.3/2.4 cos^4 + ...); odd df: 2/pi (theta + sin cos (1 + 2/3 cos^2 + ...))
    term = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("sum"))

    def total(first: int) -> Column:
        return F.aggregate(
            F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")),
            term,
            lambda a, i: F.struct((a["t"] * c * c * (2 * i - 1 + first) / (2 * i + first)).alias("t"), (a["sum"] + a["t"] * c * c * (2 * i - 1 + first) / (2 * i + first)).alias("sum")),
            lambda a: a["sum"],
        )

    even, odd = s * total(0), F.lit(0.6366197723675814) * (theta + F.when(df > 1, s * c * total(1)).otherwise(0.0))
    return F.lit(1.0) - F.when(df % 2 == 0, even).otherwise(odd)
