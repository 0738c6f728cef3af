"""Column functions that Spark lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the rational approximation of erfc, of which the error is below 1.5e-7 (fixed values).
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERFC_SCALE = 0.3275911


def normal_p(z: Column) -> Column:
    """Two-sided normal p-value, erfc(|z| / sqrt 2)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERFC_SCALE * x)
    out = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        out = out * t + c
    return out * t * F.exp(-x * x)


def safe_ln(x: Column) -> Column:
    """ln of positive numbers, else null."""
    return F.when(x > 0, F.ln(x))


def corr(x: Column | str, y: Column | str) -> Column:
    """Correlation over rows that have both; null where either is constant, which Spark's own function raises on."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def clip(x: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """x held between bounds; a null bound or value is passed over."""
    lo, hi = (b if isinstance(b, Column) or b is None else F.lit(float(b)) for b in (lo, hi))
    out = x if lo is None else F.when(x < lo, lo).otherwise(x)
    return out if hi is None else F.when(out > hi, hi).otherwise(out)


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    """The Yeo-Johnson transform at a given lambda."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.when(F.abs(lam) < 1e-12, F.lit(1.0)).otherwise(lam))
    two = 2 - lam
    down = F.when(F.abs(two) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, two) - 1) / F.when(F.abs(two) < 1e-12, F.lit(1.0)).otherwise(two))
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_inverse(y: Column, lam: Column | float) -> Column:
    """The inverse of ``yeo_johnson`` at a given lambda."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    up = F.when(F.abs(lam) < 1e-12, F.expm1(y)).otherwise(F.pow(F.greatest(lam * y + 1, F.lit(0.0)), 1 / F.when(F.abs(lam) < 1e-12, F.lit(1.0)).otherwise(lam)) - 1)
    two = 2 - lam
    down = F.when(F.abs(two) < 1e-12, -F.expm1(-y)).otherwise(1 - F.pow(F.greatest(1 - two * y, F.lit(0.0)), 1 / F.when(F.abs(two) < 1e-12, F.lit(1.0)).otherwise(two)))
    return F.when(y >= 0, up).otherwise(down)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [F.round(n, digits).alias(n) for n in names]


def chi2_p(x: Column, df: Column | int) -> Column:
    """P(a chi-square variable of ``df`` degrees of freedom exceeds x), for whole df from 1: erfc or exp(-x/2) plus a finite sum."""
    df = F.lit(df) if isinstance(df, int) else df
    half, odd = x / 2, df % 2 == 1
    start = F.when(odd, F.struct((F.exp(-half) * F.sqrt(half) * (2 / math.sqrt(math.pi))).alias("term"), F.lit(0.0).alias("total"))).otherwise(F.struct(F.exp(-half).alias("term"), F.lit(0.0).alias("total")))
    steps = F.when(df > 1, F.sequence(F.lit(0), (F.floor((df - 2) / 2)).cast("int"))).otherwise(F.array().cast("array<int>"))
    step = lambda a, k: F.struct((a["term"] * half / (k + F.when(odd, F.lit(1.5)).otherwise(F.lit(1.0)))).alias("term"), (a["total"] + a["term"]).alias("total"))
    rest = F.aggregate(steps, start, step)["total"]
    return F.when(x >= 0, F.least(F.lit(1.0), F.when(odd, normal_p(F.sqrt(F.greatest(x, F.lit(0.0))))).otherwise(F.lit(0.0)) + rest))
