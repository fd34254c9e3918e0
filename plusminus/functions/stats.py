"""Statistics: Student's t without a statistics package, the normal step table, variance, sums and number formats."""

from __future__ import annotations

import functools
import math
import statistics
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: With no degree of freedom the normal quantile stands in, at 95 % to two places.
NO_FREEDOM = 1.96
LONG_MAX = (1 << 63) - 1
#: (least confidence, quantile): the table for minima (fixed values).
Z_TABLE = ((0.9999, 3.9), (0.999, 3.3), (0.99, 2.58), (0.98, 2.33), (0.95, 1.96), (0.90, 1.645), (0.85, 1.44), (0.80, 1.28))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        tail = front * _beta_fraction(a, b, x) / a
    else:
        tail = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return 1 - tail / 2 if t > 0 else tail / 2


@functools.lru_cache(maxsize=100_000)
def t_quantile(df: int, confidence: float = 0.95) -> float:
    """The two-sided quantile of Student's t, rounded to 9 places; for df < 1 that of the normal distribution."""
    if df < 1:
        return NO_FREEDOM if confidence == 0.95 else round(statistics.NormalDist().inv_cdf((1 + confidence) / 2), 9)
    target, low, high = 1 - (1 - confidence) / 2, 0.0, 2.0
    while t_cdf(high, df) < target:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if t_cdf(mid, df) < target else (low, mid)
    return round((low + high) / 2, 9)


def z_value(confidence: float) -> float:
    """The quantile for minima, by steps; below the table it is 1.0."""
    return next((z for least, z in Z_TABLE if confidence >= least), 1.0)


def z_column(confidence: Column) -> Column:
    out = F.lit(1.0)
    for least, z in reversed(Z_TABLE):
        out = F.when(confidence >= least, z).otherwise(out)
    return out


def sample_variance(values: Sequence[float]) -> float:
    """The n - 1 variance; of one value it is without bound, of none zero."""
    n = len(values)
    if n == 0:
        return 0.0
    if n == 1:
        return math.inf
    mean = sum(values) / n
    return sum((v - mean) ** 2 for v in values) / (n - 1)


def short_number(x: float) -> str:
    """1234567 as 1.2M, 1234 as 1.2K; 1000 and less as an integer."""
    if x > 1_000_000:
        return f"{x / 1_000_000:.1f}M"
    return f"{x / 1_000:.1f}K" if x > 1_000 else f"{int(x)}"


def one_decimal(x: Column) -> Column:
    """x, not negative, with one decimal as C prints it: the double's exact value decides, and a tie goes to the even digit.

    Java rounds the shortest decimal that names the double, and ties up. From 2^63 on digits are Java's.
    """
    whole = F.floor(x)
    part = x - whole.cast("double")
    # 20 * part is near + error exactly: the sum of two exact products and what its rounding lost.
    large, small = part * 16, part * 4
    near = large + small
    back = near - large
    error = (large - (near - back)) + (small - back)
    down = F.floor(near / 2)
    over = (near - (2 * down + 1)) + error
    digit = down + F.when((over > 0) | (over == 0) & (down % 2 == 1), 1).otherwise(0)
    exact = F.concat((whole + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"))
    return F.when(F.isnan(x), "nan").when(x == math.inf, "inf").when(x < 2.0**63, exact).otherwise(F.format_string("%.1f", x))


def short_number_column(x: Column) -> Column:
    """short_number of a column; null for null."""
    x = x.cast("double")
    return F.when(x > 1_000_000, F.concat(one_decimal(x / 1_000_000), F.lit("M"))).when(x > 1_000, F.concat(one_decimal(x / 1_000), F.lit("K"))).otherwise(x.cast("long").cast("string"))


def bucket(x: Column, width: int = 100) -> Column:
    """The start of the bucket of a width that x lies in."""
    return (F.floor(x / width) * width).cast("long")
