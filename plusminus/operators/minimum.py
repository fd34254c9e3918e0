"""A minimum with confidence, from the values seen so far.

Two aggregate passes give all that is needed: the mean, then the sums of the distances from it and of their squares.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plusminus.functions.stats import z_value

#: Width of the bisection and the largest error, in percent; the constant of the confidence formula (fixed values).
WIDTH, MOST, FACTOR = 0.01, 100.0, 120.0


def confidence_of(error: float, spread: float, n: int) -> float:
    """The confidence that the minimum lies no more than error percent below the least of n values."""
    if spread <= 0:
        return 1.0 if error > 0 else 0.0
    # By logarithms: the power itself is beyond a double for many values.
    return -math.expm1(-n * math.log1p(error * error / (FACTOR * (spread * spread * spread))))


def error_bound(n: int, spread: float, confidence: float = 0.95) -> float:
    """The least error, to WIDTH and from above, whose confidence is over the wanted one; MOST if none is."""
    if n <= 1 or math.isnan(spread):
        return MOST
    low, high = 0.0, MOST
    while high - low > WIDTH:
        mid = (low + high) / 2
        low, high = (low, mid) if confidence_of(mid, spread, n) > confidence else (mid, high)
    return high


def corrected_spread(n: int, mean_gap_sum: float, square_sum: float, confidence: float) -> float:
    """The standard deviation after each value is moved away from the mean by the mean's own error."""
    if n <= 1:
        return math.nan
    e = z_value(confidence) * math.sqrt(square_sum / (n - 1)) / math.sqrt(n)
    return math.sqrt((square_sum + 2 * e * mean_gap_sum + n * e * e) / (n - 1))


@dataclass(frozen=True)
class Minimum:
    least: float | None
    error: float
    n: int

    @property
    def low(self) -> float | None:
        return None if self.least is None else self.least * (1 - self.error / 100)


def approx_minimum(df: DataFrame, value: Column, confidence: float = 0.95) -> Minimum:
    """The least value of df and how far, in percent, the true minimum may lie below it. Nulls are no values."""
    values = df.select(value.cast("double").alias("v")).filter("v is not null and not isnan(v)")
    first = values.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("least")).first()
    if not first["n"]:
        return Minimum(None, MOST, 0)
    gap = F.abs(F.col("v") - F.lit(first["mean"]))
    second = values.agg(F.sum(gap).alias("gaps"), F.sum(gap * gap).alias("squares")).first()
    spread = corrected_spread(first["n"], second["gaps"], second["squares"], confidence)
    return Minimum(first["least"], error_bound(first["n"], spread, confidence), first["n"])


def closed_error(n: Column, spread: Column, confidence: float) -> Column:
    """The same bound in closed form, as the confidence rises with the error: no bisection, so it lies within WIDTH of it."""
    root = F.sqrt(FACTOR * F.pow(spread, 3) * (F.pow(F.lit(1 - confidence), -1 / n) - 1))
    return F.when(n <= 1, MOST).otherwise(F.least(root, F.lit(MOST)))


def minimum_rows(df: DataFrame, value: Column, group: Column | None = None, confidence: float = 0.95) -> DataFrame:
    """(grp, n, least, error_pct, low) for each group, wholly in Spark, by the closed form."""
    base = df.select((group if group is not None else F.lit("all")).cast("string").alias("grp"), value.cast("double").alias("v")).filter("v is not null")
    means = base.groupBy("grp").agg(F.avg("v").alias("mean"), F.count("*").alias("n"), F.min("v").alias("least"))
    gap = F.abs(F.col("v") - F.col("mean"))
    sums = base.join(means, "grp").groupBy("grp").agg(F.first("n").cast("double").alias("n"), F.first("least").alias("least"), F.sum(gap).alias("gaps"), F.sum(gap * gap).alias("squares"))
    e = F.lit(z_value(confidence)) * F.sqrt(F.try_divide(F.col("squares"), F.col("n") - 1)) / F.sqrt("n")
    spread = F.sqrt(F.try_divide(F.col("squares") + 2 * e * F.col("gaps") + F.col("n") * e * e, F.col("n") - 1))
    error = closed_error(F.col("n"), spread, confidence)
    return sums.select("grp", F.col("n").cast("long").alias("n"), "least", F.round(error, 4).alias("error_pct"), F.round(F.col("least") * (1 - error / 100), 4).alias("low"))


def running_minimum(df: DataFrame, value: Column, group: Column, order: list[Column]) -> DataFrame:
    """(grp, place, v, least): the running minimum of each group, as its rows come."""
    w = Window.partitionBy("grp").orderBy(*order)
    rows = df.withColumn("grp", group.cast("string")).withColumn("v", value.cast("double"))
    return rows.select("grp", F.row_number().over(w).alias("place"), "v", F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("least"))


def cost_of(text: Column) -> Column:
    """The number between `f=` and the next `M` of a search record; null without one."""
    return F.regexp_extract(text, r"f=([^M]*)M", 1).try_cast("double")


def search_minimum(records: DataFrame, text: Column, confidence: float = 0.95, min_error: float = 0.0, waves: list[DataFrame] | None = None) -> tuple[Minimum, str, bool]:
    """(bound, `(low-least]:  record`, stopped early) over search records; with waves it stops once the error is at most min_error."""
    seen, bound, stopped = None, Minimum(None, MOST, 0), False
    parts = waves or [records]
    for k, part in enumerate(parts):
        seen = part if seen is None else seen.unionByName(part)
        bound = approx_minimum(seen, cost_of(text), confidence)
        if min_error > 0 and bound.least is not None and bound.error <= min_error:
            stopped = k + 1 < len(parts)
            break
    if bound.least is None:
        return bound, "", stopped
    best = seen.select(text.alias("t"), cost_of(text).alias("c")).filter("c is not null").orderBy("c", "t").limit(1).first()["t"]
    return bound, f"({bound.low:.2f}-{bound.least:.2f}]:  {best}", stopped
