"""Results as text, their relative error, and text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(value: Column, half: Column) -> Column:
    """`value+/-range`."""
    return F.concat(value.cast("string"), F.lit("+/-"), half.cast("string"))


def relative_error(value: Column, half: Column) -> Column:
    """range / value, and 0 for a value of 0."""
    return F.when(value == 0, 0.0).otherwise(F.try_divide(half.cast("double"), value.cast("double")))


def as_lines(result: DataFrame) -> DataFrame:
    """key, tab, value: with its range if the result has one."""
    value = rendered(F.col("value"), F.col("range")) if "range" in result.columns else F.col("value").cast("string")
    return result.select(F.concat(F.col("key"), F.lit("\t"), value).alias("value"))


def write_lines(result: DataFrame, path: str) -> None:
    as_lines(result).write.text(path)
