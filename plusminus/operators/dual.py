"""Tasks with a precise and an approximate form; which clusters or keys take which is drawn from a seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plusminus.operators.sampling import draw


@dataclass(frozen=True)
class DualExpr:
    """approximate None: the record itself, unchanged, as the input column given to `map`."""

    precise: Column
    approximate: Column | None = None


def approximate_cluster(cluster: Column, share: float, seed: int = 1) -> Column:
    """Whether a cluster is one of about `share` of them that run the approximate form."""
    return draw(seed, cluster, modulus=1_000_000) < round(share * 1_000_000)


def dual_map(df: DataFrame, value: DualExpr, identity: Column, cluster: Column, share: float, seed: int = 1, name: str = "value") -> DataFrame:
    """df with `name` from the precise or the approximate form, and `approximate`, which it was."""
    flag = approximate_cluster(cluster, share, seed)
    other = identity if value.approximate is None else value.approximate
    return df.withColumn("approximate", flag).withColumn(name, F.when(F.col("approximate"), other).otherwise(value.precise))


def dual_reduce(df: DataFrame, key: Column, precise: Column, approximate: Column, share: float, seed: int = 1, name: str = "value") -> DataFrame:
    """(key, approximate, name): each key's group reduced by one of two aggregates; both are partial before the one shuffle."""
    groups = df.withColumn("key", key.cast("string")).groupBy("key").agg(precise.alias("__p"), approximate.alias("__a"))
    flag = draw(seed, F.col("key"), modulus=1_000_000) < round(share * 1_000_000)
    return groups.select("key", flag.alias("approximate"), F.when(flag, F.col("__a")).otherwise(F.col("__p")).alias(name))
