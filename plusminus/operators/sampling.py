"""Which clusters run and which of their records are processed.

A cluster is whatever a key expression says: a day, a file, a hash bucket. Records keep their cluster all the way, so
the population of each is counted before anything is filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plusminus.conf import ApproxConf


def draw(seed: int, *parts: Column | str, modulus: Column | int = 1 << 32) -> Column:
    """A number from 0 to below modulus that depends on the seed and the parts alone; any engine with MD5 finds the same."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    whole = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return whole % modulus


def keep_clusters(df: DataFrame, cluster: Column, conf: ApproxConf, clusters: list | None = None) -> DataFrame:
    """The share conf.keep_fraction of the clusters, those drawn lowest by the seed; the others are never read further.

    clusters: the values of the cluster expression, if known; otherwise they are looked up. One value for each cluster
    goes to the driver, as a scheduler's list of tasks does; the filter is a literal list that reaches the scan where
    cluster is a partition column.
    """
    if conf.precise or conf.keep_fraction >= 1:
        return df
    if clusters is None:
        clusters = [r[0] for r in df.select(cluster.alias("c")).distinct().collect()]
    return df.filter(cluster.isin(kept_clusters(clusters, conf))) if clusters else df


def kept_clusters(clusters: list, conf: ApproxConf) -> list:
    return cluster_order(clusters, conf.seed)[: max(1, round(conf.keep_fraction * len(clusters)))]


def cluster_order(clusters: list, seed: int | None) -> list:
    """All clusters in the order in which they would run: drawn by the seed, or as they are without one."""
    import hashlib

    ordered = sorted(clusters, key=lambda c: (c is None, c))
    return ordered if seed is None else sorted(ordered, key=lambda c: hashlib.md5(f"{seed}:{c}".encode()).hexdigest())


def positions(df: DataFrame, cluster: Column, order: list[Column]) -> DataFrame:
    """Adds `cluster` and `pos`, a record's place in its cluster from 0, by a unique order."""
    return df.withColumn("cluster", cluster).withColumn("pos", F.row_number().over(Window.partitionBy("cluster").orderBy(*order)) - 1)


def block_offset(conf: ApproxConf, block: Column, ratio: int | None = None) -> Column:
    r = ratio or conf.ratio
    return F.lit(conf.offset % r) if conf.seed is None else draw(conf.seed, F.col("cluster"), block, modulus=r)


def block_sample(df: DataFrame, cluster: Column, order: list[Column], conf: ApproxConf) -> DataFrame:
    """All records with `cluster`, `pos` and `sampled`: one record of each block of conf.ratio consecutive ones is sampled.

    A last block of k < ratio records yields its sample if the drawn place is below k, so with probability k / ratio.
    Records beyond max_per_cluster are not in the result.
    """
    placed = positions(df, cluster, order)
    if conf.max_per_cluster is not None:
        placed = placed.filter(F.col("pos") < conf.max_per_cluster)
    if conf.precise or conf.ratio == 1:
        return placed.withColumn("sampled", F.lit(True))
    block = F.floor(F.col("pos") / conf.ratio).cast("long")
    return placed.withColumn("sampled", F.col("pos") % conf.ratio == block_offset(conf, block))


def keyed_sample(df: DataFrame, cluster: Column, key: Column, conf: ApproxConf) -> DataFrame:
    """The same for a unique integer key: a block is the keys k * ratio to (k + 1) * ratio - 1. No sort and no shuffle.

    Where keys are missing a block gives its sample with the probability that its drawn key is there, so that a record is
    sampled with probability 1 / ratio all the same. max_per_cluster needs places, which only block_sample has.
    """
    if conf.max_per_cluster is not None:
        raise ValueError("max_per_cluster needs an order of columns")
    placed = df.withColumn("cluster", cluster)
    if conf.precise or conf.ratio == 1:
        return placed.withColumn("sampled", F.lit(True))
    block = F.floor(key / conf.ratio).cast("long")
    return placed.withColumn("sampled", F.pmod(key, F.lit(conf.ratio)) == block_offset(conf, block))


def scan_sample(df: DataFrame, conf: ApproxConf) -> DataFrame:
    """The same with an input partition as a cluster: records are counted as they are read. No sort and no shuffle.

    A record's cluster and place are its partition and its place there, which hold for one execution: aggregate the result
    once, as the estimator does, and don't join two of them. df: rows as they are read, maybe filtered or projected.
    Records beyond max_per_cluster are not in the result.
    """
    here = F.monotonically_increasing_id()
    placed = df.withColumn("__here", here)
    placed = placed.select("*", F.shiftright("__here", 33).alias("cluster"), F.col("__here").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")).drop("__here")
    if conf.max_per_cluster is not None:
        placed = placed.filter(F.col("pos") < conf.max_per_cluster)
    if conf.precise or conf.ratio == 1:
        return placed.withColumn("sampled", F.lit(True))
    block = F.floor(F.col("pos") / conf.ratio).cast("long")
    return placed.withColumn("sampled", F.col("pos") % conf.ratio == block_offset(conf, block))


def line_cap(df: DataFrame, cluster: Column, order: list[Column], most: int) -> DataFrame:
    """At most so many records of each cluster, the first ones."""
    return positions(df, cluster, order).filter(F.col("pos") < most)


def cluster_stats(placed: DataFrame, measure: Column | None = None, exact_s2: bool = False) -> DataFrame:
    """(cluster, pop_m, smp_m, s2): records, processed records and, for a measure, its population variance over processed ones.

    s2 is cut to an integer unless exact_s2; without a measure it is null.
    """
    s2 = F.lit(None).cast("double")
    if measure is not None:
        found = F.coalesce(F.var_pop(F.when(F.col("sampled"), measure).cast("double")), F.lit(0.0))
        s2 = found if exact_s2 else F.floor(F.round(found, 6)).cast("double")
    return placed.groupBy("cluster").agg(F.count("*").alias("pop_m"), F.count_if("sampled").alias("smp_m"), s2.alias("s2"))
