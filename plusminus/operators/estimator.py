"""Two-stage cluster sampling: an estimate and the half-width of its interval for every key.

Per key only three sums over clusters are needed - of the blown-up totals, of their squares, and of the variances
within - so clusters where a key does not occur need no row: S2 = (sum of squares - sum ** 2 / n) / (n - 1).

Records are read once: one aggregation gives, for each cluster and key, the hits and how many records there are and were
processed. It is written to the shared folder, and all that follows reads these few rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plusminus.conf import ApproxConf, Variance
from plusminus.functions.stats import LONG_MAX, t_quantile
from plusminus.operators.sampling import block_sample, cluster_stats, keep_clusters, keyed_sample, scan_sample
from plusminus.shared import saved

NULL_KEY = "NULLKEY"
WORST_CASE_SHARE = 0.1


@dataclass(frozen=True)
class Sampled:
    """hits: (key, cluster, y), y the sum of a key's values over the processed records of a cluster.
    stats: (cluster, pop_m, smp_m, s2), a row for each received cluster. total: how many clusters there are at all.
    received: how many of them have a row in stats, if known."""

    hits: DataFrame
    stats: DataFrame
    total: int
    received: int | None = None

    def clusters(self) -> int:
        return self.stats.count() if self.received is None else self.received


def within(y: Column, pop: Column, smp: Column, s2: Column, variance: Variance) -> Column:
    """What one cluster adds to the variance within; 0 without hits, and where a share would be above 1."""
    left = pop * (pop - smp)
    p = F.try_divide(y, smp)
    if variance is Variance.MEASURED:
        term = F.try_divide(left, smp) * s2
    elif variance is Variance.WORST_CASE:
        term = F.try_divide(left, smp) * WORST_CASE_SHARE * y
    else:
        term = F.when(p <= 1, F.try_divide(left, smp - 1) * p * (1 - p))
    return F.when(y > 0, F.coalesce(term, F.lit(0.0))).otherwise(0.0)


def with_moments(sampled: Sampled, variance: Variance) -> DataFrame:
    """(key, s1, s2hat, s_within, n_bad_p): the sums over clusters. The statistics of clusters are joined by a plain equi-join."""
    joined = sampled.hits.join(sampled.stats, "cluster")
    pop, smp, y = (F.col(c).cast("double") for c in ("pop_m", "smp_m", "y"))
    yhat = F.when(y != 0, F.coalesce(F.try_divide(pop, smp) * y, F.lit(0.0))).otherwise(0.0)
    bad = F.lit(0) if variance is not Variance.PROPORTION else F.when(y > smp, 1).otherwise(0)
    rows = joined.select("key", yhat.alias("yhat"), within(y, pop, smp, F.col("s2"), variance).alias("w"), bad.alias("bad"))
    return rows.groupBy("key").agg(F.sum("yhat").alias("s1"), F.sum(F.col("yhat") * F.col("yhat")).alias("s2hat"), F.sum("w").alias("s_within"), F.sum("bad").alias("n_bad_p"))


def estimates(moments: DataFrame, cn_tot: int, cn_smp: int, confidence: float) -> DataFrame:
    """(key, tau, half, n_bad_p): the estimate and the half-width, before rounding, from cn_smp of cn_tot clusters.

    half is infinite where one cluster stands for many.
    """
    n_all, n, t = float(cn_tot), float(max(cn_smp, 1)), t_quantile(cn_smp - 1, confidence)
    between = F.lit(0.0)
    if cn_smp < cn_tot:
        spread = F.greatest(F.try_divide(F.col("s2hat") - F.col("s1") * F.col("s1") / n, F.lit(n - 1)), F.lit(0.0))
        between = F.lit(float("inf")) if cn_smp == 1 else n_all * (n_all - n) / n * spread
    var = between + n_all / n * F.col("s_within")
    half = F.when(var < 0, float("inf")).otherwise(t * F.sqrt(F.greatest(var, F.lit(0.0))))
    return moments.select("key", (n_all / n * F.col("s1")).alias("tau"), half.alias("half"), "n_bad_p")


def rounded(rows: DataFrame) -> DataFrame:
    """(key, value, range): value cut to an integer, range rounded up; a range without bound is the largest long."""
    wide = (F.col("half") == float("inf")) | (F.col("half") >= float(LONG_MAX))
    half = F.when(wide, F.lit(LONG_MAX)).otherwise(F.ceil(F.round(F.when(wide, 0.0).otherwise(F.col("half")), 6)).cast("long"))
    return rows.select("key", F.floor(F.round("tau", 6)).cast("long").alias("value"), half.alias("range"))


def null_key(sampled: Sampled, variance: Variance, confidence: float) -> DataFrame:
    """The row that bounds any key never seen: value 0, and the range of one hit in the cluster where it would weigh most."""
    weight = F.coalesce(F.try_divide(F.col("pop_m") * (F.col("pop_m") - F.col("smp_m")), F.col("smp_m").cast("double")), F.lit(0.0))
    worst = sampled.stats.select("cluster", weight.alias("weight")).orderBy(F.col("weight").desc(), F.col("cluster").asc()).limit(1)
    hit = worst.select(F.lit(NULL_KEY).alias("key"), "cluster", F.lit(1).cast("double").alias("y"))
    one = Sampled(hit, sampled.stats, sampled.total)
    rows = estimates(with_moments(one, variance), sampled.total, sampled.clusters(), confidence)
    return rounded(rows).withColumn("value", F.lit(0).cast("long"))


def estimate(sampled: Sampled, conf: ApproxConf) -> DataFrame:
    """(key, value, range) of every key with a hit, and the row for unseen keys if conf asks for it."""
    out = rounded(estimates(with_moments(sampled, conf.variance), sampled.total, sampled.clusters(), conf.confidence))
    return out.unionByName(null_key(sampled, conf.variance, conf.confidence)) if conf.null_key and not conf.precise else out


def gathered(placed: DataFrame, key: Column, value: Column) -> tuple[DataFrame, DataFrame]:
    """(hits, stats without s2) from one pass over placed; a null key or value is no hit.

    key: a string, or an array of strings of which each is a hit. The combine before the shuffle is Spark's own, and what
    is written is a row for each cluster and key.
    """
    rows = placed.select("cluster", "sampled", key.alias("key"), value.cast("double").alias("y"))
    first = F.lit(True)
    if rows.schema["key"].dataType.typeName() == "array":
        keys = F.when(F.col("sampled"), F.col("key"))
        rows = rows.select("cluster", "sampled", "y", F.posexplode_outer(keys).alias("place", "key"))
        first = F.coalesce(F.col("place"), F.lit(0)) == 0  # a record is counted once
    hit = F.when(F.col("sampled"), F.col("key").cast("string"))
    sums = rows.groupBy("cluster", hit.alias("key")).agg(F.count_if(first).alias("pop_m"), F.count_if(first & F.col("sampled")).alias("smp_m"), F.sum(F.when(F.col("sampled"), F.col("y"))).alias("y"))
    once = saved(sums, "sums")
    stats = once.groupBy("cluster").agg(F.sum("pop_m").alias("pop_m"), F.sum("smp_m").alias("smp_m")).withColumn("s2", F.lit(None).cast("double"))
    return once.filter("key is not null and y is not null").select("key", "cluster", "y"), stats


def check_measure(df: DataFrame, value: Column) -> None:
    kind = df.select(value.alias("v")).schema["v"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "float", "double") and not kind.startswith("decimal"):
        raise TypeError(f"a measure is a number, not {kind}")


def sample_hits(df: DataFrame, key: Column, value: Column, cluster: Column | None, order: Column | list[Column] | None, conf: ApproxConf, clusters: list | None = None) -> Sampled:
    """Samples df and sums its hits. A record of a kept cluster counts for its population whether or not it is a hit.

    order: a unique integer key, by which records are sampled as they are read, or a list of columns whose order gives
    places (each cluster is sorted for it). cluster: None for the partitions of the scan, counted as they are read; then
    no order is needed. clusters: all cluster values, if known. Measures are not negative: a negative one would take
    from a total that the variance counts as a gain.
    """
    check_measure(df, value)
    if cluster is None:
        if conf.keep_fraction < 1:
            raise ValueError("partitions of a scan can't be drawn before it: name a cluster to drop some")
        placed = scan_sample(df, conf)
    else:
        if clusters is None and not conf.precise and conf.keep_fraction < 1:
            clusters = [r[0] for r in df.select(cluster.alias("c")).distinct().collect()]
        kept = keep_clusters(df, cluster, conf, clusters)
        placed = block_sample(kept, cluster, order, conf) if isinstance(order, list) else keyed_sample(kept, cluster, order, conf)
    hits, stats = gathered(placed, key, value)
    if conf.variance is Variance.MEASURED:
        if cluster is None:
            raise ValueError("the measured variance needs a second pass: name a cluster")
        stats = saved(cluster_stats(placed, value, conf.exact_s2), "stats")
    received = stats.count()
    return Sampled(hits, stats, received if clusters is None else len(clusters), received)


def precise_sum(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value): the exact sum of each key, over all records."""
    return df.select(key.cast("string").alias("key"), value.alias("v")).filter("key is not null").groupBy("key").agg(F.sum("v").cast("long").alias("value"))


def approx_sum(df: DataFrame, key: Column, value: Column, cluster: Column | None, order: Column | list[Column] | None = None, conf: ApproxConf | None = None, clusters: list | None = None) -> DataFrame:
    """(key, value, range): the sum of value by key from a sample of df; with conf.precise (key, value), exact.

    key: null where a record is no hit, so that filters don't change the population. cluster and order as in sample_hits.
    """
    conf = conf or ApproxConf()
    if conf.precise:
        return precise_sum(df, key, value)
    return estimate(sample_hits(df, key, value, cluster, order, conf, clusters), conf)


def approx_count(df: DataFrame, key: Column, cluster: Column | None, order: Column | list[Column] | None = None, conf: ApproxConf | None = None, clusters: list | None = None) -> DataFrame:
    """The number of records by key."""
    return approx_sum(df, key, F.lit(1), cluster, order, conf, clusters)


def half_width(tau: float, moments: tuple[float, float, float], n_all: int, n: int, confidence: float = 0.95) -> float:
    """The half-width for one key on the driver, for control loops: moments are (sum, sum of squares, sum within)."""
    s1, s2, s_within = moments
    if n < n_all and n == 1:
        return float("inf")
    spread = max(0.0, (s2 - s1 * s1 / n) / (n - 1)) if n > 1 else 0.0
    return t_quantile(n - 1, confidence) * (n_all * (n_all - n) / n * spread + n_all / n * s_within) ** 0.5
