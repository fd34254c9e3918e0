"""Online aggregation as a stream: every file is a cluster, every micro-batch a wave, and the query stops itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plusminus.conf import ApproxConf
from plusminus.operators.estimator import Sampled, estimate, sample_hits
from plusminus.plans.progressive import CHECKS, Progress, Wave, error_of, top_key


def stream_aggregate(stream: DataFrame, key: Column, value: Column, cluster: Column, order: Column | list[Column], total: int, conf: ApproxConf, folder: str, watch: Callable[[Wave], None] | None = None) -> Progress:
    """Runs a stream of files to its end, or until the largest key's error was below the target on more than CHECKS batches.

    stream: a file source of one cluster a file (maxFilesPerTrigger sets the files of a wave). total: how many clusters
    there are. folder: shared, one for each run; a run that failed goes on where it ended if it is started again with its
    folder. A batch writes its state under its number, so one that is repeated after a failure replaces its own rows and
    none is counted twice.
    """
    spark: SparkSession = stream.sparkSession
    waves: list[Wave] = []
    calm = {"n": 0}

    def state() -> Sampled:
        return Sampled(spark.read.parquet(f"{folder}/hits").drop("batch"), spark.read.parquet(f"{folder}/stats").drop("batch"), total)

    def take(batch: DataFrame, number: int) -> None:
        if calm["n"] > CHECKS and conf.adaptive_dropping:
            return
        part = sample_hits(batch, key, value, cluster, order, conf.with_(keep_fraction=1.0), [])
        part.stats.write.mode("overwrite").parquet(f"{folder}/stats/batch={number}")
        part.hits.write.mode("overwrite").parquet(f"{folder}/hits/batch={number}")
        now = state()
        top = top_key(now, spark, conf)
        error = error_of(top)
        calm["n"] = calm["n"] + 1 if error < conf.target_error else 0
        stop = conf.adaptive_dropping and calm["n"] > CHECKS
        waves.append(Wave(number, top["n"], total, conf.ratio, top["key"], float(top["tau"]), float(top["half"]), float(error), top["keys"], "dropping" if stop else "running"))
        if watch:
            watch(waves[-1])

    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    while query.isActive:
        query.awaitTermination(1)
        if waves and waves[-1].status == "dropping":
            query.stop()
    query.awaitTermination()
    done = state()
    return Progress(estimate(done, conf), waves, done)


def file_cluster() -> Column:
    return F.col("_metadata.file_path")
