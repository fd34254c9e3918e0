"""Online aggregation: waves of clusters, an error check after each, and control of how many run and at which ratio.

The state is (key, cluster, y) and the statistics of clusters, written wave by wave to the shared folder; a wave is an
ordinary batch job, and the feedback from one to the next is a few numbers on the driver.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plusminus.conf import ApproxConf, Variance
from plusminus.operators.estimator import Sampled, estimate, estimates, sample_hits, with_moments
from plusminus.operators.sampling import cluster_order
from plusminus.plans.planner import Known, Plan, TimeModel, cheapest, fit_time
from plusminus.shared import shared_path

#: Checks in a row below the target after which no further wave is issued: more than this.
CHECKS = 2
PILOT_RATIO = 100

PROGRESS = "wave int, clusters_done int, clusters_total int, ratio int, top_key string, value double, half double, error double, keys long, status string"


@dataclass
class Wave:
    wave: int
    clusters_done: int
    clusters_total: int
    ratio: int
    top_key: str | None
    value: float
    half: float
    error: float
    keys: int
    status: str

    def row(self) -> tuple:
        return tuple(self.__dict__.values())


@dataclass
class Progress:
    """result: (key, value, range) from all waves that ran. waves: one record for each check."""

    result: DataFrame
    waves: list[Wave]
    sampled: Sampled
    plan: Plan | None = None
    model: TimeModel = field(default_factory=TimeModel)

    def progress(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([w.row() for w in self.waves], PROGRESS)


@dataclass(frozen=True)
class Query:
    """What is summed by which key, and what its clusters and their orders are."""

    df: DataFrame
    key: Column
    value: Column
    cluster: Column
    order: Column | list[Column]

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def clusters(self) -> list:
        """A value for each cluster, on the driver, as a scheduler's list of tasks is."""
        return sorted((r[0] for r in self.df.select(self.cluster.alias("c")).distinct().collect()), key=lambda c: (c is None, c))


def top_key(sampled: Sampled, spark: SparkSession, conf: ApproxConf) -> dict:
    """The key of the largest estimate with its error and what the planner needs of it; one row."""
    size = sampled.stats.agg(F.count("*").alias("n"), F.avg("pop_m").alias("records")).first()
    moments = with_moments(sampled, conf.variance)
    rows = estimates(moments, sampled.total, size["n"], conf.confidence).join(moments.drop("n_bad_p"), "key")
    best = rows.agg(F.max_by(F.struct("key", "tau", "half", "s1", "s2hat", "s_within"), F.struct("tau", "key")).alias("b"), F.count("*").alias("keys")).first()
    if best["b"] is None:
        return {"key": None, "tau": 0.0, "half": 0.0, "keys": 0, "n": size["n"], "records": size["records"] or 0.0, "s2": 0.0, "s2avg": 0.0, "var2": 0.0}
    b, n = best["b"], size["n"]
    s2 = max(0.0, (b["s2hat"] - b["s1"] ** 2 / n) / (n - 1)) if n > 1 else 0.0
    hits = sampled.hits.filter(F.col("key") == b["key"]).join(sampled.stats, "cluster")
    y, m = F.col("y").cast("double"), F.col("smp_m").cast("double")
    each = {Variance.MEASURED: F.col("s2"), Variance.WORST_CASE: 0.1 * y}.get(conf.variance, F.coalesce(F.try_divide(y, m) * (1 - F.try_divide(y, m)) * F.try_divide(m, m - 1), F.lit(0.0)))
    s2avg = hits.filter(y > 0).agg(F.avg(F.greatest(each, F.lit(0.0)))).first()[0] or 0.0
    return {"key": b["key"], "tau": b["tau"], "half": b["half"], "keys": best["keys"], "n": n, "records": size["records"], "s2": s2, "s2avg": s2avg, "var2": b["s_within"]}


def error_of(top: dict) -> float:
    """The relative error of the largest key; without a hit nothing is known yet, so it has no bound."""
    return top["half"] / top["tau"] if top["tau"] else float("inf")


def known_of(top: dict, n_all: int, fresh: bool) -> Known:
    """Planner input from a check: fresh plans a run of its own, otherwise the clusters so far count."""
    return Known(n_all, top["tau"], top["s2"], top["records"], top["s2avg"], 0 if fresh else top["n"], 0.0 if fresh else top["var2"])


def _wave(query: Query, conf: ApproxConf, now: list, path: tuple[str, str]) -> None:
    part = sample_hits(query.df.filter(query.cluster.isin(now)), query.key, query.value, query.cluster, query.order, conf, now)
    part.stats.write.parquet(path[0])
    part.hits.write.parquet(path[1])


def _cancellable(spark: SparkSession, group: str, work: Callable[[], None], over: Callable[[], bool]) -> bool:
    """Runs work as jobs of a group of their own, and cancels them once over() holds; whether work was done."""
    from pyspark import InheritableThread

    failed: list[BaseException] = []

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "one wave of clusters", interruptOnCancel=True)
        try:
            work()
        except BaseException as e:  # noqa: BLE001  it is raised below, unless it comes from the cancelling
            failed.append(e)

    thread, cancelled = InheritableThread(target=run), threading.Event()
    thread.start()
    while thread.is_alive():
        thread.join(0.05)
        if over() and thread.is_alive():  # again and again: a job may start after a first call
            cancelled.set()
            spark.sparkContext.cancelJobGroup(group)
    if failed and not cancelled.is_set():
        raise failed[0]
    return not failed


def run_waves(
    query: Query, conf: ApproxConf, per_wave: int = 5, clusters: list | None = None, watch: Callable[[Wave], bool] | None = None, most: int | None = None,
    model: TimeModel | None = None, drop: Callable[[], bool] | None = None,
) -> Progress:
    """Runs clusters wave by wave, in the seed's order, until all ran or the error of the largest key was below the target
    on more than CHECKS checks in a row (with adaptive_dropping). With adaptive_sampling each wave's ratio is planned anew.

    watch: sees each wave, and ends the run if it returns true. most: run so many clusters at most. keep_fraction holds too.
    model: the time model of planned ratios; without one it is fitted to the waves' times. drop: with hard_drop it is
    asked all the time, and once it returns true the running wave's jobs are cancelled and its clusters count as dropped.
    """
    spark, every = query.spark, clusters if clusters is not None else query.clusters()
    order = cluster_order(every, conf.seed)
    order = order[: max(1, round(conf.keep_fraction * len(order)))]
    order = order[:most] if most else order
    folder, done, ratio, calm, waves, timing = shared_path(spark, "waves"), 0, conf.ratio, 0, [], []
    hits = stats = sampled = plan = None
    given, model = model, model or TimeModel()
    while done < len(order):
        now = order[done : done + per_wave]
        began, k = time.monotonic(), len(waves)
        paths = (f"{folder}/stats/wave={k}", f"{folder}/hits/wave={k}")
        settings = conf.with_(ratio=ratio, keep_fraction=1.0)
        if conf.hard_drop and drop:
            if not _cancellable(spark, f"wave-{uuid.uuid4().hex}", lambda: _wave(query, settings, now, paths), drop):  # noqa: B023
                if waves:
                    waves[-1].status = "dropped"
                break
        else:
            _wave(query, settings, now, paths)
        done += len(now)
        hits, stats = (spark.read.parquet(f"{folder}/{x}").drop("wave") for x in ("hits", "stats"))
        sampled = Sampled(hits, stats, len(every))
        top = top_key(sampled, spark, conf)
        error = error_of(top)
        calm = calm + 1 if error < conf.target_error else 0
        stop = conf.adaptive_dropping and calm > CHECKS
        waves.append(Wave(k, done, len(every), ratio, top["key"], float(top["tau"]), float(top["half"]), float(error), top["keys"], "dropping" if stop else "running"))
        timing.append(((time.monotonic() - began) / len(now), top["records"], top["records"] / ratio))
        if conf.adaptive_sampling and done < len(order) and top["tau"]:
            model = given or fit_time(*zip(*timing, strict=True))
            plan = cheapest(known_of(top, len(every), fresh=False), 100 * conf.target_error, model, conf.confidence)
            if plan.clusters > top["n"] + 1:
                ratio = plan.ratio
        if stop or (watch and watch(waves[-1])):
            break
    if sampled is None:
        empty = Sampled(spark.createDataFrame([], "key string, cluster string, y double"), spark.createDataFrame([], "cluster string, pop_m long, smp_m long, s2 double"), len(every))
        return Progress(spark.createDataFrame([], "key string, value long, range long"), waves, empty)
    return Progress(estimate(sampled, conf), waves, sampled, plan, model)


def pilot(query: Query, conf: ApproxConf, clusters: int = 5, ratio: int = PILOT_RATIO, model: TimeModel | None = None) -> tuple[Plan, dict]:
    """A first wave at a high ratio; the plan that meets conf.target_error afresh, for the key of the largest estimate."""
    first = run_waves(query, conf.with_(ratio=ratio, adaptive_dropping=False, adaptive_sampling=False, keep_fraction=1.0), clusters, most=clusters)
    top = top_key(first.sampled, query.spark, conf)
    return cheapest(known_of(top, first.sampled.total, fresh=True), 100 * conf.target_error, model or first.model, conf.confidence), top


def pilot_then_run(query: Query, conf: ApproxConf, pilot_clusters: int = 5, per_wave: int = 5, ratio: int = PILOT_RATIO, model: TimeModel | None = None) -> Progress:
    """The pilot's ratio, then an adaptive run at it."""
    plan, _ = pilot(query, conf, pilot_clusters, ratio, model)
    found = run_waves(query, conf.with_(ratio=plan.ratio, adaptive_dropping=True), per_wave, model=model)
    found.plan = plan
    return found
