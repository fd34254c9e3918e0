"""Ready-made queries: access logs (8 tasks), page views (2), page lengths, in-links. Each is precise or approximate by its conf.

Each takes records with a column `value`, a cluster expression and an order (a unique integer key, or columns; none of them
to sample partitions as they are read); a record that can't be parsed still counts as processed, it only has no key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plusminus.conf import ApproxConf, Variance
from plusminus.functions import text as T
from plusminus.functions import wiki as W
from plusminus.functions.stats import bucket
from plusminus.operators.estimator import approx_sum, precise_sum

TOTAL = "Total"


def log_tasks(line: Column) -> dict[str, tuple[Column, Column, Variance]]:
    """Of each task the key, the value and how its variance within clusters is known."""
    f, one = T.parse_log(line), F.lit(1)
    size = T.byte_count(f["bytes"])
    page = T.without_query(f["request"])
    sized = lambda key: F.when(f["parsed"] & size.isNotNull(), key)
    return {
        "hack": (F.when(T.is_attack(f["request"]), f["host"]), one, Variance.PROPORTION),
        "host": (f["host"], one, Variance.PROPORTION),
        "dateweek": (T.week_hour(f["datetime"]), one, Variance.PROPORTION),
        "size": (sized(bucket(size).cast("string")), one, Variance.PROPORTION),
        "totalsize": (sized(F.lit(TOTAL)), size, Variance.MEASURED),
        "pagesize": (sized(page), size, Variance.WORST_CASE),
        "page": (page, one, Variance.PROPORTION),
        "browser": (f["user_agent"], one, Variance.PROPORTION),
    }


def view_tasks(line: Column) -> dict[str, tuple[Column, Column, Variance]]:
    f = T.parse_view(line)
    return {
        "project": (f["project"], F.lit(1), Variance.PROPORTION),
        "page": (F.when(f["parsed"], F.concat_ws(" ", f["project"], f["page"])), F.lit(1), Variance.PROPORTION),
    }


def run_task(tasks: Callable[[Column], dict], name: str, df: DataFrame, cluster: Column | None, order: Column | list[Column] | None, conf: ApproxConf, clusters: list | None = None, default: str | None = None) -> DataFrame:
    """A task by its name, in either case; an unknown one is an error unless there is a default."""
    found = tasks(F.col("value"))
    if name.lower() not in found and default is None:
        raise ValueError(f"no task {name}; there are {', '.join(found)}")
    key, value, variance = found.get(name.lower(), found.get(default))
    return approx_sum(df, key, value, cluster, order, conf.with_(variance=variance), clusters)


def access_log(task: str, df: DataFrame, cluster: Column | None, order: Column | list[Column] | None, conf: ApproxConf, clusters: list | None = None) -> DataFrame:
    return run_task(log_tasks, task, df, cluster, order, conf, clusters)


def page_views(task: str, df: DataFrame, cluster: Column | None, order: Column | list[Column] | None, conf: ApproxConf, clusters: list | None = None) -> DataFrame:
    """Without a known task the key is project and page."""
    return run_task(view_tasks, task, df, cluster, order, conf, clusters, "page")


def page_lengths(df: DataFrame, cluster: Column | None, order: Column | list[Column] | None, conf: ApproxConf, clusters: list | None = None) -> DataFrame:
    """Pages by their length in bytes, in buckets of 100."""
    return approx_sum(df, bucket(F.octet_length("value")).cast("string"), F.lit(1), cluster, order, conf, clusters)


def in_links(df: DataFrame, cluster: Column | None, order: Column | list[Column] | None, conf: ApproxConf, targets: Column | None = None) -> DataFrame:
    """Pages that link to each target: targets are distinct in a page as they are written, and then normalised, so two
    spellings of one target in a page count twice."""
    targets = W.link_targets(F.col("value")) if targets is None else targets
    if conf.precise:
        return precise_sum(df.withColumn("target", F.explode(F.array_distinct(targets))), W.normalized_target(F.col("target")), F.lit(1))
    return approx_sum(df, F.transform(F.array_distinct(targets), W.normalized_target), F.lit(1), cluster, order, conf)
