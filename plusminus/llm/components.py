"""Connected components of a link table by alternating large-star and small-star steps.

Each round is two aggregations and two joins over the links, written to the shared folder. A node with
very many links is aggregated before the shuffle. What was aggregated is written too, so that both sides of the
join back are plain shuffles, of which Spark splits a partition that one node's links make too large. Nothing
is collected but a count and a checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plusminus.llm.common import saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = saved(least, "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    links = saved(links, "stars")
    least = saved(links.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = links.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(u, root) for each node that has a link; root is the least node of its component and has no row itself.

    links: columns u and v of one orderable type. Loops and repeated links do no harm; links with a null are
    dropped, as a null is no node. An empty table gives an empty one.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = saved(ordered.filter("u is not null and v is not null and u != v").distinct(), "links")
    state = _state(now)
    while state[0]:
        now = saved(_small_star(_large_star(now)).filter("u != v").distinct(), "links")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select("u", F.col("v").alias("root"))
