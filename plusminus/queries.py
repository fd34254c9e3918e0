"""The query catalogue over the test tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plusminus.apps import logs
from plusminus.conf import ApproxConf, Variance
from plusminus.functions import text as T
from plusminus.functions import wiki as W
from plusminus.functions.stats import bucket, short_number_column, t_quantile
from plusminus.operators import dual, minimum, render, sampling
from plusminus.operators.estimator import approx_sum, precise_sum
from plusminus.plans.planner import Known, TimeModel, predicted_error
from plusminus.plans.progressive import Query, pilot, pilot_then_run, run_waves
from plusminus.shared import shared_path
from plusminus.sources import readers


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- SQL of the estimator -----------------------------------------------------------------------------------------


#: Student's t, two-sided 95 %, to three places as tables print it (fixed values): degrees of freedom 1 to 30, then some others.
T_95 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
T_95_MORE = {40: 2.021, 60: 2.000, 80: 1.990, 100: 1.984, 120: 1.980, 1000: 1.962}


def t_values(least: int = 0, most: int = 100) -> str:
    """The quantiles that the estimator's SQL takes; t_quantiles checks them against a printed table."""
    return "(VALUES " + ", ".join(f"({df}, {t_quantile(df)!r}::DOUBLE)" for df in range(least, most + 1)) + ") AS t(df, t)"


def draw_sql(seed: int, *parts: str, modulus: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *(f"({p})::VARCHAR" for p in parts)])
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {modulus})"


def estimator_sql(source: str, cluster: str, order: str, key: str, value: str = "1", ratio: int = 1, keep: str = "TRUE", variance: Variance = Variance.PROPORTION, offset: int | None = None, unseen: bool = False, explode: str | None = None, keyed: bool = True) -> str:
    """Two-stage sampling in SQL. keep: a condition on cluster. offset None: drawn by seed 1. keyed: order is a unique integer key
    and tells the place; otherwise a record's place is its rank in its cluster. explode: an array of keys in
    place of key, of which every element of a sampled record is a hit."""
    drawn = draw_sql(1, "cluster", f"(pos // {ratio})", modulus=str(ratio)) if offset is None else str(offset % ratio)
    sampled = "TRUE" if ratio == 1 else f"pos % {ratio} = {drawn}"
    s2 = f"floor(round(coalesce(var_pop(CASE WHEN sampled THEN ({value})::DOUBLE END), 0), 6))" if variance is Variance.MEASURED else "NULL::DOUBLE"
    left = "pop_m::DOUBLE * (pop_m - smp_m)"
    term = {
        Variance.MEASURED: f"{left} / smp_m * s2",
        Variance.WORST_CASE: f"{left} / smp_m * 0.1 * y",
        Variance.PROPORTION: f"CASE WHEN smp_m > 1 AND y <= smp_m THEN {left} / (smp_m - 1) * (y / smp_m) * (1 - y / smp_m) END",
    }[variance]
    hits = f"SELECT unnest({explode}) AS key, cluster, 1 AS v FROM placed WHERE sampled" if explode else f"SELECT ({key})::VARCHAR AS key, cluster, ({value})::DOUBLE AS v FROM placed WHERE sampled"
    null_row = f"""
    UNION ALL SELECT 'NULLKEY', s1, s2hat, sw, TRUE FROM (
      SELECT pop_m::DOUBLE / smp_m AS s1, (pop_m::DOUBLE / smp_m) ** 2 AS s2hat, coalesce({term}, 0) AS sw
      FROM (SELECT *, 1.0 AS y FROM stats WHERE smp_m > 0 ORDER BY pop_m * (pop_m - smp_m) / smp_m::DOUBLE DESC, cluster LIMIT 1))""" if unseen else ""
    return f"""
WITH base AS (SELECT *, ({cluster}) AS cluster FROM ({source})),
placed0 AS (SELECT *, {order if keyed else f"row_number() OVER (PARTITION BY cluster ORDER BY {order}) - 1"} AS pos FROM base WHERE {keep}),
placed AS (SELECT *, ({sampled}) AS sampled FROM placed0),
stats AS (SELECT cluster, count(*) AS pop_m, count(*) FILTER (WHERE sampled) AS smp_m, {s2} AS s2 FROM placed GROUP BY cluster),
z AS (SELECT (SELECT count(DISTINCT cluster) FROM base)::DOUBLE AS cn_tot, count(*)::DOUBLE AS cn_smp FROM stats),
hits AS (SELECT key, cluster, sum(v) AS y FROM ({hits}) WHERE key IS NOT NULL AND v IS NOT NULL GROUP BY key, cluster),
e AS (
  SELECT key, CASE WHEN smp_m > 0 THEN pop_m::DOUBLE / smp_m * y ELSE 0 END AS yhat, CASE WHEN y > 0 THEN coalesce({term}, 0) ELSE 0 END AS w
  FROM hits JOIN stats USING (cluster)
),
m AS (SELECT key, sum(yhat) AS s1, sum(yhat * yhat) AS s2hat, sum(w) AS sw, FALSE AS unseen FROM e GROUP BY key{null_row}),
r AS (
  SELECT key, unseen, cn_tot / cn_smp * s1 AS tau, cn_tot, cn_smp, t,
    CASE WHEN cn_smp = cn_tot THEN 0 WHEN cn_smp = 1 THEN NULL
      ELSE cn_tot * (cn_tot - cn_smp) / cn_smp * greatest((s2hat - s1 * s1 / cn_smp) / (cn_smp - 1), 0) END + cn_tot / cn_smp * sw AS var
  FROM m, z JOIN {t_values()} ON t.df = cn_smp - 1
)
SELECT key, CASE WHEN unseen THEN 0 ELSE floor(round(tau, 6))::BIGINT END AS value,
  CASE WHEN var IS NULL THEN 9223372036854775807 ELSE ceil(round(t * sqrt(greatest(var, 0)), 6))::BIGINT END AS range
FROM r"""


# --- Sources made from the test tables ------------------------------------------------------------------------------

#: Access-log lines made of events, the same in both engines: agents, attacks, queries, missing fields and junk included.
LOG_SQL = """
SELECT event_id, CASE
  WHEN event_id % 53 = 0 THEN 'no log line at all'
  WHEN event_id % 47 = 0 THEN concat('h', user_id % 40, ' - - [', lpad(cast(1 + event_id % 28 AS STRING), 2, '0'), '/Nov/2013:', lpad(cast(event_id % 24 AS STRING), 2, '0'), ':06:25 +0000] "GET /x HTTP/1.1" 200 17')
  ELSE concat('h', user_id % 40, ' - - [', lpad(cast(1 + event_id % 28 AS STRING), 2, '0'), '/Nov/2013:', lpad(cast(event_id % 24 AS STRING), 2, '0'), ':06:25 ',
    CASE WHEN event_id % 2 = 0 THEN '+0000' ELSE '-0500' END, '] "',
    CASE event_id % 9 WHEN 0 THEN concat('GET /', event_type, '?id=', user_id, ' HTTP/1.1') WHEN 1 THEN 'POST /w00tw00t.at HTTP/1.1' WHEN 2 THEN 'GET /pma/index.php HTTP/1.0' ELSE concat('GET /', event_type, '/', user_id % 7, ' HTTP/1.1') END,
    '" 200 ', CASE WHEN event_id % 31 = 0 THEN '-' ELSE cast(event_id * 37 % 5000 AS STRING) END, ' "http://ref/', event_type, '"',
    CASE WHEN event_id % 5 = 0 THEN '' ELSE concat(' "agent ', user_id % 6, '"') END)
  END AS value FROM events"""
VIEW_SQL = """
SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'short line'
  WHEN event_id % 2 = 0 THEN concat('20131101 ', event_id % 24, ' ', event_type, ' Page_', user_id % 30, ' ', event_id % 900)
  ELSE concat('20131101\t', event_id % 24, '\t', event_type, '\tPage_', user_id % 30) END AS value FROM events"""
#: Wiki pages made of documents: namespaces, redirects, stubs, disambiguations, links of all kinds and pages without a text.
WIKI_SQL = """
SELECT doc_id, concat('<page><title>Doc &amp; ', doc_id, '</title>', CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 6 = 1 THEN '<ns>1</ns>' ELSE '<ns> 0 </ns>' END, '<id>', doc_id, '</id>',
  CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('<text xml:space="preserve">',
    CASE WHEN doc_id % 13 = 0 THEN '#REDIRECT [[Doc 1]]' WHEN doc_id % 13 = 1 THEN '#WEITERLEITUNG [[Doc 2]]' ELSE '' END,
    'Plain [[Doc ', doc_id % 10, '|anchor ', doc_id % 3, ']] and [[Doc ', doc_id % 7, '#part]] [[#s|x]] [[]] [[File:a|[[c]]]] [[doc ', doc_id % 10, ']] [[de:Seite ', doc_id, ']] ''''bold'''' ',
    CASE WHEN doc_id % 11 = 0 THEN '{{x-stub}}' WHEN doc_id % 11 = 1 THEN '{{Disambig}}' WHEN doc_id % 11 = 2 THEN '{{Begriffsklärung}}' ELSE '' END,
    ' &lt;ref&gt;cite&lt;/ref&gt; http://a.b/c end [[open</text>') END, '</page>') AS value FROM documents"""


def duck(sql: str) -> str:
    return sql.replace("AS STRING)", "AS VARCHAR)").replace("\\t", "' || chr(9) || '").replace("\t", "' || chr(9) || '")


def lines(spark: SparkSession, d: str, sql: str, name: str) -> DataFrame:
    """The SQL over one test table; its own braces are doubled, as spark.sql() formats its text."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {t}"), t=table(spark, d, name))


# --- Queries --------------------------------------------------------------------------------------------------------

Found = dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]
FOUND: Found = {}


def query(sql: str | None):
    def add(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return add


EVENTS = {"source": "SELECT * FROM events", "cluster": "day(ts)::BIGINT", "order": "event_id", "key": "event_type"}
ORDERS = {"source": "SELECT * FROM orders", "cluster": "o_orderkey % 50", "order": "o_orderkey", "key": "o_orderpriority"}
#: A key of lines; the few that share one are sampled together.
ITEMS = {"source": "SELECT * FROM lineitem", "cluster": "l_orderkey % 50", "order": "(l_orderkey * 16 + l_linenumber)"}


def day() -> Column:
    return F.dayofmonth("ts").cast("long")


def order_cluster() -> Column:
    return F.col("o_orderkey") % 50


def item_order() -> Column:
    return F.col("l_orderkey") * 16 + F.col("l_linenumber")


@query("SELECT event_type AS key, count(*)::BIGINT AS value FROM events GROUP BY 1")
def precise_count_by_key(s, d):
    return precise_sum(table(s, d, "events"), F.col("event_type"), F.lit(1))


@query("SELECT l_returnflag AS key, sum(l_quantity)::BIGINT AS value FROM lineitem GROUP BY 1")
def precise_sum_by_key(s, d):
    return approx_sum(table(s, d, "lineitem"), F.col("l_returnflag"), F.col("l_quantity"), F.col("l_orderkey") % 50, item_order(), ApproxConf(precise=True))


#: The first 15 of the days 1 to 30 in the order of the MD5 of "1:day" (fixed values, so that the SQL doesn't ask the library).
DAYS_KEPT = (14, 16, 15, 12, 19, 17, 26, 24, 22, 29, 3, 21, 8, 18, 28)


@query(estimator_sql(**EVENTS, ratio=7, keep=f"cluster IN {DAYS_KEPT}"))
def approx_count_by_event_type(s, d):
    """Half of the days, and one in seven of their events."""
    return approx_sum(table(s, d, "events"), F.col("event_type"), F.lit(1), day(), F.col("event_id"), ApproxConf(ratio=7, keep_fraction=0.5))


@query(estimator_sql(**ITEMS, key="'Total'", value="l_extendedprice", ratio=5, variance=Variance.MEASURED))
def approx_sum_measured_total(s, d):
    return approx_sum(table(s, d, "lineitem"), F.lit("Total"), F.col("l_extendedprice"), F.col("l_orderkey") % 50, item_order(), ApproxConf(ratio=5, variance=Variance.MEASURED))


@query(estimator_sql(**ITEMS, key="l_returnflag", value="l_quantity", ratio=5, variance=Variance.WORST_CASE))
def approx_sum_worst_case_by_flag(s, d):
    return approx_sum(table(s, d, "lineitem"), F.col("l_returnflag"), F.col("l_quantity"), F.col("l_orderkey") % 50, item_order(), ApproxConf(ratio=5, variance=Variance.WORST_CASE))


@query("SELECT o_orderpriority AS key, count(*)::BIGINT AS value, 0::BIGINT AS range FROM orders GROUP BY 1")
def approx_exact_when_full(s, d):
    return approx_sum(table(s, d, "orders"), F.col("o_orderpriority"), F.lit(1), order_cluster(), F.col("o_orderkey"), ApproxConf())


def kept_sql(n: int, share: float, seed: int = 1) -> str:
    return f"cluster IN ({', '.join(map(str, sampling.kept_clusters(list(range(n)), ApproxConf(keep_fraction=share, seed=seed))))})"


@query(estimator_sql(**ORDERS, keep=kept_sql(50, 0.4)))
def approx_drop_only(s, d):
    return approx_sum(table(s, d, "orders"), F.col("o_orderpriority"), F.lit(1), order_cluster(), F.col("o_orderkey"), ApproxConf(keep_fraction=0.4))


@query(estimator_sql(**ORDERS, ratio=10))
def approx_sample_only(s, d):
    return approx_sum(table(s, d, "orders"), F.col("o_orderpriority"), F.lit(1), order_cluster(), F.col("o_orderkey"), ApproxConf(ratio=10))


@query(estimator_sql(**ORDERS, ratio=4, keep=kept_sql(50, 0.5)))
def approx_drop_and_sample(s, d):
    return approx_sum(table(s, d, "orders"), F.col("o_orderpriority"), F.lit(1), order_cluster(), F.col("o_orderkey"), ApproxConf(ratio=4, keep_fraction=0.5))


@query(estimator_sql(**ORDERS, ratio=10, unseen=True))
def approx_null_key_bound(s, d):
    return approx_sum(table(s, d, "orders"), F.col("o_orderpriority"), F.lit(1), order_cluster(), F.col("o_orderkey"), ApproxConf(ratio=10, null_key=True))


@query(estimator_sql(**ORDERS, ratio=4, keep=kept_sql(50, 0.02)))
def approx_single_cluster(s, d):
    return approx_sum(table(s, d, "orders"), F.col("o_orderpriority"), F.lit(1), order_cluster(), F.col("o_orderkey"), ApproxConf(ratio=4, keep_fraction=0.02))


@query(f"""WITH p AS (SELECT event_id, day(ts)::BIGINT AS cluster, row_number() OVER (PARTITION BY day(ts) ORDER BY event_id) - 1 AS pos FROM events)
SELECT event_id, cluster, pos FROM p WHERE pos % 7 = {draw_sql(1, "cluster", "pos // 7", modulus="7")}""")
def block_sample_rows(s, d):
    placed = sampling.block_sample(table(s, d, "events"), day(), [F.col("event_id")], ApproxConf(ratio=7))
    return placed.filter("sampled").select("event_id", "cluster", F.col("pos").cast("long").alias("pos"))


@query(f"""SELECT o_orderkey, o_orderkey % 50 AS cluster FROM orders WHERE o_orderkey % 8 = {draw_sql(1, "o_orderkey % 50", "o_orderkey // 8", modulus="8")}""")
def keyed_sample_rows(s, d):
    return sampling.keyed_sample(table(s, d, "orders"), order_cluster(), F.col("o_orderkey"), ApproxConf(ratio=8)).filter("sampled").select("o_orderkey", "cluster")


@query("SELECT event_id, cluster, pos FROM (SELECT event_id, day(ts)::BIGINT AS cluster, row_number() OVER (PARTITION BY day(ts) ORDER BY event_id) - 1 AS pos FROM events) WHERE pos < 5")
def line_cap_rows(s, d):
    return sampling.line_cap(table(s, d, "events"), day(), [F.col("event_id")], 5).select("event_id", "cluster", F.col("pos").cast("long").alias("pos"))


@query(f"""WITH p AS (SELECT day(ts)::BIGINT AS cluster, row_number() OVER (PARTITION BY day(ts) ORDER BY event_id) - 1 AS pos FROM events)
SELECT cluster, count(*)::BIGINT AS pop_m, count(*) FILTER (WHERE pos % 7 = {draw_sql(1, "cluster", "pos // 7", modulus="7")})::BIGINT AS smp_m FROM p GROUP BY 1""")
def cluster_stats(s, d):
    placed = sampling.block_sample(table(s, d, "events"), day(), [F.col("event_id")], ApproxConf(ratio=7))
    return sampling.cluster_stats(placed).select("cluster", "pop_m", "smp_m")


@query("SELECT l_orderkey % 50 AS cluster, count(*)::BIGINT AS pop_m, floor(round(var_pop(l_quantity), 6))::BIGINT AS s2 FROM lineitem GROUP BY 1")
def approx_measured_stats(s, d):
    placed = sampling.keyed_sample(table(s, d, "lineitem"), F.col("l_orderkey") % 50, item_order(), ApproxConf())
    return sampling.cluster_stats(placed, F.col("l_quantity")).select("cluster", "pop_m", F.col("s2").cast("long").alias("s2"))


@query(f"""WITH j AS (SELECT o_orderkey, o_orderkey % 50 AS cluster, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT * FROM ({estimator_sql("SELECT * FROM j", "cluster", "o_orderkey", "n_name", ratio=6).replace("WITH base AS (SELECT *, (cluster) AS cluster", "WITH base AS (SELECT *")})""")
def approx_count_by_nation(s, d):
    """A fact table joined to its dimensions before sampling; each fact stays in one cluster."""
    rows = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return approx_sum(rows, F.col("n_name"), F.lit(1), order_cluster(), F.col("o_orderkey"), ApproxConf(ratio=6))


# Access logs, page views


LOG_RX = T.LOG_PATTERN.replace("'", "''")
DUCK_LOG = duck(LOG_SQL)
LOG_FIELDS = f"""SELECT *, regexp_matches(value, '{LOG_RX}') AS parsed, {", ".join(f"CASE WHEN regexp_matches(value, '{LOG_RX}') THEN regexp_extract(value, '{LOG_RX}', {k}) END AS {n}" for n, k in (("host", 1), ("datetime", 3), ("request", 4), ("response", 5), ("bytes", 6), ("referer", 7), ("agent0", 8)))} FROM ({DUCK_LOG})"""
LOG_READY = f"""SELECT *, CASE WHEN agent0 = '' THEN '-' ELSE agent0 END AS user_agent, try_cast(bytes AS BIGINT) AS size,
  CASE WHEN instr(request, '?') > 1 THEN split_part(request, '?', 1) ELSE request END AS page FROM ({LOG_FIELDS})"""
ATTACK_SQL = "(" + " OR ".join(f"starts_with(split_part(request, ' ', 2), '{p}')" for p in T.ATTACK_PREFIXES) + ")"


def log_lines(s, d) -> DataFrame:
    return lines(s, d, LOG_SQL, "events")


@query(f"SELECT event_id, parsed, host, datetime, request, response, bytes, referer, user_agent FROM ({LOG_READY})")
def log_parse(s, d):
    return readers.access_log(log_lines(s, d)).select("event_id", "parsed", "host", "datetime", "request", "response", "bytes", "referer", "user_agent")


def _log_sql(key: str, value: str = "1", variance: Variance = Variance.PROPORTION) -> str:
    return estimator_sql(LOG_READY, "event_id % 40", "event_id", key, value, ratio=4, variance=variance)


def _log(task: str):
    return lambda s, d: logs.access_log(task, log_lines(s, d), F.col("event_id") % 40, F.col("event_id"), ApproxConf(ratio=4))


WEEK_SQL = "strftime(timezone('UTC', strptime(datetime, '%d/%b/%Y:%H:%M:%S %z')), '%a %H')"
for _task, _sql in {
    "hack": _log_sql(f"CASE WHEN {ATTACK_SQL} THEN host END"),
    "host": _log_sql("host"),
    "dateweek": _log_sql(WEEK_SQL),
    "size": _log_sql("size // 100 * 100"),
    "totalsize": _log_sql("CASE WHEN size IS NOT NULL THEN 'Total' END", "size", Variance.MEASURED),
    "pagesize": _log_sql("CASE WHEN size IS NOT NULL THEN page END", "size", Variance.WORST_CASE),
    "page": _log_sql("page"),
    "browser": _log_sql("user_agent"),
}.items():
    FOUND[f"log_{_task}"] = (_log(_task), _sql)

DUCK_VIEW = duck(VIEW_SQL)
VIEW_READY = f"""SELECT *, len(f) >= 4 AS parsed, CASE WHEN len(f) >= 4 THEN f[1] END AS date, CASE WHEN len(f) >= 4 THEN f[2] END AS hour, CASE WHEN len(f) >= 4 THEN f[3] END AS project, CASE WHEN len(f) >= 4 THEN f[4] END AS page, try_cast(f[5] AS BIGINT) AS size
FROM (SELECT *, string_split(rtrim(replace(value, chr(9), ' ')), ' ') AS f FROM ({DUCK_VIEW}))"""


def view_lines(s, d) -> DataFrame:
    return lines(s, d, VIEW_SQL, "events")


@query(f"SELECT event_id, parsed, date, hour, project, page, size FROM ({VIEW_READY})")
def views_parse(s, d):
    return readers.page_views(view_lines(s, d)).select("event_id", "parsed", "date", "hour", "project", "page", "size")


@query(estimator_sql(VIEW_READY, "event_id % 40", "event_id", "project", ratio=4))
def views_project(s, d):
    return logs.page_views("project", view_lines(s, d), F.col("event_id") % 40, F.col("event_id"), ApproxConf(ratio=4))


@query(estimator_sql(VIEW_READY, "event_id % 40", "event_id", "project || ' ' || page", ratio=4))
def views_page(s, d):
    return logs.page_views("page", view_lines(s, d), F.col("event_id") % 40, F.col("event_id"), ApproxConf(ratio=4))


# Pages and wiki


@query(estimator_sql("SELECT page_id, html AS value FROM pages", "page_id % 20", "page_id", "strlen(value) // 100 * 100", ratio=2))
def length_histogram(s, d):
    pages = table(s, d, "pages").select("page_id", F.col("html").alias("value"))
    return logs.page_lengths(pages, F.col("page_id") % 20, F.col("page_id"), ApproxConf(ratio=2))


DUCK_WIKI = duck(WIKI_SQL)
LINKS_SQL = r"list_filter(list_transform(list_filter(regexp_extract_all(value, '(?s)\[\[(.*?)\]\]', 1), lambda x: x <> '' AND NOT contains(x, ':')), lambda x: {'anchor': CASE WHEN contains(x, '|') THEN substr(x, instr(x, '|') + 1) ELSE split_part(split_part(x, '|', 1), '#', 1) END, 'target': split_part(split_part(x, '|', 1), '#', 1)}), lambda x: x.target <> '')"


def wiki_text(s, d) -> DataFrame:
    return lines(s, d, WIKI_SQL, "documents")


@query(f"""SELECT doc_id, regexp_extract(value, '(?s)<id>(.*?)</id>', 1) AS docid, replace(regexp_extract(value, '(?s)<title>(.*?)</title>', 1), '&amp;', '&') AS title,
CASE WHEN contains(value, '</text>') THEN split_part(split_part(value, '<text xml:space="preserve">', 2), '</text>', 1) END AS markup FROM ({DUCK_WIKI})""")
def wiki_pages(s, d):
    return readers.wiki_pages(wiki_text(s, d)).select("doc_id", "docid", "title", "markup")


@query(f"SELECT doc_id, l.anchor AS anchor, l.target AS target FROM (SELECT doc_id, unnest({LINKS_SQL}) AS l FROM ({DUCK_WIKI}))")
def wiki_links(s, d):
    rows = wiki_text(s, d).select("doc_id", F.explode(W.links(F.col("value"))).alias("l"))
    return rows.select("doc_id", F.col("l.anchor").alias("anchor"), F.col("l.target").alias("target"))


@query(estimator_sql(DUCK_WIKI, "doc_id % 25", "doc_id", "", ratio=3, explode=f"list_transform(list_distinct(list_transform({LINKS_SQL}, lambda x: x.target)), lambda t: replace(lower(t), ' ', '_'))"))
def wiki_inlinks(s, d):
    return logs.in_links(wiki_text(s, d), F.col("doc_id") % 25, F.col("doc_id"), ApproxConf(ratio=3))


MARKUP_SQL = """CASE WHEN contains(value, '</text>') THEN split_part(split_part(value, '<text xml:space="preserve">', 2), '</text>', 1) END"""


@query(f"""SELECT doc_id, coalesce(trim(nullif(regexp_extract(value, '(?s)<ns>(.*?)</ns>', 1), '')), '0') = '0' AS is_article,
coalesce(starts_with({MARKUP_SQL}, '#REDIRECT') OR starts_with({MARKUP_SQL}, '#redirect'), FALSE) AS is_redirect,
coalesce(starts_with({MARKUP_SQL}, '#REDIRECT') OR starts_with({MARKUP_SQL}, '#WEITERLEITUNG'), FALSE) AS is_redirect_de,
contains(value, 'stub}}}}') AS is_stub, regexp_matches(value, '(?i)\\{{\\{{disambig\\w*\\}}\\}}') AS is_disambig, regexp_matches(value, '(?i)\\{{\\{{begriffsklärung\\}}\\}}') AS is_disambig_de,
NOT contains(value, '</text>') AS is_empty FROM ({DUCK_WIKI})""")
def wiki_flags(s, d):
    v = F.col("value")
    return wiki_text(s, d).select("doc_id", W.is_article(v).alias("is_article"), W.is_redirect(v).alias("is_redirect"), W.is_redirect(v, "DE").alias("is_redirect_de"), W.is_stub(v).alias("is_stub"), W.is_disambiguation(v).alias("is_disambig"), W.is_disambiguation(v, "de").alias("is_disambig_de"), W.is_empty(v).alias("is_empty"))


@query(rf"SELECT doc_id, nullif(regexp_extract(value, '(?s)\[\[de:(.*?)\]\]', 1), '') AS de, NULL::VARCHAR AS fr FROM ({DUCK_WIKI})")
def wiki_interlang(s, d):
    v = F.col("value")
    return wiki_text(s, d).select("doc_id", W.interlanguage_link(v, "de").alias("de"), W.interlanguage_link(v, "fr").alias("fr"))


def _content_sql() -> str:
    x = MARKUP_SQL
    x = rf"regexp_replace({x}, '\[\[[a-z\-]+:[^\]]+\]\]', '', 'g')"
    x = rf"regexp_replace({x}, '\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]', '\1', 'g')"
    x = f"regexp_replace({x}, '''{{2,}}', '', 'g')"
    for _ in range(2):
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            x = f"replace({x}, '{a}', '{b}')"
    for p, to in ((r"(?s)<ref>.*?</ref>", ""), (r"http://[^\s\]]+", ""), (r"(?s)\{\{.*?\}\}", ""), (r"<[^>]+>", " ")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return f"SELECT doc_id, {x} AS content FROM ({DUCK_WIKI})"


@query(_content_sql())
def wiki_content(s, d):
    return wiki_text(s, d).select("doc_id", W.content(F.col("value")).alias("content"))


@query(estimator_sql("SELECT page_id, html AS value FROM pages", "page_id % 20", "page_id", "", ratio=2, explode="""list_transform(list_distinct(regexp_extract_all(value, 'href="([^"]*)"', 1)), lambda t: replace(lower(t), ' ', '_'))"""))
def html_inlinks(s, d):
    pages = table(s, d, "pages").select("page_id", F.col("html").alias("value"))
    return logs.in_links(pages, F.col("page_id") % 20, F.col("page_id"), ApproxConf(ratio=2), F.regexp_extract_all("value", F.lit('href="([^"]*)"'), F.lit(1)))


# Histograms, minima, rendering, dual functions


@query("SELECT floor(o_totalprice / 100)::BIGINT * 100 AS bucket, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def histogram_100(s, d):
    return table(s, d, "orders").groupBy(bucket(F.col("o_totalprice")).alias("bucket")).agg(F.count("*").alias("n"))


def _min_sql(source: str, value: str, grp: str) -> str:
    return f"""WITH b AS (SELECT ({grp})::VARCHAR AS grp, ({value})::DOUBLE AS v FROM {source}), m AS (SELECT grp, avg(v) AS mean, count(*)::DOUBLE AS n, min(v) AS least FROM b GROUP BY 1),
s AS (SELECT grp, any_value(n) AS n, any_value(least) AS least, sum(abs(v - mean)) AS gaps, sum((v - mean) * (v - mean)) AS squares FROM b JOIN m USING (grp) GROUP BY 1),
e AS (SELECT *, 1.96 * sqrt(squares / nullif(n - 1, 0)) / sqrt(n) AS e FROM s), p AS (SELECT *, sqrt((squares + 2 * e * gaps + n * e * e) / nullif(n - 1, 0)) AS sd FROM e),
r AS (SELECT *, CASE WHEN n <= 1 THEN 100 ELSE least(sqrt(120.0 * sd ** 3 * ((1 - 0.95) ** (-1 / n) - 1)), 100) END AS error FROM p)
SELECT grp, n::BIGINT AS n, least, round(error, 4) AS error_pct, round(least * (1 - error / 100), 4) AS low FROM r"""


@query(_min_sql("part", "p_retailprice", "p_partkey % 40"))
def min_bound(s, d):
    return minimum.minimum_rows(table(s, d, "part"), F.col("p_retailprice"), F.col("p_partkey") % 40)


@query("SELECT (p_partkey % 40)::VARCHAR AS grp, row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey)::INTEGER AS place, p_retailprice AS v, min(p_retailprice) OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS least FROM part")
def min_progress(s, d):
    return minimum.running_minimum(table(s, d, "part"), F.col("p_retailprice"), F.col("p_partkey") % 40, [F.col("p_partkey")])


@query(f"""WITH r AS (SELECT p_partkey, p_retailprice AS v, 'x f=' || p_retailprice || 'M part ' || p_partkey AS value FROM part),
w AS ({_min_sql("r", "v", "'all'")}), b AS (SELECT value FROM r ORDER BY v, value LIMIT 1)
SELECT 'Final result' AS key, value, least, n FROM w, b""")
def min_search(s, d):
    rows = table(s, d, "part").select(F.concat(F.lit("x f="), F.col("p_retailprice"), F.lit("M part "), F.col("p_partkey")).alias("value"))
    bound, text, _ = minimum.search_minimum(rows, F.col("value"))
    return s.createDataFrame([("Final result", text.partition("]:  ")[2], bound.least, bound.n)], "key string, value string, least double, n long")


@query(f"SELECT key, CASE WHEN value = 0 THEN 0 ELSE range / value::DOUBLE END AS error FROM ({estimator_sql(**ORDERS, ratio=10)})")
def error_of_value(s, d):
    return approx_sample_only(s, d).select("key", render.relative_error(F.col("value"), F.col("range")).alias("error"))


@query(f"SELECT key || chr(9) || value || '+/-' || range AS value FROM ({estimator_sql(**ORDERS, ratio=10)})")
def render_value(s, d):
    return render.as_lines(approx_sample_only(s, d))


@query(f"SELECT doc_id, {draw_sql(1, 'doc_id % 25', modulus='1000000')} < 400000 AS approximate, CASE WHEN {draw_sql(1, 'doc_id % 25', modulus='1000000')} < 400000 THEN length(text) // 6 ELSE len(list_filter(string_split(text, ' '), lambda x: x <> '')) END AS words FROM documents")
def dual_map(s, d):
    exact = F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("long")
    rough = F.floor(F.length("text") / 6).cast("long")
    return dual.dual_map(table(s, d, "documents"), dual.DualExpr(exact, rough), F.lit(None).cast("long"), F.col("doc_id") % 25, 0.4, name="words").select("doc_id", "approximate", "words")


@query(f"SELECT lang AS key, {draw_sql(1, 'lang', modulus='1000000')} < 500000 AS approximate, CASE WHEN {draw_sql(1, 'lang', modulus='1000000')} < 500000 THEN max(n_chars) ELSE sum(n_chars)::BIGINT END AS value FROM documents GROUP BY lang")
def dual_reduce(s, d):
    return dual.dual_reduce(table(s, d, "documents"), F.col("lang"), F.sum("n_chars"), F.max("n_chars"), 0.5)


@query("SELECT c, CASE WHEN v > 1000000 THEN printf('%.1fM', v / 1000000.0) WHEN v > 1000 THEN printf('%.1fK', v / 1000.0) ELSE v::BIGINT::VARCHAR END AS text FROM (SELECT c_custkey AS c, floor(abs(c_acctbal) * abs(c_acctbal))::DOUBLE AS v FROM customer)")
def short_numbers(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("c"), F.floor(F.abs("c_acctbal") * F.abs("c_acctbal")).cast("double").alias("v"))
    return rows.select("c", short_number_column(F.col("v")).alias("text"))


_PRINTED = {**{i + 1: t for i, t in enumerate(T_95)}, **T_95_MORE}


@query(f"SELECT df, t FROM (VALUES {', '.join(f'({df}, {t!r}::DOUBLE)' for df, t in _PRINTED.items())}) AS v(df, t)")
def t_quantiles(s, d):
    return s.createDataFrame([(df, round(t_quantile(df), 3)) for df in _PRINTED], "df int, t double")


# Planner, pilot, progressive runs: values depend on waves and timing, so only some have SQL.

_KNOWN = Known(n_all=100, tau=1e6, s2=2.5e6, records=5000, s2avg=0.2)


def _planner_sql() -> str:
    cells = ", ".join(f"({n}, {r}, {t_quantile(n - 1)!r}::DOUBLE)" for n in (2, 5, 10, 50, 100) for r in (1, 10, 100, 1000))
    return f"SELECT n, r, round(100 * t * sqrt(100.0 * (100 - n) * 2.5e6 / n + 100.0 / n * (n * 5000.0 * (r - 1) * 0.2)) / 1e6, 9) AS error_pct FROM (VALUES {cells}) AS v(n, r, t)"


@query(_planner_sql())
def planner_grid(s, d):
    rows = [(n, r, round(predicted_error(_KNOWN, n, r), 9)) for n in (2, 5, 10, 50, 100) for r in (1, 10, 100, 1000)]
    return s.createDataFrame(rows, "n int, r int, error_pct double")


@query("SELECT r, round(3 + 8e-6 * 1e6 + 8e-6 * 1e6 / r, 9)::DOUBLE AS seconds FROM (VALUES (1), (10), (100)) AS v(r)")
def time_model(s, d):
    return s.createDataFrame([(r, round(TimeModel().seconds(1e6, r), 9)) for r in (1, 10, 100)], "r int, seconds double")


def events_query(s, d) -> Query:
    return Query(table(s, d, "events"), F.col("event_type"), F.lit(1), day(), F.col("event_id"))


@query(estimator_sql(**EVENTS, ratio=5))
def progressive_waves(s, d):
    """All waves: the union of their states gives what one batch gives."""
    return run_waves(events_query(s, d), ApproxConf(ratio=5), per_wave=10).result


#: The days 1 to 30 in the order in which they run (fixed values, as above).
DAY_ORDER = (14, 16, 15, 12, 19, 17, 26, 24, 22, 29, 3, 21, 8, 18, 28, 9, 30, 6, 7, 23, 11, 27, 1, 13, 5, 2, 10, 25, 20, 4)


def _wave_sql(wave: int, per_wave: int, ratio: int) -> str:
    """The top key's row after so many waves; nothing stops the waves of this query."""
    done = min(per_wave * (wave + 1), 30)
    rows = estimator_sql(**EVENTS, ratio=ratio, keep=f"cluster IN ({', '.join(map(str, DAY_ORDER[:done]))})").replace("floor(round(tau, 6))::BIGINT", "tau").replace("ceil(round(t * sqrt(greatest(var, 0)), 6))::BIGINT", "t * sqrt(greatest(var, 0))")
    return f"(SELECT {wave} AS wave, {done} AS clusters_done, 30 AS clusters_total, {ratio} AS ratio, key AS top_key, round(value, 4) AS value, round(range, 4) AS half, (SELECT count(*) FROM ({rows}))::BIGINT AS keys FROM ({rows}) ORDER BY value DESC, key DESC LIMIT 1)"


@query(" UNION ALL ".join(_wave_sql(w, 6, 2) for w in range(5)))
def progress_log(s, d):
    found = run_waves(events_query(s, d), ApproxConf(ratio=2), per_wave=6).progress(s)
    return found.select("wave", "clusters_done", "clusters_total", "ratio", "top_key", F.round("value", 4).alias("value"), F.round("half", 4).alias("half"), "keys")


#: A target that is always met: the waves end after the check that makes it more than two in a row, so after three.
@query(estimator_sql(**EVENTS, ratio=2, keep=f"cluster IN ({', '.join(map(str, DAY_ORDER[:12]))})"))
def adaptive_dropping_run(s, d):
    return run_waves(events_query(s, d), ApproxConf(ratio=2, adaptive_dropping=True, target_error=1e9), per_wave=4).result


#: A target that is never met: every day runs.
@query(estimator_sql(**EVENTS, ratio=2))
def adaptive_run(s, d):
    return run_waves(events_query(s, d), ApproxConf(ratio=2, adaptive_dropping=True, target_error=0.0), per_wave=6).result


@query(None)
def adaptive_sampling_run(s, d):
    conf = ApproxConf(ratio=2, adaptive_dropping=True, adaptive_sampling=True, target_error=0.1)
    return run_waves(events_query(s, d), conf, per_wave=6, model=TimeModel()).result


@query(_wave_sql(0, 8, 10))
def pilot_wave(s, d):
    """What a pilot knows: the largest key of its first wave."""
    found = run_waves(events_query(s, d), ApproxConf(ratio=10), per_wave=8, most=8).progress(s)
    return found.select("wave", "clusters_done", "clusters_total", "ratio", "top_key", F.round("value", 4).alias("value"), F.round("half", 4).alias("half"), "keys")


@query(None)
def pilot_plan(s, d):
    plan, top = pilot(events_query(s, d), ApproxConf(target_error=0.1), clusters=8, ratio=10, model=TimeModel())
    return s.createDataFrame([(plan.clusters, plan.ratio, plan.reachable, top["key"])], "clusters int, ratio int, reachable boolean, top_key string")


@query(None)
def pilot_then_adaptive(s, d):
    return pilot_then_run(events_query(s, d), ApproxConf(target_error=0.2), pilot_clusters=6, per_wave=6, model=TimeModel()).result


# Text, XML and compressed files, written from the test tables and read by the sources.


def _written(df: DataFrame, what: str, **options) -> str:
    path = shared_path(df.sparkSession, what)
    df.write.options(**options).text(path)
    return path


@query(f"SELECT value, regexp_matches(value, '{LOG_RX}') AS parsed FROM ({DUCK_LOG})")
def source_gzip_log(s, d):
    path = _written(log_lines(s, d).select("value").repartition(3), "log", compression="gzip")
    return readers.access_log(readers.lines(s, path)).select("value", "parsed")


@query(f"SELECT regexp_extract(value, '(?s)<id>(.*?)</id>', 1) AS docid, replace(regexp_extract(value, '(?s)<title>(.*?)</title>', 1), '&amp;', '&') AS title, NOT contains(value, '</text>') AS is_empty FROM ({DUCK_WIKI})")
def source_wiki_dump(s, d):
    """Pages between other things, in plain text files."""
    path = _written(wiki_text(s, d).select(F.concat(F.lit("<mediawiki>\n  "), "value", F.lit("\n</mediawiki>")).alias("value")).repartition(3), "dump")
    return readers.wiki_dump(s, path).select("docid", "title", "is_empty")


@query(f"""WITH v AS ({estimator_sql("SELECT * FROM events", "0", "event_id", "event_type")}) SELECT key, value, 0::BIGINT AS range FROM v""")
def scan_count_unsampled(s, d):
    """Partitions of the scan as clusters, all of them and all their records."""
    return approx_sum(table(s, d, "events"), F.col("event_type"), F.lit(1), None)


#: Texts of pages in each language, and whether they are a redirect or a disambiguation page (fixed values).
MARKED_PAGES = (
    ("sv", "#OMDIRIGERING [[A]]", True, False), ("sv", "x {{förgrening}}", False, True), ("es", "#REDIRECT [[A]]", True, False),
    ("es", "x {{desambiguación}}", False, True), ("cs", "#redirect [[A]]", True, False), ("cs", "x {{Rozcestník}}", False, True),
    ("ar", "#REDIRECT [[A]]", True, False), ("ar", "x {{توضيح}}", False, True), ("tr", "#REDIRECT [[A]]", True, False),
    ("tr", "x {{anlam ayrımı}}", False, True), ("zh", "#REDIRECT [[A]]", True, False), ("zh", "x {{disambig|Cat=A}}", False, True),
    ("de", "#Weiterleitung [[A]]", True, False), ("en", "#OMDIRIGERING [[A]]", False, False), ("zh", "x {{disambig}}", False, False),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{t}', {r}, {d})" for g, t, r, d in MARKED_PAGES) + ") AS v(lang, text, is_redirect, is_disambig)")
def wiki_languages(s, d):
    rows = s.createDataFrame([r[:2] for r in MARKED_PAGES], "lang string, text string")
    page = F.concat(F.lit('<page><text xml:space="preserve">'), "text", F.lit("</text></page>"))
    mark = lambda test: F.coalesce(*(F.when(F.col("lang") == g, test(page, g)) for g in W.LANGUAGES), F.lit(False))
    return rows.select("lang", "text", mark(W.is_redirect).alias("is_redirect"), mark(W.is_disambiguation).alias("is_disambig"))


@query(estimator_sql("SELECT * FROM labels", "doc_id % 20", "doc_id", "CASE WHEN toxic = 1 THEN 'toxic' END", ratio=2))
def approx_toxic_count(s, d):
    """A filter as a key that is null where it doesn't hold, so that the population stays whole."""
    return approx_sum(table(s, d, "labels"), F.when(F.col("toxic") == 1, "toxic"), F.lit(1), F.col("doc_id") % 20, F.col("doc_id"), ApproxConf(ratio=2))


@query(estimator_sql("SELECT * FROM conversations", "conv_id % 20", "conv_id, turn", "role", ratio=3, keyed=False))
def approx_count_by_role(s, d):
    return approx_sum(table(s, d, "conversations"), F.col("role"), F.lit(1), F.col("conv_id") % 20, [F.col("conv_id"), F.col("turn")], ApproxConf(ratio=3))


@query(estimator_sql("SELECT * FROM embeddings", "vec_id % 20", "vec_id", "label", ratio=3))
def approx_count_by_label(s, d):
    return approx_sum(table(s, d, "embeddings"), F.col("label"), F.lit(1), F.col("vec_id") % 20, F.col("vec_id"), ApproxConf(ratio=3))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
