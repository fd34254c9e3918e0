"""Planner, waves, pilot, minimum, streaming and sources."""

import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from plusminus.conf import ApproxConf
from plusminus.functions import text as T
from plusminus.functions import wiki as W
from plusminus.operators.estimator import approx_count
from plusminus.operators.minimum import approx_minimum, confidence_of, corrected_spread, error_bound, search_minimum
from plusminus.plans.planner import MOST_RATIO, Known, TimeModel, cheapest, fit_time, largest_ratio, predicted_error, ratio_for_all
from plusminus.plans.progressive import CHECKS, Query, pilot, run_waves
from plusminus.sources import readers
from plusminus.streaming.online import stream_aggregate

KNOWN = Known(n_all=100, tau=1e5, s2=1e6, records=10_000, s2avg=0.2)


def test_plans_are_feasible_and_no_slower_than_others():
    model = TimeModel()
    for target in (1, 2, 5, 10, 20):
        plan = cheapest(KNOWN, target, model)
        assert plan.reachable and predicted_error(KNOWN, plan.clusters, plan.ratio) <= target
        for n in range(plan.clusters, 101, 7):
            if ratio := largest_ratio(KNOWN, n, target):
                assert plan.seconds <= n * model.seconds(KNOWN.records, ratio) + 1e-9
    assert cheapest(KNOWN, 20, model).seconds <= cheapest(KNOWN, 1, model).seconds


def test_planner_edges():
    assert largest_ratio(KNOWN, 100, 1e-9) == 1  # all at ratio 1 is exact
    assert not cheapest(Known(10, 0.0, 1.0, 10, 0.1), 1, TimeModel()).reachable
    loose = Known(100, 1e5, 6.5e7, 10_000, 0.0)
    compat = cheapest(loose, 20, TimeModel(), compat=True)
    assert predicted_error(loose, compat.clusters, compat.ratio) > 20 or compat.ratio > 1  # the literal start is an infeasible number
    assert ratio_for_all(Known(100, 1e5, 1.0, 10, 0.0), 0.1) == MOST_RATIO and 1 <= ratio_for_all(KNOWN, 0.01) <= MOST_RATIO


def test_time_model_recovers_its_coefficients():
    rng = random.Random(2)
    read = [rng.uniform(1e5, 1e6) for _ in range(20)]
    done = [m / rng.choice([2, 5, 10]) for m in read]
    model = fit_time([4 + 1e-5 * a + 2e-5 * b for a, b in zip(read, done)], read, done)
    assert (round(model.base, 6), round(model.per_read, 9), round(model.per_processed, 9)) == (4, 1e-5, 2e-5)
    few = fit_time([9.0], [100.0], [100.0])  # it processed all it read, so it counts as half the time for one record
    assert few.base == 3 and few.per_read == few.per_processed == pytest.approx(1.5 / 101)


def events(spark, n=3000, clusters=30):
    rng = random.Random(3)
    return spark.createDataFrame([(i, i % clusters, rng.choice("aab")) for i in range(n)], "id long, c int, k string")


def test_waves_add_up_to_the_batch_and_stop(spark):
    df = events(spark).cache()
    query = Query(df, F.col("k"), F.lit(1), F.col("c"), [F.col("id")])
    whole = run_waves(query, ApproxConf(ratio=3), per_wave=10)
    batch = approx_count(df, F.col("k"), F.col("c"), [F.col("id")], ApproxConf(ratio=3))
    assert sorted(whole.result.collect()) == sorted(batch.collect()) and len(whole.waves) == 3
    calm = run_waves(query, ApproxConf(adaptive_dropping=True, target_error=0.5), per_wave=4)
    assert calm.waves[-1].status == "dropping" and len(calm.waves) == CHECKS + 1 + (calm.waves[0].error >= 0.5)
    assert calm.progress(spark).count() == len(calm.waves)
    watched = run_waves(query, ApproxConf(), per_wave=4, watch=lambda w: True)
    assert len(watched.waves) == 1
    plan, top = pilot(query, ApproxConf(target_error=0.2), clusters=6, ratio=5, model=TimeModel())
    assert top["key"] == "a" and 1 <= plan.clusters <= 30


def test_stream_of_files_equals_the_batch(spark, tmp_path):
    df = events(spark, 600, 6)
    for c in range(6):
        df.filter(F.col("c") == c).coalesce(1).write.parquet(f"{tmp_path}/in/f{c}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = stream_aggregate(stream, F.col("k"), F.lit(1), F.col("c"), [F.col("id")], 6, ApproxConf(ratio=3), f"{tmp_path}/state")
    batch = approx_count(df, F.col("k"), F.col("c"), [F.col("id")], ApproxConf(ratio=3))
    assert sorted(found.result.collect()) == sorted(batch.collect()) and len(found.waves) == 3


def test_no_hit_is_no_reason_to_stop(spark):
    df = events(spark).withColumn("rare", F.when((F.col("c") == 29) & (F.col("id") % 2 == 1), "x"))
    query = Query(df, F.col("rare"), F.lit(1), F.col("c"), F.col("id"))
    found = run_waves(query, ApproxConf(adaptive_dropping=True, target_error=0.5, seed=None), per_wave=3)
    assert len(found.waves) == 10 and found.waves[0].error == float("inf") and [r.value for r in found.result.collect()] == [100]


def test_a_hard_drop_cancels_the_running_wave(spark):
    slow = F.udf(lambda x: time.sleep(0.05) or x, "string")
    df = events(spark, 2000, 10).withColumn("k", F.when(F.col("c") >= 4, slow("k")).otherwise(F.col("k")))
    query, began, first = Query(df, F.col("k"), F.lit(1), F.col("c"), F.col("id")), time.monotonic(), []

    def drop():
        return bool(first) and time.monotonic() - first[0] > 1.0

    conf = ApproxConf(hard_drop=True, seed=None)
    found = run_waves(query, conf, per_wave=4, clusters=list(range(10)), watch=lambda w: first.append(time.monotonic()), drop=drop)
    assert [w.status for w in found.waves] == ["dropped"] and found.waves[0].clusters_done == 4 and found.sampled.total == 10
    assert time.monotonic() - began < 60 and all(r.range > 0 for r in found.result.collect())
    again = run_waves(Query(events(spark, 200, 10), F.col("k"), F.lit(1), F.col("c"), F.col("id")), conf, per_wave=5, drop=lambda: False)
    assert [w.clusters_done for w in again.waves] == [5, 10]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    df = events(spark, 600, 6)
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = lambda: stream_aggregate(read(), F.col("k"), F.lit(1), F.col("c"), F.col("id"), 6, ApproxConf(ratio=3), f"{tmp_path}/state")
    for part in (range(3), range(3, 6)):
        for c in part:
            df.filter(F.col("c") == c).coalesce(1).write.parquet(f"{tmp_path}/in/f{c}")
        found = run()
        assert len(found.waves) == 3  # those of this run alone; the state has all
    batch = approx_count(df, F.col("k"), F.col("c"), F.col("id"), ApproxConf(ratio=3))
    assert sorted(found.result.collect()) == sorted(batch.collect())


def test_a_record_that_the_end_of_a_file_breaks_off_is_left_out(spark, tmp_path):
    texts = {"a": "<page>a</page><page>b", "b b": "<page>c</page>", "c": "x</page><page>é\n</page>\n</mediawiki>", "d": "<page>none", "e": "", "f": "no mark", "g": "<page>" + "y" * 200_000}
    for name, text in texts.items():
        (tmp_path / f"{name}.xml").write_text(text)
    with gzip.open(tmp_path / "z.xml.gz", "wt") as out:
        out.write("<page>z</page>\n")
    found = readers.between(spark, str(tmp_path), "<page>", "</page>").collect()
    assert sorted(r.value for r in found) == ["<page>a</page>", "<page>c</page>", "<page>z</page>", "<page>é\n</page>"]


def test_minimum(spark):
    values = [10, 12, 11, 9.5, 13, 10.5]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    found = approx_minimum(df, F.col("v"))
    assert found.least == 9.5 and found.n == 6 and round(found.error, 3) == 31.708
    text = spark.createDataFrame([(f"run f={v}M x",) for v in values] + [("no cost",)], "t string")
    bound, line, stopped = search_minimum(text, F.col("t"))
    assert line == "(6.49-9.50]:  run f=9.5M x" and not stopped
    assert error_bound(1, float("nan")) == 100 and approx_minimum(df.limit(0), F.col("v")).least is None
    assert confidence_of(50, 2.0, 5) < confidence_of(60, 2.0, 5) and corrected_spread(1, 0, 0, 0.95) != corrected_spread(1, 0, 0, 0.95)


def test_the_bound_of_many_values():
    assert [round(confidence_of(e, 2.0, 10), 12) for e in (1.0, 30.0)] == [round(1 - 1 / (1 + e * e / (120 * 8)) ** 10, 12) for e in (1.0, 30.0)]
    for n in (10**4, 10**6, 10**9):
        error = error_bound(n, 2.0)
        assert confidence_of(error, 2.0, n) > 0.95 and 0 < error < 100
    assert error_bound(10, 1e110) == 100


def test_log_lines(spark):
    rows = [
        'h - - [24/Nov/2013:06:25:45 -0500] "GET /a?x=1 HTTP/1.1" 200 123 "ref" "agent"',
        'h - - [24/Nov/2013:06:25:45 +0000] "GET /pma/x HTTP/1.1" 200 - "ref"',
        'h - - [24/Nov/2013:06:25:45 +0000] "GET /x HTTP/1.1" 200 5',
        "junk",
        None,
    ]
    df = readers.access_log(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, value string"))
    df = df.select("i", "parsed", "user_agent", T.week_hour(F.col("datetime")).alias("w"), T.without_query(F.col("request")).alias("p"), T.is_attack(F.col("request")).alias("a"), T.byte_count(F.col("bytes")).alias("b"))
    found = [tuple(r)[1:] for r in df.orderBy("i").collect()]
    assert found[0] == (True, "agent", "Sun 11", "GET /a", False, 123)
    assert found[1] == (True, "-", "Sun 06", "GET /pma/x HTTP/1.1", True, None)
    assert [r[0] for r in found[2:]] == [False, False, False]
    views = readers.page_views(spark.createDataFrame([("20130101 05 en Main 7",), ("20130101\t05\tde\tHaupt",), ("a b c ",)], "value string"))
    assert [tuple(r) for r in views.select("project", "page", "size", "parsed").collect()] == [("en", "Main", 7, True), ("de", "Haupt", None, True), (None, None, None, False)]


PAGE = '<page><title>A &amp; B</title><id>7</id><text xml:space="preserve">{}</text></page>'


def test_wiki_pages(spark, tmp_path):
    body = "[[a|b]] [[a#s]] [[#s|x]] [[]] [[File:k|[[C]]]] [[de:X]] [[open {{x-stub}}"
    (tmp_path / "d.xml").write_text("<mediawiki>" + PAGE.format(body) + "\n" + PAGE.format("#OMDIRIGERING [[x]] {{Förgrening}}") + "</mediawiki>")
    pages = readers.wiki_dump(spark, str(tmp_path / "d.xml"), "SV").orderBy("markup").collect()
    assert len(pages) == 2 and pages[0].is_redirect and pages[0].is_disambig and not pages[1].is_redirect
    assert pages[1].title == "A & B" and pages[1].is_article and pages[1].is_stub
    assert [(x.anchor, x.target) for x in pages[1].links] == [("b", "a"), ("a", "a")]
    one = spark.createDataFrame([(PAGE.format("x [[de:\nY]] {{توضيح}}"),), ("<page><ns>2</ns></page>",)], "v string")
    v = F.col("v")
    got = one.select(W.interlanguage_link(v, "de"), W.is_disambiguation(v, "ar"), W.is_article(v), W.is_empty(v), W.is_redirect(v), W.display_content(v)).collect()
    assert tuple(got[0])[:5] == (None, True, True, False, False) and got[0][5].startswith("<h1>A & B</h1>")
    assert tuple(got[1])[:5] == (None, False, False, True, False)
    assert W.language("xx").code == "en" and len(W.LANGUAGES) == 8
    with pytest.raises(ValueError):
        readers.between(spark, "x", "", "y")


def test_lines_know_their_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1\n2\n")
    rows = readers.lines(spark, str(tmp_path / "a.txt")).collect()
    assert [r.value for r in rows] == ["1", "2"] and rows[0].file.endswith("a.txt")
