"""The estimator against plain Python, and what must hold for any sample."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plusminus.conf import ApproxConf, Variance
from plusminus.functions.stats import LONG_MAX, sample_variance, short_number, short_number_column, t_quantile, z_value
from plusminus.operators import sampling
from plusminus.operators.estimator import NULL_KEY, approx_count, approx_sum, half_width
from plusminus.operators.render import as_lines, relative_error


def plain_estimate(rows, total, conf, sampled):
    """rows: (cluster, key, value); sampled: places of rows. The formulas, cluster by cluster over the whole grid."""
    clusters = sorted({c for c, _, _ in rows})
    n, out = len(clusters), {}
    for key in {k for i, (_, k, _) in enumerate(rows) if i in sampled and k is not None}:
        yhat, inside = [], 0.0
        for c in clusters:
            of = [i for i, r in enumerate(rows) if r[0] == c]
            m_all, m = len(of), sum(i in sampled for i in of)
            y = sum(rows[i][2] for i in of if i in sampled and rows[i][1] == key)
            yhat.append(m_all / m * y if m and y else 0.0)
            if y > 0:
                if conf.variance is Variance.WORST_CASE:
                    inside += m_all * (m_all - m) / m * 0.1 * y
                elif conf.variance is Variance.MEASURED:
                    v = [rows[i][2] for i in of if i in sampled]
                    mean = sum(v) / len(v)
                    inside += m_all * (m_all - m) / m * math.floor(sum((x - mean) ** 2 for x in v) / len(v))
                elif m > 1 and y <= m:
                    inside += m_all * (m_all - m) / (m - 1) * y / m * (1 - y / m)
        between = 0.0 if n == total else total * (total - n) / n * sample_variance(yhat)
        var = between + total / n * inside
        half = LONG_MAX if var == math.inf else math.ceil(round(t_quantile(n - 1) * math.sqrt(var), 6))
        out[key] = (math.floor(round(total / n * sum(yhat), 6)), half)
    return out


@pytest.mark.parametrize("variance", list(Variance))
def test_against_plain_python(spark, variance):
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.choice(["a", "b", "c", None]), float(rng.randrange(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, c int, k string, v double")
    conf = ApproxConf(ratio=4, seed=None, offset=1, variance=variance)
    place, sampled = {}, set()
    for i, (c, _, _) in enumerate(rows):
        place[c] = place.get(c, -1) + 1
        if place[c] % 4 == 1:
            sampled.add(i)
    value = F.lit(1) if variance is Variance.PROPORTION else F.col("v")
    shaped = [(c, k, 1 if variance is Variance.PROPORTION else v) for c, k, v in rows]
    found = approx_sum(df, F.col("k"), value, F.col("c"), [F.col("id")], conf).collect()
    assert {r.key: (r.value, r.range) for r in found} == plain_estimate(shaped, 6, conf, sampled)


def frame(spark, n=600, clusters=12, keys=3, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, i % clusters, f"k{rng.randrange(keys)}") for i in range(n)], "id long, c int, k string")


def test_exact_without_sampling(spark):
    df = frame(spark)
    found = approx_count(df, F.col("k"), F.col("c"), [F.col("id")]).collect()
    assert {r.key: r.value for r in found} == {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert all(r.range == 0 for r in found)


def test_truth_lies_inside_most_intervals(spark):
    df = frame(spark, 2000, 40).cache()
    truth = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    inside = total = 0
    for seed in range(12):
        for r in approx_count(df, F.col("k"), F.col("c"), [F.col("id")], ApproxConf(ratio=3, keep_fraction=0.5, seed=seed)).collect():
            inside += abs(r.value - truth[r.key]) <= r.range
            total += 1
    assert inside >= 0.85 * total


def test_ranges_fall_with_the_ratio(spark):
    df = frame(spark, 2000, 40).cache()
    mean = [sum(r.range for r in approx_count(df, F.col("k"), F.col("c"), [F.col("id")], ApproxConf(ratio=k)).collect()) for k in (20, 5, 2)]
    assert mean[0] > mean[1] > mean[2]


def test_null_key_one_cluster_and_empty(spark):
    df = frame(spark)
    rows = {r.key: r for r in approx_count(df, F.col("k"), F.col("c"), [F.col("id")], ApproxConf(ratio=5, null_key=True)).collect()}
    assert rows[NULL_KEY].value == 0 and rows[NULL_KEY].range > 0
    one = approx_count(df, F.col("k"), F.col("c"), [F.col("id")], ApproxConf(keep_fraction=0.01)).collect()
    assert one and all(r.range == LONG_MAX for r in one)
    assert approx_count(df.limit(0), F.col("k"), F.col("c"), [F.col("id")], ApproxConf(ratio=5)).collect() == []


def test_more_than_one_hit_a_record_drops_the_variance_term(spark):
    df = spark.createDataFrame([(i, i % 2, "k", 3) for i in range(40)], "id long, c int, k string, v int")
    assert all(r.range == 0 for r in approx_sum(df, F.col("k"), F.col("v"), F.col("c"), [F.col("id")], ApproxConf(ratio=2, seed=None)).collect())


def test_conf_is_checked():
    for bad in ({"keep_fraction": 2}, {"confidence": 1}, {"precise": True, "ratio": 2}, {"precise": True, "progressive": True}, {"target_error": -1}, {"max_per_cluster": -1}):
        with pytest.raises(ValueError):
            ApproxConf(**bad)
    assert ApproxConf(ratio=0).ratio == 1


def test_a_measure_is_a_number(spark):
    with pytest.raises(TypeError):
        approx_sum(frame(spark), F.col("k"), F.col("k"), F.col("c"), [F.col("id")])


def test_block_sample_takes_one_of_each_block(spark):
    placed = sampling.block_sample(frame(spark, 103, 1), F.col("c"), [F.col("id")], ApproxConf(ratio=10)).filter("sampled").collect()
    assert [r.pos // 10 for r in placed][:10] == list(range(10)) and len(placed) in (10, 11)
    capped = sampling.block_sample(frame(spark, 103, 1), F.col("c"), [F.col("id")], ApproxConf(max_per_cluster=7))
    assert capped.count() == 7


def test_scan_sample_counts_what_it_reads(spark):
    rows = sampling.scan_sample(spark.range(0, 1000, 1, 5), ApproxConf(ratio=7)).groupBy("cluster").agg(F.count("*").alias("n"), F.count_if("sampled").alias("m"), F.max("pos").alias("last")).collect()
    assert len(rows) == 5 and all(r.n == 200 and r.last == 199 and r.m in (28, 29) for r in rows)
    df = frame(spark, 5000).repartition(8)
    found = {r.key: r for r in approx_count(df, F.col("k"), None, conf=ApproxConf(ratio=5, null_key=True)).collect()}
    truth = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    assert set(found) == {*truth, NULL_KEY} and all(abs(found[k].value - n) < 4 * found[k].range for k, n in truth.items())
    with pytest.raises(ValueError):
        approx_count(df, F.col("k"), None, conf=ApproxConf(keep_fraction=0.5))


@pytest.mark.parametrize("sample", [lambda df, c: sampling.keyed_sample(df, F.col("c"), F.col("id"), c), sampling.scan_sample], ids=["keyed", "scan"])
def test_sampling_as_records_are_read_neither_sorts_nor_shuffles(spark, sample):
    plan = sample(frame(spark), ApproxConf(ratio=5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan and "Python" not in plan


def test_a_sample_with_missing_keys_has_no_bias(spark):
    df = frame(spark, 6000, 4).filter("id % 3 != 1 and id % 7 != 2")
    truth = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    found = [{r.key: r.value for r in approx_count(df, F.col("k"), F.col("c"), F.col("id"), ApproxConf(ratio=5, seed=s)).collect()} for s in range(6)]
    assert all(abs(sum(f[k] for f in found) / 6 - n) < 0.08 * n for k, n in truth.items())


def test_arrays_of_keys_count_a_record_once(spark):
    df = spark.createDataFrame([(i, i % 4, ["a", "b"] if i % 2 else [] if i % 3 else None) for i in range(400)], "id long, c int, k array<string>")
    found = approx_sum(df, F.col("k"), F.lit(1), F.col("c"), F.col("id"), ApproxConf()).collect()
    assert sorted((r.key, r.value, r.range) for r in found) == [("a", 200, 0), ("b", 200, 0)]


def test_quantiles_and_numbers():
    assert [round(t_quantile(df), 4) for df in (1, 14, 29, 1000)] == [12.7062, 2.1448, 2.0452, 1.9623]
    assert t_quantile(0) == 1.96 and z_value(0.95) == 1.96
    assert [short_number(x) for x in (1000, 1234, 1_000_000, 2_340_000)] == ["1000", "1.2K", "1000.0K", "2.3M"]
    assert half_width(10, (5, 25, 0), 10, 1) == math.inf


def test_short_number_column_rounds_as_c_does(spark):
    rng = random.Random(7)
    values = [1250.0, 1350.0, 1450.0, 1750.0, 2250.0, 1_250_000.0, 1_450_000.0, 999_950.0, 1_999_950_000.0, 1000.0, 0.0, 1e15, 1e24, float("inf")]
    values += [float(rng.randrange(10 ** rng.randrange(3, 10))) for _ in range(500)] + [50.0 * k for k in range(20, 600)] + [rng.uniform(1e3, 1e8) for _ in range(200)]
    values += [50_000.0 * k for k in range(20, 600)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    rows = df.select("v", short_number_column(F.col("v")).alias("text")).collect()
    assert [(r.v, r.text) for r in rows if r.text != (None if r.v is None else short_number(r.v))] == []


def test_rendering(spark):
    df = spark.createDataFrame([("a", 10, 5), ("b", 0, 3)], "key string, value long, range long")
    assert [r.value for r in as_lines(df).collect()] == ["a\t10+/-5", "b\t0+/-3"]
    assert [r.e for r in df.select(relative_error(F.col("value"), F.col("range")).alias("e")).collect()] == [0.5, 0.0]
    assert [r.value for r in as_lines(df.drop("range")).collect()] == ["a\t10", "b\t0"]
