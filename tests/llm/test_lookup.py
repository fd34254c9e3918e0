import pytest
from pyspark.sql import functions as F

from plusminus.llm import secrets, simhash, substring_dedup
from plusminus.llm.lookup import FILE_BITS, looked_up, numbered


def table_of(spark, tmp_path, n=500, parts=7):
    spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(parts).write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_looked_up_equals_a_join(spark, tmp_path):
    rows = numbered(table_of(spark, tmp_path), "row")
    found = rows.filter("doc_id % 3 = 0").select("row", F.array(F.struct(F.col("doc_id").alias("start"), (F.col("doc_id") + 1).alias("stop"))).alias("spans"), F.lit(1).alias("other"))
    got = {r.doc_id: r.spans for r in looked_up(rows, "row", found, "spans").collect()}
    assert len(got) == 500 and rows.filter(F.col("row") >= 1 << FILE_BITS).count() > 0
    assert all((spans is None) == (d % 3 != 0) for d, spans in got.items())
    assert all(spans[0].start == d and spans[0].stop == d + 1 for d, spans in got.items() if spans)


def test_looked_up_moves_no_row(spark, tmp_path):
    rows = numbered(table_of(spark, tmp_path), "row")
    plan = looked_up(rows, "row", rows.select("row", F.lit(True).alias("there")), "there")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange") == 1


def test_looked_up_empty_tables(spark, tmp_path):
    rows = numbered(table_of(spark, tmp_path, 20, 2), "row")
    none = rows.filter("doc_id < 0").select("row", F.lit("x").alias("value"))
    assert looked_up(rows, "row", none, "value").filter("value is null").count() == 20
    assert looked_up(rows.limit(0), "row", none, "value").count() == 0
    assert numbered(table_of(spark, tmp_path / "none").limit(0), "row").count() == 0


def split_otherwise(spark, tasks, size):
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(tasks))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.fixture
def settings(spark):
    yield
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rows_have_one_number_however_a_scan_is_split(spark, tmp_path, settings):
    docs = table_of(spark, tmp_path)
    split_otherwise(spark, 13, "1k")
    one = {r.doc_id: r.row for r in numbered(docs, "row").collect()}
    split_otherwise(spark, 1, "128m")
    assert one == {r.doc_id: r.row for r in numbered(docs.filter("doc_id >= 0").select("text", "doc_id"), "row").collect()}
    assert len(set(one.values())) == 500
    # Rows that aren't rows of files, or not once each, are written first.
    for other in (docs.unionByName(docs), docs.repartition(3), spark.range(9).toDF("doc_id"), docs.withColumn("x", F.rand()), docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x"))):
        rows = [r.row for r in numbered(other, "row").collect()]
        assert len(rows) == len(set(rows)) == other.count()


@pytest.mark.parametrize("stage", [simhash.one_of_each, substring_dedup.without_repeats, lambda docs: secrets.masked(docs, "#")], ids=["simhash", "substring", "secrets"])
def test_results_hold_when_the_second_scan_is_split_otherwise(spark, data, settings, stage):
    docs = spark.read.parquet(f"{data}/documents.parquet").repartition(5)
    docs = spark.read.parquet(written_again(docs, spark))
    found = []
    for planned, read in ((4, 2), (2, 9)):
        split_otherwise(spark, planned, "128m" if planned == 4 else "64k")
        result = stage(docs)
        split_otherwise(spark, read, "64k" if planned == 4 else "128m")
        found.append(sorted((r.doc_id, r.text or "") for r in result.select("doc_id", "text").collect()))
    assert found[0] == found[1] and len(found[0]) > 150


def written_again(df, spark):
    from plusminus.llm.common import shared_path

    path = shared_path(spark, "again")
    df.write.parquet(path)
    return path
