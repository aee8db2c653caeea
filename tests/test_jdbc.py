"""Scans of a database: the embedded one that Spark ships, in memory."""

import uuid

import pytest
from bidloom.sources import jdbc
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def database(spark):
    url = f"jdbc:derby:memory:db{uuid.uuid4().hex};create=true"
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    jdbc.create(orders, url, "orders", createTableColumnTypes="o_orderstatus VARCHAR(20)")
    return url, orders


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitioned_scan_equals_the_parquet_path(spark, database):
    url, orders = database
    df = jdbc.scan(spark, url, "orders", "o_orderkey", 5)
    assert df.rdd.getNumPartitions() == 5 and rows(df) == rows(orders)
    with pytest.raises(Exception):
        jdbc.create(orders, url, "orders", createTableColumnTypes="o_orderstatus VARCHAR(20)")


def test_filters_and_columns_reach_the_database(spark, database):
    url, orders = database
    condition = (F.col("o_custkey") == 7) & (F.col("o_totalprice") > 1000)
    df = jdbc.scan(spark, url, "orders", "o_orderkey", 3).filter(condition).select("o_orderkey")
    text = plan(df)
    assert "EqualTo(o_custkey,7)" in text and "GreaterThan(o_totalpric" in text and "ReadSchema: struct<o_orderkey:bigint>" in text
    assert rows(df) == rows(orders.filter(condition).select("o_orderkey"))


def test_first_rows_are_found_by_the_database(spark, database):
    url, orders = database
    df = jdbc.first(spark, url, "orders", {"o_orderstatus": "O"}, [("o_totalprice", True), ("o_orderkey", False)], 3)
    assert rows(df) == rows(orders.filter("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3))
    assert "FETCH FIRST 3 ROWS ONLY" in plan(df) and jdbc.first(spark, url, "orders", {"o_orderstatus": "it's"}, [("o_orderkey", False)]).count() == 0
    with pytest.raises(ValueError):
        jdbc.first(spark, url, 'orders"; DROP', {}, [("o_orderkey", False)])


def test_appends_never_overwrite(spark):
    url = f"jdbc:derby:memory:db{uuid.uuid4().hex};create=true"
    frame = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    jdbc.create(frame((1, "a"), (2, None)), url, "log")
    assert jdbc.append_new(frame((1, "a"), (2, None), (3, "c")), url, "log", ["k"], ["v"]) == 1
    assert jdbc.append_new(frame((3, "c")), url, "log", ["k"], ["v"]) == 0
    with pytest.raises(ValueError):
        jdbc.append_new(frame((2, "b"), (4, "d")), url, "log", ["k"], ["v"])
    assert sorted((r.k, r.v or "") for r in jdbc.scan(spark, url, "log", "k", 2).collect()) == [(1, "a"), (2, ""), (3, "c")]
    jdbc.create(frame(), url, "none")
    assert jdbc.scan(spark, url, "none", "k").count() == 0
