"""Queries on tables whose keys are larger than those of the small ones."""

import duckdb
import pytest
from bidloom.functions import numbers
from bidloom.operators import matching, sequences
from bidloom.plans import offers, registry, rest, tender  # noqa: F401
from compare import connect, same_rows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The tables of SF with parts and suppliers (and lines of them) beyond a million."""
    folder = tmp_path_factory.mktemp("shifted")
    keys = {"lineitem": "l_partkey + 1200000 AS l_partkey, l_suppkey + 60000 AS l_suppkey", "part": "p_partkey + 1200000 AS p_partkey", "supplier": "s_suppkey + 60000 AS s_suppkey"}
    for name, replaced in keys.items():
        duckdb.sql(f"COPY (SELECT * REPLACE ({replaced}) FROM '{SF}/{name}.parquet') TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_stated_prices_of_thousands(spark, shifted):
    same_rows(registry.QUERIES["stated_prices"](spark, shifted), connect(shifted), registry.ORACLES["stated_prices"])


def test_german_format_keeps_the_sign_of_nothing(spark):
    d = spark.createDataFrame([(i, x) for i, x in enumerate([-0.0, -0.001, 0.0, -5.5])], "i int, x double").select("i", numbers.german_format(F.col("x")).alias("shown"))
    assert [r.shown for r in sorted(d.collect())] == ["-0", "-0", "0", "-5,5"]


def test_sweeps_send_no_page_on_its_own(spark):
    items = spark.range(40).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), (F.col("id") / 4).alias("y"), F.lit(0).alias("x"), F.lit(1.0).alias("height"))
    for d in (sequences.clustered_lines(items, ["k"], 0.1), sequences.overlapping_lines(items, ["k"])):
        assert "FlatMapGroups" not in d._jdf.queryExecution().toString()
        assert d.count() == 40


def test_the_match_path_shuffles_no_pairs(spark):
    plan = registry.QUERIES["match_options"](spark, SF)._jdf.queryExecution().toString()
    assert "hashpartitioning(basis_id" not in plan and "hashpartitioning(offer_id" not in plan


def test_availability_and_clusters_make_no_rows_of_pairs(spark):
    positions = spark.range(2000).select(F.col("id").alias("basis_id"), F.lit("a").alias("prefix"), F.col("id").alias("first"))
    covered = spark.range(3000).select(F.col("id").alias("supplier"), F.lit("a").alias("prefix"), F.col("id").alias("low"), (F.col("id") + 99).alias("high"))
    present = spark.createDataFrame([(5, 2, False), (5, 3, True), (5, 2999, False)], "basis_id long, supplier long, no_offer boolean")
    got = {(r.basis_id, r.availability): r.n_suppliers for r in matching.availability_counts(positions, covered, present).filter("basis_id in (5, 1999)").collect()}
    assert got == {(5, "EXPLICIT_NO_OFFER"): 1, (5, "PRESENT"): 2, (5, "COVERED_WITHOUT_OFFER"): 4, (5, "NOT_COVERED"): 2993, (1999, "COVERED_WITHOUT_OFFER"): 100, (1999, "NOT_COVERED"): 2900}
    plan = registry.QUERIES["project_clusters"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert "Distinct" in plan or "Deduplicate" in plan
