"""How the match path and the queries on its options are worked out: pairs are judged in the join, and rows are grouped in place."""

import pytest
from bidloom.operators import options as ops
from bidloom.operators import rebuild, review
from bidloom.plans import rebuilds, registry, rulings, tender  # noqa: F401
from pyspark.sql import functions as F
from test_rebuild import LOG, REVIEWS, record, rows
from test_rebuild import tender as small

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["match_candidates", "match_bundles", "match_constraints", "match_options"])
def test_pairs_are_judged_in_the_join(spark, name):
    join = next(line for line in plan(spark, name).splitlines() if "Join Inner" in line and "p_spare" in line)
    assert "bit_count" in join


def test_positions_without_candidates_are_one_row_a_supplier(spark):
    b, o = small(spark, 2)
    o = o.withColumn("description", o.supplier.cast("string")).withColumn("reference", o.group_id)
    d = ops.matched(*ops.prepared(b, o), rest=True)
    assert sorted((r.project, r.supplier, len(r.rest)) for r in d.collect()) == [(0, 1, 3), (0, 2, 3), (1, 1, 3), (1, 2, 3)]
    assert {r.availability for r in ops.options(b, o).collect()} == {"NOT_COVERED"} and ops.options(b, o).count() == 12


@pytest.mark.parametrize("name", ["comparable_options", "review_categories"])
def test_options_of_a_position_are_grouped_in_place(spark, name):
    assert "hashpartitioning(basis_id" not in registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()


def test_warnings_are_counted_without_a_row_of_each(spark):
    told = review.option_warnings(*[F.lit(None)] * 10)
    assert [code for code, _ in told][::4] == ["PRICE_NOT_FOUND", "UNIT_DIFFERS", "DOCUMENT_UNCONFIRMED"]


def test_no_row_of_a_part_and_a_supplier_is_made_for_issues(spark):
    assert plan(spark, "options_to_review").count("Join LeftOuter") == 1  # the validated suppliers


def test_options_are_replaced_by_project(spark):
    b, o = small(spark)
    log = spark.createDataFrame([record(1, 1, "POSITION", 10, "quantity", "5.0", "4.0")], LOG)
    none = spark.createDataFrame([], REVIEWS)
    placed = rebuild.rebuilt(ops.in_projects(b, o), b, o, log, none)
    assert "LeftAnti, ((basis_id" not in placed._jdf.queryExecution().optimizedPlan().toString()
    assert rows(placed) == rows(rebuild.rebuilt(ops.options(b, o), b, o, log, none).select(placed.columns))
