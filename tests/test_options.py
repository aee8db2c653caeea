"""Cases of the match path, reviews and keyed operators by hand."""

import pytest
from bidloom.functions import text
from bidloom.operators import keyed, matching, options, rules, sequences
from pyspark.sql import functions as F

BASIS = "project long, basis_id long, seq long, reference string, description string, quantity double, unit string, manufacturers array<string>, attributes array<string>, scope array<string>, verified boolean"
OFFERS = "project long, supplier long, offer_id long, seq long, reference string, description string, quantity double, unit string, manufacturer string, article string, role string, group_id string, total double, verified boolean"


def basis(spark, **change):
    row = {"project": 1, "basis_id": 1, "seq": 1, "reference": "02.03.10", "description": "Rohr Stahl verzinkt", "quantity": 3.0, "unit": "Stk", "manufacturers": [], "attributes": [], "scope": [], "verified": True} | change
    return spark.createDataFrame([tuple(row.values())], BASIS)


def offers(spark, *changes):
    rows = []
    for k, change in enumerate(changes):
        row = {"project": 1, "supplier": 7, "offer_id": k, "seq": k, "reference": "2.3.10", "description": "Rohr Stahl verzinkt", "quantity": 3.0, "unit": "Stück", "manufacturer": None, "article": None, "role": "PRIMARY", "group_id": None, "total": 300.0, "verified": True} | change
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, OFFERS)


def option(spark, b, o):
    return options.options(b, o).first()


def test_a_whole_offer_is_clear(spark):
    r = option(spark, basis(spark), offers(spark, {}))
    assert (r.availability, r.scope, r.status, r.total, r.reliable) == ("PRESENT", "COMPLETE_MATERIAL_SCOPE", "CLEAR_RECOMMENDATION", 300.0, True)


@pytest.mark.parametrize(
    ("b", "o", "want"),
    [
        ({"quantity": 5.0}, {}, "PARTIAL_MATERIAL_SCOPE"),
        ({}, {"unit": "m"}, "PARTIAL_MATERIAL_SCOPE"),
        ({"manufacturers": ["Alpha"]}, {"manufacturer": "Beta"}, "TECHNICALLY_DEVIATING"),
        ({"manufacturers": ["Alpha"]}, {}, "UNKNOWN"),
        ({"attributes": ["DN 50"]}, {"description": "Rohr Stahl verzinkt DN 40"}, "TECHNICALLY_DEVIATING"),
        ({"attributes": ["DN 50"]}, {"description": "Rohr Stahl verzinkt 2 Zoll"}, "COMPLETE_MATERIAL_SCOPE"),
        ({"scope": ["Gegenflansch"]}, {}, "PARTIAL_MATERIAL_SCOPE"),
        ({"scope": ["Montage vor Ort"]}, {}, "COMPLETE_MATERIAL_SCOPE"),
        ({}, {"role": "NOT_OFFERED"}, "EXPLICIT_NO_OFFER"),
        ({}, {"total": None}, "UNKNOWN"),
        ({"verified": False}, {}, "UNKNOWN"),
    ],
)
def test_gates_of_one_line(spark, b, o, want):
    assert option(spark, basis(spark, **b), offers(spark, o)).scope == want


def test_components_are_part_of_the_price_and_options_are_not(spark):
    r = option(spark, basis(spark), offers(spark, {}, {"role": "MANDATORY_COMPONENT", "reference": None, "total": 20.0}, {"role": "OPTIONAL", "reference": None, "group_id": "g", "total": 9.0}))
    assert (r.n_lines, r.total, r.scope) == (3, 320.0, "COMPLETE_MATERIAL_SCOPE")
    r = option(spark, basis(spark), offers(spark, {}, {"role": "MANDATORY_COMPONENT", "reference": None, "total": None}))
    assert (r.total, r.scope) == (None, "PARTIAL_MATERIAL_SCOPE")


def test_a_covered_position_without_a_line(spark):
    b = basis(spark, description="Ventil", reference="2.3.11")
    r = option(spark, b, offers(spark, {"reference": "2.3.10", "description": "Rohr"}, {"reference": "2.3.12", "description": "Bogen"}))
    assert (r.availability, r.n_lines, r.reliable, r.status) == ("COVERED_WITHOUT_OFFER", 0, True, "MATCHING_UNCLEAR")


def test_a_model_may_be_spelt_apart(spark):
    d = spark.createDataFrame([("rx25", ["alpha"], "pumpe rx pro 25 neu", ["alpha ag"]), ("rx25", ["alpha"], "pumpe rx 26", ["alpha"]), ("rx25", ["alpha"], "rx25", [])], "m string, w array<string>, t string, k array<string>")
    assert [r.x for r in d.select(options.product_identity(F.col("m"), F.col("w"), F.col("t"), F.col("k")).alias("x")).collect()] == [True, False, False]


def test_attributes_without_diameter(spark):
    d = spark.createDataFrame([("PN 16", "Flansch PN16"), ("PN 16", "Flansch"), ("", "x"), (None, "x")], "v string, o string")
    assert [r.x for r in d.select(text.attribute_match(F.col("v"), F.col("o")).alias("x")).collect()] == ["MATCH", "UNRESOLVED", "UNRESOLVED", "UNRESOLVED"]


def test_several_reviews_of_a_line_are_one_row(spark):
    lines = spark.createDataFrame([(1, "a", "NEW", []), (2, "b", "NEW", ["f"])], "k int, f string, verification_status string, locked_fields array<string>")
    actions = spark.createDataFrame([(1, 2, "SET", "z"), (1, 1, "SET", "y"), (2, 1, "CONFIRM", None), (2, 2, "CLEAR", None)], "k int, seq int, action string, new_value string")
    got = {r.k: (r.f, r.verification_status, r.error) for r in rules.reviewed(lines, actions, "k", "f", ["seq"]).collect()}
    assert got == {1: ("y", "HUMAN_CORRECTED", "LOCKED"), 2: ("b", "HUMAN_CONFIRMED", "LOCKED")}


def test_too_deep_a_graph_is_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    with pytest.raises(RuntimeError):
        keyed.reachable(edges, spark.createDataFrame([(0,)], "node long"), 3)
    assert keyed.reachable(edges, spark.createDataFrame([(0,)], "node long"), 10).count() == 7


def test_binned_joins_equal_brute_force(spark):
    at = [0.0, 0.04, 0.2, 0.24, 0.281, 0.5, 0.5, 0.9]
    got = {r.i for r in sequences.lone_in_range(spark.createDataFrame([(1, i, x) for i, x in enumerate(at)], "k int, i int, x double"), ["k"], "x", 0.04).filter("lone").collect()}
    assert got == {i for i, x in enumerate(at) if not any(i != j and x - 0.04 <= y <= x + 0.04 for j, y in enumerate(at))}
    basis = spark.createDataFrame([("p", i) for i in range(0, 400, 7)], "prefix string, first long")
    spans = [("p", 0, 0), ("p", 60, 70), ("p", 63, 64), ("p", 5, 390), ("q", 0, 400)]
    found = matching.reference_matches(basis, spark.createDataFrame(spans, "prefix string, low long, high long")).collect()
    assert sorted((r.first, r.low, r.high) for r in found) == sorted((i, lo, hi) for i in range(0, 400, 7) for p, lo, hi in spans if p == "p" and lo <= i <= hi)
